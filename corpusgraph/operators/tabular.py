"""Tabular operators of the bundled sample library (H1–H12), on DataFrames.

Global figures (means, standard deviations) are scalar subqueries — planned
once, broadcast as literals — never a cross join or an unpartitioned window.
Exact quantiles use a distributed selection that only ever brings bounded
data (bucket counts, a checked number of values) to the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpusgraph.session import cut_lineage

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


# ------------------------------------------------------------------ H1, H2
def drop_duplicates(df: DataFrame) -> DataFrame:
    """H1: exact duplicate rows removed."""
    return df.dropDuplicates()


def fill_nulls(df: DataFrame) -> DataFrame:
    """H2: numeric nulls → column mean (numerics become double), string
    nulls → ``'Unknown'``; other types are left as they are."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, NUMERIC):
            mean = df.agg(F.avg(c)).scalar()
            cols.append(F.coalesce(c.cast("double"), mean).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(F.coalesce(c, F.lit("Unknown")).alias(f.name))
        else:
            cols.append(c)
    return df.select(cols)


def clean(df: DataFrame) -> DataFrame:
    """H1 then H2 (means of the de-duplicated rows)."""
    return fill_nulls(drop_duplicates(df))


# ------------------------------------------------------------------ H3
def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                    buckets: int = 1024) -> list[float | None]:
    """Exact quantiles with linear interpolation (numpy's default).

    All ranks are located together.  Each pass is one grouped aggregate over
    the rows still in question: it cuts every open value range into
    ``buckets`` parts and returns the count, least and greatest value of each
    part that holds rows (at most ranks times ``buckets`` rows, whatever the
    input).  A rank is settled when its range holds a single value; a pass
    narrows each range by at least the gap between two parts, so it ends for
    any finite values.  NaN and infinities are counted aside: infinities
    are the ends of the order, and any NaN makes every quantile NaN.
    """
    x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    inf = float("inf")
    n, nan, low, high, lo, hi = x.agg(
        F.count("*"), F.count_if(F.isnan("x")), F.count_if(F.col("x") == -inf),
        F.count_if(F.col("x") == inf),
        F.min(F.when(F.abs("x") < inf, F.col("x"))), F.max(F.when(F.abs("x") < inf, F.col("x")))).first()
    if n == 0:
        return [None for _ in probs]
    if nan:
        return [float("nan") for _ in probs]
    want = {k for p in probs for k in (int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1))}
    value = {k: -inf if k < low else inf for k in want if k < low or k >= n - high}
    # open ranges: (least, greatest) -> rank of the least value in it, ranks sought
    todo = {(lo, hi): (low, sorted(want - value.keys()))} if want - value.keys() else {}
    while todo:
        for (a, b) in [r for r in todo if r[0] == r[1]]:
            value |= {k: a for k in todo.pop((a, b))[1]}
        if not todo:
            break
        part = F.lit(None).cast("long")
        for i, (a, b) in enumerate(todo):
            scale = 2.0 if b - a == inf else 1.0
            share = (F.col("x") / scale - F.lit(a / scale)) / F.lit(b / scale - a / scale)
            at = F.least(F.floor(share * buckets).cast("long"), F.lit(buckets - 1).cast("long"))
            part = F.when(F.col("x").between(a, b), at + i * buckets).otherwise(part)
        rows = (x.select("x", part.alias("part")).where(F.col("part").isNotNull()).groupBy("part")
                .agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
                .orderBy("part").collect())  # at most len(todo) * buckets rows
        narrowed: dict = {}
        for i, (rank, sought) in enumerate(todo.values()):
            for r in rows:
                if r["part"] // buckets == i:
                    inside = [k for k in sought if rank <= k < rank + r["n"]]
                    if inside:
                        narrowed[(r["a"], r["b"])] = (rank, inside)
                    rank += r["n"]
        todo = narrowed
    out = []
    for p in probs:
        at = p * (n - 1)
        i, share = int(at), at - int(at)
        v = value[i]
        out.append(float(v if share == 0 or value[i + 1] == v else v + (value[i + 1] - v) * share))
    return out


def statistics(df: DataFrame, col: str) -> DataFrame:
    """H3: mean, median, population std, min, max, quartiles (one row)."""
    q1, q2, q3 = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    c = F.col(col).cast("double")
    return df.agg(
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
        F.min(c).alias("min"), F.max(c).alias("max"),
    ).select("mean", F.lit(q2).cast("double").alias("median"), "std", "min", "max",
             F.lit(q1).cast("double").alias("q1"), F.lit(q2).cast("double").alias("q2"),
             F.lit(q3).cast("double").alias("q3"))


# ------------------------------------------------------------------ H4
def grouped_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float],
                      buckets: int = 1024) -> DataFrame:
    """Exact quantiles (linear interpolation) of every group, ``by..., q0, q1,
    ...``, all groups together and no group in one buffer.

    A group keeps the value ranges that hold its ranks, at first one from its
    least to its greatest value.  Each pass is one aggregate for all groups: a
    row finds the range of its group that holds it, and every range is cut
    into ``buckets`` parts of which count, least and greatest value remain.
    The parts with a rank are the next ranges; a rank is settled when its
    range holds one value.  Hot groups are partial counts; the ranges are a
    written table.  Nulls do not count, a group without values has none, a
    NaN makes all quantiles of its group NaN, infinities are the ends of the
    order.  Null keys are a group of their own.
    """
    inf = float("inf")
    keys = [f"_k{i}" for i in range(len(by))]
    x = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(col).cast("double").alias("x"))
    finite = F.when(F.abs("x") < inf, F.col("x"))
    groups = cut_lineage(x.groupBy(*keys).agg(
        F.count("x").alias("n"), F.count_if(F.isnan("x")).alias("nan"), F.count_if(F.col("x") == -inf).alias("low"),
        F.count_if(F.col("x") == inf).alias("high"), F.min(finite).alias("a"), F.max(finite).alias("b"))
        .withColumn("g", F.monotonically_increasing_id()))
    same = functools.reduce(lambda p, q: p & q, [F.col(f"x.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys])
    x = x.where(F.abs("x") < inf).alias("x").join(groups.alias("g"), same).select("g", "x")

    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = groups.where("n > 0 and nan = 0").select("g", "n", "low", "high", "a", "b", F.explode(F.array_distinct(F.flatten(
        F.array(*[F.array(F.floor(i), F.least(F.floor(i) + 1, F.col("n") - 1)) for i in at])))).alias("k"))
    ends = ranks.where("k < low or k >= n - high").select("g", "k", F.when(F.col("k") < F.col("low"), -inf).otherwise(inf).alias("v"))
    open_ = ranks.where("k >= low and k < n - high").groupBy("g", "a", "b").agg(
        F.max("low").alias("base"), F.collect_set("k").alias("ks"))
    settled, open_ = [ends], cut_lineage(open_)
    while True:
        done = open_.where("a = b").select("g", F.explode("ks").alias("k"), F.col("a").alias("v"))
        settled.append(done)
        open_ = open_.where("a < b")
        if open_.isEmpty():
            break
        ranges = open_.groupBy("g").agg(F.collect_list(F.struct("a", "b", "base", "ks")).alias("rs"))
        half = F.when(F.col("r.b") - F.col("r.a") == inf, 2.0).otherwise(1.0)
        share = (F.col("x") / half - F.col("r.a") / half) / (F.col("r.b") / half - F.col("r.a") / half)
        parts = (x.join(ranges, "g").select("g", "x", F.filter(
            "rs", lambda r: F.col("x").between(r["a"], r["b"])).alias("r"))
            .where(F.size("r") > 0).select("g", "x", F.col("r")[0].alias("r"))
            .groupBy("g", F.col("r.a").alias("from"), F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("part"))
            .agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"),
                 F.first("r.base").alias("base"), F.first("r.ks").alias("ks")))
        before = Window.partitionBy("g", "from").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        first = F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))  # over ``buckets`` rows at most
        open_ = cut_lineage(
            parts.withColumn("base", first).withColumn("ks", F.filter(
                "ks", lambda k: (k >= F.col("base")) & (k < F.col("base") + F.col("n"))))
            .where(F.size("ks") > 0).select("g", "a", "b", "base", "ks"))
    values = functools.reduce(DataFrame.unionByName, settled).groupBy("g").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("value"))
    out = groups.join(values, "g", "left")
    for i, p in enumerate(at):
        low, up = F.col("value")[F.floor(p)], F.col("value")[F.least(F.floor(p) + 1, F.col("n") - 1)]
        v = F.when(low == up, low).otherwise(low + (up - low) * (p - F.floor(p)))
        v = F.when(p == F.floor(p), low).otherwise(v)
        out = out.withColumn(f"q{i}", F.when(F.col("n") == 0, F.lit(None)).when(
            F.col("nan") > 0, F.lit(float("nan"))).otherwise(v))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *[f"q{i}" for i in range(len(probs))])


AGG_FUNCS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
    "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct,
}
ORDERED_FUNCS = {"first": F.min_by, "last": F.max_by}


def aggregate(df: DataFrame, group_by: Sequence[str],
              spec: dict[str, Sequence[str]], order_by: Sequence[str] | None = None) -> DataFrame:
    """H4: ``{col: [fn, ...]}`` → columns ``col_fn``; rows with a null key
    dropped, output sorted by the keys.  ``first`` and ``last`` are the first
    and last value that is not null by ``order_by`` (by all columns of the
    row without it), ties by the value; medians are selected by ranges
    (``grouped_quantiles``).  Unknown column/function → error."""
    order = list(df.columns if order_by is None else order_by)
    missing = [c for c in [*group_by, *spec, *order] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    aggs, medians = [], []
    for col, fns in spec.items():
        for fn in fns:
            if fn == "median":
                medians.append(col)
            elif fn in ORDERED_FUNCS:
                place = F.when(F.col(col).isNotNull(), F.struct(*order, col))
                aggs.append(ORDERED_FUNCS[fn](F.col(col), place).alias(f"{col}_{fn}"))
            elif fn in AGG_FUNCS:
                aggs.append(AGG_FUNCS[fn](F.col(col)).alias(f"{col}_{fn}"))
            else:
                raise ValueError(f"unsupported aggregation {fn!r}")
    keyed = df.where(functools.reduce(lambda a, b: a & b,
                                      [F.col(k).isNotNull() for k in group_by]))
    out = keyed.groupBy(*group_by).agg(*aggs) if aggs else keyed.select(*group_by).distinct()
    for col in medians:
        out = out.join(grouped_quantiles(keyed, group_by, col, [0.5]).withColumnRenamed("q0", f"{col}_median"),
                       list(group_by), "left")
    return out.select(*group_by, *[f"{c}_{fn}" for c, fns in spec.items() for fn in fns]).orderBy(*group_by)


# ------------------------------------------------------------------ H5
def _bin(ts: Column, freq: str) -> Column:
    d = F.to_date(ts)
    if freq == "D":
        return d
    if freq == "W":  # weeks end on Sunday and are labelled by it
        return F.next_day(F.date_sub(d, 1), "Sun")
    if freq == "M":  # labelled by the month's last day
        return F.last_day(d)
    raise ValueError(f"unsupported frequency {freq!r}")


_STEP = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS", "M": "INTERVAL 1 MONTH"}


def resample(df: DataFrame, date_col: str, freq: str = "D", how: str = "mean",
             value_cols: Iterable[str] | None = None) -> DataFrame:
    """H5: every bin between the first and the last is emitted; an empty
    bin has mean/last null and sum 0.  ``last`` = latest non-null value."""
    if how not in ("mean", "sum", "last"):
        raise ValueError(f"resample by mean, sum or last, not {how!r}")
    cols = list(value_cols) if value_cols is not None else [
        c for c in numeric_columns(df) if c != date_col]
    b = _bin(F.col(date_col), freq).alias("bin")
    binned = df.select(b, F.col(date_col).alias("_ts"), *cols)
    if how == "mean":
        aggs = [F.avg(c).alias(c) for c in cols]
    elif how == "sum":
        aggs = [F.sum(c).alias(c) for c in cols]
    else:
        aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_ts"))).alias(c)
                for c in cols]
    per_bin = binned.groupBy("bin").agg(*aggs)
    first = binned.agg(F.min("bin")).scalar()
    last = binned.agg(F.max("bin")).scalar()
    step = F.expr(_STEP[freq])
    if freq == "M":  # month ends: step over month starts, then take last_day
        cal = df.sparkSession.range(1).select(F.explode(F.sequence(
            F.trunc(first, "month"), F.trunc(last, "month"), step)).alias("m")) \
            .select(F.last_day("m").alias("bin"))
    else:
        cal = df.sparkSession.range(1).select(F.explode(F.sequence(first, last, step)).alias("bin"))
    out = cal.join(per_bin, "bin", "left")
    if how == "sum":
        out = out.select("bin", *[F.coalesce(F.col(c), F.lit(0).cast(
            per_bin.schema[c].dataType)).alias(c) for c in cols])
    return out


# ------------------------------------------------------------------ H6, H7
def detect_anomalies(df: DataFrame, col: str, threshold: float = 3.0,
                     keep: Sequence[str] = ()) -> DataFrame:
    """H6: z = |x − mean| / sample std; anomaly when z > threshold; zero or
    undefined std → z null, not an anomaly."""
    mean = df.agg(F.avg(F.col(col))).scalar()
    std = df.agg(F.stddev_samp(F.col(col))).scalar()
    z = F.try_divide(F.abs(F.col(col) - mean), F.when(std != 0, std))
    return df.select(*keep, F.col(col).alias("value"), z.alias("z_score"),
                     F.coalesce(z > threshold, F.lit(False)).alias("is_anomaly"))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which null keys match each other; keys appear once."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    same = functools.reduce(lambda a, b: a & b,
                            [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, same, "left").drop(*[f"_r_{k}" for k in keys])


def moving_averages(df: DataFrame, value_col: str, windows: Sequence[int],
                    order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """H7: mean and sample std over the last ``w`` rows (per partition key);
    null until the frame holds ``w`` non-null values.  ``order_by`` (with
    the key) must identify rows uniquely.

    Skew-proof formulation (no window over a key's whole history): rows get
    a global number from a range-partitioned sort (a hot key spans many
    partitions); every row is sent to the ``w_max`` positions it belongs to
    (``number + j``); frames are an equi-join on (key, position) followed by
    a grouped aggregate.  Exact, and ``w_max`` times the rows in the shuffle.
    """
    if not order_by:
        raise ValueError("moving averages need an explicit order column")
    from corpusgraph.sources.sinks import number_rows
    keys = list(partition_by)
    wmax = max(windows)
    numbered = number_rows(df, keys + list(order_by)).withColumnRenamed("number", "_no")
    if keys:
        first = numbered.groupBy(*keys).agg(F.min("_no").alias("_first"))
        numbered = _join_null_safe(numbered, first, keys).withColumn(
            "_no", F.col("_no") - F.col("_first")).drop("_first")
    contrib = (numbered.select(*keys, "_no", F.col(value_col).alias("_v"))
               .withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(wmax - 1))))
               .withColumn("_target", F.col("_no") + F.col("_j")))
    aggs = []
    for w in windows:
        inw = F.col("_j") < w
        vals = F.when(inw, F.col("_v"))
        aggs += [F.count(vals).alias(f"_n_{w}"), F.avg(vals).alias(f"_m_{w}"),
                 F.stddev_samp(vals).alias(f"_s_{w}"),
                 F.count_if(inw).alias(f"_rows_{w}")]
    frames = contrib.groupBy(*keys, F.col("_target").alias("_no")).agg(*aggs)
    out = _join_null_safe(numbered, frames, keys + ["_no"])
    for w in windows:
        full = (F.col(f"_n_{w}") == w) & (F.col(f"_rows_{w}") == w)
        out = out.withColumn(f"ma_{w}", F.when(full, F.col(f"_m_{w}"))) \
                 .withColumn(f"ma_std_{w}", F.when(full, F.col(f"_s_{w}")))
    drop = ["_no"] + [f"_{x}_{w}" for w in windows for x in ("n", "m", "s", "rows")]
    return out.drop(*drop)


# ------------------------------------------------------------------ H8
def transform_all(df: DataFrame, fns: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """H8: apply DataFrame → DataFrame functions in order (first error aborts)."""
    return functools.reduce(lambda acc, fn: acc.transform(fn), fns, df)


# ------------------------------------------------------------------ H9
def merge(primary: DataFrame, secondary: DataFrame, on: str | Sequence[str],
          how: str = "left") -> DataFrame:
    """H9: keys must exist on both sides; null keys match each other;
    overlapping non-key columns of the right side get ``_secondary``."""
    keys = [on] if isinstance(on, str) else list(on)
    for side, df in (("left", primary), ("right", secondary)):
        absent = [k for k in keys if k not in df.columns]
        if absent:
            raise ValueError(f"keys absent on the {side}: {absent}")
    if how not in ("left", "right", "inner", "outer"):
        raise ValueError(f"unsupported merge {how!r}")
    left = primary.select([F.col(c).alias(c if c not in keys else f"_l_{c}") for c in primary.columns])
    rcols = []
    for c in secondary.columns:
        if c in keys:
            rcols.append(F.col(c).alias(f"_r_{c}"))
        elif c in primary.columns:
            rcols.append(F.col(c).alias(f"{c}_secondary"))
        else:
            rcols.append(F.col(c))
    right = secondary.select(rcols)
    cond = functools.reduce(lambda a, b: a & b,
                            [F.col(f"_l_{k}").eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    j = left.join(right, cond, "full" if how == "outer" else how)
    key_cols = []
    for k in keys:
        if how == "right":
            key_cols.append(F.col(f"_r_{k}").alias(k))
        elif how == "outer":
            key_cols.append(F.coalesce(F.col(f"_l_{k}"), F.col(f"_r_{k}")).alias(k))
        else:
            key_cols.append(F.col(f"_l_{k}").alias(k))
    rest_left = [c for c in primary.columns if c not in keys]
    rest_right = [c if c not in primary.columns else f"{c}_secondary"
                  for c in secondary.columns if c not in keys]
    return j.select(*key_cols, *rest_left, *rest_right)


# ------------------------------------------------------------------ H10, H11
#: What a declared Python type accepts; types not listed accept anything.
_ACCEPTS = {str: T.StringType, int: NUMERIC, float: NUMERIC}


def validate_schema(df: DataFrame, expected: dict[str, type]) -> DataFrame:
    """Findings ``(code, column, declared, actual)`` from the schema
    alone (no scan): ``missing``, ``type`` and ``unexpected`` columns."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    findings = [
        *(("missing", c, t.__name__, None) for c, t in expected.items() if c not in actual),
        *(("type", c, t.__name__, actual[c].simpleString()) for c, t in expected.items()
          if c in actual and not isinstance(actual[c], _ACCEPTS.get(t, T.DataType))),
        *(("unexpected", c, None, actual[c].simpleString()) for c in sorted(actual.keys() - expected.keys())),
    ]
    return df.sparkSession.createDataFrame(
        findings, "code string, column string, declared string, actual string")


def data_quality(df: DataFrame) -> DataFrame:
    """H11 in long form ``(metric, column, value)``: total rows/columns,
    duplicate rows (extras only), per-column null count and percent (only
    where > 0), per numeric column distinct/min/max/mean/sample std."""
    numeric = numeric_columns(df)
    # distinct values of all columns and of the row, in one long form: a
    # partial aggregate by (column, value) and one shuffle for all of them
    cells = [F.struct(F.lit(c).alias("of"), (F.col(c) + F.lit(0).cast(df.schema[c].dataType)).cast("string").alias("value"))
             for c in numeric]
    whole = F.struct(F.lit("").alias("of"), F.concat_ws(
        " ", F.xxhash64(*df.columns), F.xxhash64(F.lit("second"), *[F.col(c) for c in df.columns])).alias("value"))
    counts = (df.select(F.explode(F.array(whole, *cells)).alias("c")).select("c.*").distinct()
              .groupBy("of").agg(F.count("value").alias("n")))
    counts = counts.agg(F.map_from_entries(F.collect_list(F.struct("of", "n"))).alias("distinct"))  # a row a column
    plain = [F.count("*").alias("rows")] + [F.count_if(F.col(c).isNull()).alias(f"nulls__{c}") for c in df.columns]
    for c in numeric:
        x = F.col(c).cast("double")
        plain += [F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}"), F.avg(x).alias(f"mean__{c}"),
                  F.stddev_samp(x).alias(f"std__{c}")]

    def row(metric: str, column: str | None, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"),
                        F.lit(column).cast("string").alias("column"),
                        value.cast("double").alias("value"))

    def distinct(c: str) -> Column:
        return F.coalesce(F.col("distinct")[F.lit(c)], F.lit(0))

    n = F.col("rows")
    rows = [row("total_rows", None, n), row("total_columns", None, F.lit(len(df.columns))),
            row("duplicate_rows", None, n - distinct(""))]
    for c in df.columns:
        rows.append(row("null_count", c, F.col(f"nulls__{c}")))
        rows.append(row("null_percent", c, F.try_divide(F.col(f"nulls__{c}") * 100.0, n)))
    for c in numeric:
        rows.append(row("nunique", c, distinct(c)))
        rows += [row(metric, c, F.col(f"{metric}__{c}")) for metric in ("min", "max", "mean", "std")]
    one = df.agg(*plain).withColumn("distinct", counts.scalar())
    out = one.select(F.inline(F.array(*rows)))
    return out.where(~(F.col("metric").isin("null_count", "null_percent")
                       & (F.col("value") <= 0)))


def profile_file(spark, path: str, schema=None, encoding: str = "UTF-8"):
    """A3 ingest → H11 quality → H3 statistics per numeric column.
    Returns ``(quality, statistics)``; callers that re-profile the same
    bytes can key a result table by ``sha2`` of the file content (G6)."""
    from corpusgraph.sources.sinks import csv_ingest
    df, _ = csv_ingest(spark, path, schema, encoding)
    stats = None
    for c in numeric_columns(df):
        s = statistics(df, c).select(F.lit(c).alias("column"), "*")
        stats = s if stats is None else stats.unionByName(s)
    return data_quality(df), stats
