"""Entity and event operators of the bundled sample application.

Everything is grouped aggregates, joins and per-row expressions; "latest
version per key" uses ``max_by`` (a partial aggregate) rather than a ranking
window, so a key holding a third of all rows is not sorted in one task.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusgraph.operators import folds

# ---- fixed values: allowed order status transitions (from -> to) ---------
ORDER_TRANSITIONS = {
    "pending": ["active", "cancelled"],
    "active": ["completed", "failed", "cancelled"],
    "completed": [],
    "failed": ["pending"],
    "cancelled": [],
}
PUBLIC_PATH_PATTERNS = [r"^/api/auth/login$", r"^/api/auth/register$", r"^/api/health$",
                        r"^/api/docs"]
NOTIFICATION_TTL_DAYS = 30
# ---------------------------------------------------------------------------


def count_by(df: DataFrame, attribute: str) -> DataFrame:
    """Items per value; a list counts each element (an empty one counts
    nothing), a null, also as a list, counts as ``'None'``."""
    col = F.col(attribute)
    kind = df.schema[attribute].dataType
    if isinstance(kind, T.ArrayType):
        vals = df.select(F.explode(F.coalesce(
            col, F.array(F.lit(None).cast(kind.elementType)))).alias("value"))
    else:
        vals = df.select(col.alias("value"))
    return (vals.select(F.coalesce(F.col("value").cast("string"), F.lit("None")).alias("value"))
            .groupBy("value").agg(F.count("*").alias("count")))


def order_report(orders: DataFrame, status_col: str, amount_col: str,
                 completed: str) -> DataFrame:
    """I2 (orders): total, per status, revenue of completed orders, mean
    value of all orders (0 when none) as ``(metric, key, value)``."""
    one = orders.agg(
        F.count("*").cast("double").alias("total"),
        F.coalesce(F.sum(F.when(F.col(status_col) == completed, F.col(amount_col))),
                   F.lit(0.0)).alias("revenue"),
        F.coalesce(F.avg(amount_col), F.lit(0.0)).alias("mean_value"))
    head = one.select(F.inline(F.array(
        F.struct(F.lit("total_orders").alias("metric"), F.lit(None).cast("string").alias("key"),
                 F.col("total").alias("value")),
        F.struct(F.lit("revenue").alias("metric"), F.lit(None).cast("string").alias("key"),
                 F.col("revenue").alias("value")),
        F.struct(F.lit("mean_order_value").alias("metric"), F.lit(None).cast("string").alias("key"),
                 F.col("mean_value").alias("value")))))
    by = (orders.groupBy(status_col).agg(F.count("*").cast("double").alias("value"))
          .select(F.lit("orders_by_status").alias("metric"),
                  F.col(status_col).cast("string").alias("key"), "value"))
    return head.unionByName(by)


def find_by_criteria(df: DataFrame, criteria: Mapping[str, object]) -> DataFrame:
    """Every equality must hold (null-safe); unknown attribute → none."""
    conds = [F.col(k).eqNullSafe(F.lit(v)) if k in df.columns else F.lit(False)
             for k, v in criteria.items()]
    return df.where(functools.reduce(lambda a, b: a & b, conds, F.lit(True)))


def list_filter(df: DataFrame, *, equals: Mapping[str, object] | None = None,
                min_value: tuple[str, float] | None = None,
                max_value: tuple[str, float] | None = None,
                contains: tuple[str, object] | None = None) -> DataFrame:
    """I4: equality filters, inclusive min/max, array membership."""
    out = df
    for k, v in (equals or {}).items():
        out = out.where(F.col(k) == F.lit(v))
    if min_value:
        out = out.where(F.col(min_value[0]) >= min_value[1])
    if max_value:
        out = out.where(F.col(max_value[0]) <= max_value[1])
    if contains:
        out = out.where(F.array_contains(F.col(contains[0]), contains[1]))
    return out


def page(df: DataFrame, sort_by: str | None, descending: bool, page_no: int, per_page: int,
         tie_break: str) -> DataFrame:
    """Sort (known key) with a unique tie-break, slice a page, attach
    ``total`` and ``pages`` = ceil(total / per_page)."""
    total = df.agg(F.count("*")).scalar()
    ordered = df
    if sort_by is not None:
        key = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
        ordered = df.orderBy(key, F.col(tie_break).asc())
    else:
        ordered = df.orderBy(F.col(tie_break).asc())
    return (ordered.offset((page_no - 1) * per_page).limit(per_page)
            .withColumn("total", total)
            .withColumn("pages", F.ceil(total / F.lit(per_page)).cast("long")))


def order_totals(lines: DataFrame, order_col: str, qty_col: str, subtotal: Column) -> DataFrame:
    """total = Σ subtotal, item_count = Σ quantity, per order (long
    form; removing a line is removing its row)."""
    return (lines.groupBy(order_col)
            .agg(F.sum(subtotal).alias("total"), F.sum(qty_col).alias("item_count"),
                 F.count("*").alias("lines")))


def apply_transitions(events: DataFrame, key: str, order_col: str, status_col: str,
                      initial: str = "pending") -> DataFrame:
    """I8: fold status requests by (order, status); an illegal move is
    rejected and the state stays.  Returns ``key, final_status, accepted,
    rejected``.  A key's requests are cut into blocks over many tasks; what a
    block does to every state is composed along the key."""
    return folds.transitions(events, key, order_col, status_col, ORDER_TRANSITIONS, initial)


def due_flags(df: DataFrame, due_col: str, as_of, done: Column | None = None) -> DataFrame:
    """overdue = as_of > due and not done (null-safe, false when unknown)."""
    late = F.coalesce(F.lit(as_of).cast("timestamp_ntz") > F.col(due_col), F.lit(False))
    if done is not None:
        late = late & ~F.coalesce(done, F.lit(False))
    return df.withColumn("is_overdue", late)


def purge_expired(df: DataFrame, expires_col: str, as_of) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row count of purged rows)."""
    expired = F.coalesce(F.lit(as_of).cast("timestamp_ntz") > F.col(expires_col), F.lit(False))
    return df.where(~expired), df.agg(F.count_if(expired).alias("purged"))


def latest_per_key(changes: DataFrame, key: str, version_col: str,
                   deleted_col: str | None = None) -> DataFrame:
    """Latest version per key (max_by over a struct — partial
    aggregation); tombstoned keys are removed."""
    others = [c for c in changes.columns if c != key]
    latest = (changes.groupBy(key)
              .agg(F.max_by(F.struct(*others), F.col(version_col)).alias("r"))
              .select(key, "r.*"))
    if deleted_col:
        latest = latest.where(~F.coalesce(F.col(deleted_col), F.lit(False))).drop(deleted_col)
    return latest


def integrity_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str,
                         rule: str, id_col: str) -> DataFrame:
    """Children whose reference has no parent (anti join)."""
    return (child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
            .select(F.lit(rule).alias("rule"), F.col(id_col).cast("string").alias("id")))


def duplicate_values(df: DataFrame, col: str, rule: str) -> DataFrame:
    """Values that must be unique but occur more than once."""
    return (df.groupBy(col).agg(F.count("*").alias("n")).where("n > 1")
            .select(F.lit(rule).alias("rule"), F.col(col).cast("string").alias("id")))


def rate_limit(requests: DataFrame, client: str, ts: str, max_requests: int,
               window_seconds: int) -> DataFrame:
    """I14 (batch): per client, a request is accepted while fewer than
    ``max_requests`` *accepted* requests lie in (t − W, t]; rejections do
    not count.  A client's requests are cut into blocks over many tasks, which
    run again until every block starts where its predecessor ends."""
    return folds.rate_limit(requests, client, ts, max_requests, window_seconds)


def public_path(path) -> Column:
    """Any of the anchored public patterns."""
    p = F.col(path) if isinstance(path, str) else path
    return functools.reduce(lambda a, b: a | b, [p.rlike(x) for x in PUBLIC_PATH_PATTERNS])


def route_regex(template: str) -> str:
    """I16: ``{name}`` matches exactly one path segment; anchored."""
    import re
    parts = re.split(r"(\{[^}/]+\})", template)
    return "^" + "".join("[^/]+" if p.startswith("{") else re.escape(p) for p in parts) + "$"


def notifications(events: DataFrame, user_col: str, kind: str, at_col: str) -> DataFrame:
    """One notification per event, expiring 30 days later."""
    return events.select(F.col(user_col).alias("recipient_id"), F.lit(kind).alias("type"),
                         F.col(at_col).alias("created_at"),
                         (F.col(at_col) + F.expr(f"INTERVAL {NOTIFICATION_TTL_DAYS} DAYS"))
                         .alias("expires_at"))


# ------------------------------------------------------------------ I15
def asof_lookup(reads: DataFrame, writes: DataFrame, key: str, ts: str, value: str,
                ttl_seconds: int | None = None) -> DataFrame:
    """I15 as-of join: for every read, the latest write with time <= read
    time for the same key; ``valid`` when read time <= write time + ttl.

    Reads and writes are range-partitioned by (key, time), so any key, and
    any second of a key, is split evenly; the last write is carried forward
    inside a partition and by one row per partition from each to the next."""
    out = folds.carried(reads, writes, key, ts, value)
    if ttl_seconds is not None:
        ok = F.col(ts) <= F.col("written_at") + F.expr(f"INTERVAL {ttl_seconds} SECONDS")
        out = out.withColumn("valid", F.coalesce(ok, F.lit(False)))
    return out


# ------------------------------------------------------------------ I7, I9
def allocate_stock(lines: DataFrame, stock: DataFrame, product: str, order_col: str,
                   qty: str, initial: str) -> DataFrame:
    """Per product, lines by (order, quantity) take stock while enough is
    left; a rejected line consumes nothing.  ``(product, order, qty,
    allocated, stock_left, is_available)``.  A product's lines are cut into
    blocks over many tasks; the stock left passes over blocks by their sums."""
    return folds.allocate(lines, stock, product, order_col, qty, initial)


def task_progress(tasks: DataFrame, id_col: str = "id", parent_col: str = "parent_id",
                  status_col: str = "status", done: str = "completed") -> DataFrame:
    """Percentage of completed subtasks; without subtasks 100 or 0 by
    the task's own status."""
    sub = (tasks.where(F.col(parent_col).isNotNull())
           .groupBy(F.col(parent_col).alias(id_col))
           .agg(F.avg(F.when(F.col(status_col) == done, 100.0).otherwise(0.0)).alias("_p")))
    own = F.when(F.col(status_col) == done, 100.0).otherwise(0.0)
    return tasks.join(sub, id_col, "left").withColumn("progress", F.coalesce("_p", own)).drop("_p")


# ------------------------------------------------------------------ I17, I18
def validate_rules(df: DataFrame, rules: list[tuple[str, Column]], id_col: str) -> DataFrame:
    """Every failing rule (a boolean Column that must hold) gives one
    ``(id, rule)`` row; null counts as failing."""
    fails = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]),
                     lambda x: x.isNotNull())
    return df.select(id_col, F.explode(fails).alias("rule"))


def add_if_absent(arr, value) -> Column:
    """add/has/remove on array attributes (roles, tags, dependencies)."""
    a = F.coalesce(F.col(arr) if isinstance(arr, str) else arr, F.array().cast("array<string>"))
    return F.when(F.array_contains(a, value), a).otherwise(F.concat(a, F.array(F.lit(value))))


def remove_value(arr, value) -> Column:
    return F.array_remove(F.col(arr) if isinstance(arr, str) else arr, value)


def merge_maps(left, right) -> Column:
    """Merge preferences, right-side keys win."""
    lc = F.col(left) if isinstance(left, str) else left
    rc = F.col(right) if isinstance(right, str) else right
    return F.map_zip_with(lc, rc, lambda k, a, b: F.coalesce(b, a))


# ------------------------------------------------------------------ I20, I22
def serialize(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One JSON text per row; timestamps ISO-8601, nested records kept."""
    chosen = cols or df.columns
    return df.select(F.to_json(F.struct(*chosen), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                                                   "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
                     .alias("json"))


def partial_update(base: DataFrame, patches: DataFrame, actors: DataFrame, id_col: str,
                   owner_col: str, fields: list[str], admin_only: tuple[str, ...] = ("is_active",)) -> DataFrame:
    """Patches ``(id, actor_id, <fields>…)`` (null = not supplied) are
    applied when the actor owns the row or is an admin; admin-only fields
    change only for admins.  Every patch yields accepted/rejected + reason."""
    p = patches.alias("p")
    j = (p.join(base.alias("b"), F.col(f"p.{id_col}") == F.col(f"b.{id_col}"), "left")
         .join(actors.select(F.col("id").alias("_aid"), F.col("is_admin").alias("_adm")).alias("a"),
               F.col("p.actor_id") == F.col("a._aid"), "left"))
    admin = F.coalesce(F.col("_adm"), F.lit(False))
    owner = F.col(f"b.{owner_col}") == F.col("p.actor_id")
    missing = F.col(f"b.{id_col}").isNull()
    allowed = ~missing & (owner | admin)
    cols = []
    for f in fields:
        new = F.coalesce(F.col(f"p.{f}"), F.col(f"b.{f}"))
        if f in admin_only:
            new = F.when(admin, new).otherwise(F.col(f"b.{f}"))
        cols.append(F.when(allowed, new).otherwise(F.col(f"b.{f}")).alias(f))
    reason = F.when(missing, "not_found").when(~(owner | admin), "forbidden").otherwise(F.lit(None))
    return j.select(F.col(f"p.{id_col}").alias(id_col), *cols, allowed.alias("accepted"),
                    reason.alias("reason"))


def match_routes(requests: DataFrame, routes: list[tuple[str, str]], path_col: str = "path",
                 method_col: str = "method") -> DataFrame:
    """I16: ``routes`` = ordered ``(method, template)``; ``{name}`` matches
    one path segment, anchored.  First registered match wins; no path match
    → 404, path matches but not the method → 405.  The table is compiled
    into one CASE expression (no join against the route list)."""
    p, m = F.col(path_col), F.col(method_col)
    route = None
    path_hit = None
    for i, (method, tmpl) in enumerate(routes):
        rx = route_regex(tmpl)
        hit = p.rlike(rx) & (m == method)
        route = F.when(hit, F.lit(i)) if route is None else route.when(hit, F.lit(i))
        ph = p.rlike(rx)
        path_hit = ph if path_hit is None else path_hit | ph
    return requests.withColumn("route", route).withColumn(
        "status", F.when(F.col("route").isNotNull(), 200).when(path_hit, 405).otherwise(404))


def breakdown_report(df: DataFrame, report: str, dims: list[str],
                     measures: dict[str, str]) -> DataFrame:
    """Totals and per-dimension breakdowns in one pass — a single
    ``GROUPING SETS`` aggregate (grand total + one set per dimension),
    unpivoted to ``(report, dimension, key, metric, value)``.  ``measures``
    maps metric names to SQL aggregate expressions."""
    import uuid
    spark = df.sparkSession
    name = f"cg_report_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    sets = ", ".join(["()"] + [f"({d})" for d in dims])
    meas = ", ".join(f"CAST({expr} AS DOUBLE) AS `{k}`" for k, expr in measures.items())
    dim_sel = ", ".join(f"CAST({d} AS STRING) AS `{d}`, grouping({d}) AS `g_{d}`" for d in dims)
    agg = spark.sql(f"SELECT {dim_sel}, {meas} FROM {name} GROUP BY GROUPING SETS ({sets})")
    spark.catalog.dropTempView(name)  # the analysed plan no longer needs the name
    which = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dims], F.lit(None).cast("string"))
    key = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.coalesce(F.col(d), F.lit("None"))) for d in dims],
                     F.lit(None).cast("string"))
    stacked = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("value")) for k in measures])
    return agg.select(F.lit(report).alias("report"), which.alias("dimension"), key.alias("key"),
                      F.inline(stacked))
