"""Scalar column functions (J1–J16) as native Column expressions — no UDFs,
so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# ---- fixed values (must equal the sample library's for equal results) ----
FILENAME_INVALID_CHARS = '<>:"/\\|?*'
FILENAME_MAX_LENGTH = 255
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
DATE_FORMATS = [  # tried in this order (strptime notation → Spark pattern)
    ("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"),
    ("%Y-%m-%d", "yyyy-MM-dd"),
    ("%Y/%m/%d", "yyyy/MM/dd"),
    ("%d/%m/%Y", "dd/MM/yyyy"),
    ("%d-%m-%Y", "dd-MM-yyyy"),
    ("%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss"),
    ("%Y-%m-%dT%H:%M:%SZ", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    ("%Y-%m-%dT%H:%M:%S.%fZ", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
]
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]  # then PB
SKU_DEFAULT_PREFIX = "PRD"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def camel_to_snake(name) -> Column:
    """Two regex passes, then lower case."""
    s1 = F.regexp_replace(_c(name), r"(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(s1, r"([a-z0-9])([A-Z])", "$1_$2"))


def title_case(s) -> Column:
    """Python ``str.title``: upper-case the first letter of every run of
    letters, lower-case the rest (``initcap`` only looks at spaces)."""
    runs = F.regexp_extract_all(_c(s), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(
        r.rlike(r"^\p{L}"), F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30))))
        .otherwise(r)), "")


def snake_to_camel(name, capitalize_first: bool = True) -> Column:
    """Split on ``_``, title-case the parts (the first one too, or not)."""
    parts = F.split(_c(name), "_", -1)
    titled = F.transform(parts, lambda p: title_case(p))
    if capitalize_first:
        return F.array_join(titled, "")
    return F.concat(F.element_at(parts, 1), F.array_join(F.slice(titled, 2, 1 << 30), ""))


def truncate(text, max_length: int, suffix: str = "...") -> Column:
    """The suffix counts towards the length."""
    t = _c(text)
    return F.when(F.length(t) <= max_length, t).otherwise(
        F.concat(F.substring(t, 1, max(max_length - len(suffix), 0)), F.lit(suffix)))


def sanitize_filename(name) -> Column:
    """Invalid characters → ``_``, strip dots/spaces, cap the length at
    255 keeping the extension."""
    s = F.btrim(F.translate(_c(name), FILENAME_INVALID_CHARS, "_" * len(FILENAME_INVALID_CHARS)),
                F.lit(". "))
    ext = F.regexp_extract(s, r"(\.[^.]*)$", 1)
    stem = F.regexp_replace(s, r"\.[^.]*$", "")
    return F.when(F.length(s) > FILENAME_MAX_LENGTH,
                  F.concat(F.left(stem, F.lit(FILENAME_MAX_LENGTH) - F.length(ext)), ext)
                  ).otherwise(s)


def is_valid_email(s) -> Column:
    """J5."""
    return F.coalesce(_c(s).rlike(EMAIL_PATTERN), F.lit(False))


def url_parts(url) -> tuple[Column, Column]:
    """(scheme, netloc) as a URL splitter reads them."""
    u = _c(url)
    scheme = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    netloc = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return scheme, netloc


def is_valid_url(url) -> Column:
    """Scheme and network location both present."""
    scheme, netloc = url_parts(url)
    return F.coalesce((scheme != "") & (netloc != ""), F.lit(False))


def parse_datetime(s) -> Column:
    """First format that parses, else null."""
    return F.coalesce(*[F.try_to_timestamp(_c(s), F.lit(p)) for _, p in DATE_FORMATS])


def format_bytes(size) -> Column:
    """1024 steps, one decimal, half-even (sizes over powers of two are
    exact binary fractions, so this equals Python's ``%.1f``)."""
    x = _c(size).cast("double")
    expr = None
    for i, unit in enumerate(BYTE_UNITS + ["PB"]):
        v = x / float(1024 ** i)
        txt = F.concat(F.format_string("%.1f", F.bround(v, 1)), F.lit(f" {unit}"))
        cond = v < 1024.0 if unit != "PB" else F.lit(True)
        expr = F.when(cond, txt) if expr is None else expr.when(cond, txt)
    return expr


def chunk(arr, size: int) -> Column:
    """Consecutive slices of ``size`` elements (empty list → empty).

    Pass a column, not an expensive array expression: the array is read
    inside a lambda, where an inlined expression is evaluated per element."""
    a = _c(arr)
    n = F.ceil(F.size(a) / size).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                                lambda i: i < n),
                       lambda i: F.slice(a, i * size + 1, size))


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct fields become top-level ``a.b.c`` columns."""
    def walk(schema: T.StructType, prefix: list[str]):
        for f in schema.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path)
            else:
                yield F.col("`" + "`.`".join(path) + "`").alias(sep.join(path))
    return df.select(list(walk(df.schema, [])))


def deep_merge(left, right, dtype: T.StructType) -> Column:
    """Right wins; nested structs merge field by field; maps merge
    with right-side keys winning."""
    out = []
    for f in dtype.fields:
        lf, rf = _c(left)[f.name], _c(right)[f.name]
        if isinstance(f.dataType, T.StructType):
            out.append(deep_merge(lf, rf, f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.MapType):
            out.append(F.map_zip_with(F.coalesce(lf, F.create_map().cast(f.dataType)),
                                      F.coalesce(rf, F.create_map().cast(f.dataType)),
                                      lambda k, a, b: F.coalesce(b, a)).alias(f.name))
        else:
            out.append(F.coalesce(rf, lf).alias(f.name))
    return F.struct(*out)


def make_id(prefix: str = "", key=None, length: int = 8) -> Column:
    """``prefix_timestamp_random``; with ``key`` the random part is a
    hash of the key (deterministic)."""
    ts = F.date_format(F.current_timestamp(), "yyyyMMddHHmmss")
    rnd = F.left(F.sha2(F.expr("uuid()") if key is None else _c(key).cast("string"), 256),
                 F.lit(length))
    parts = [ts, rnd] if not prefix else [F.lit(prefix), ts, rnd]
    return F.concat_ws("_", *parts)


def safe_divide(a, b, default: float = 0.0) -> Column:
    """J13."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(default))


def clamp(x, lo, hi) -> Column:
    """J14 (null stays null: least/greatest would skip it)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def sku(category, ident) -> Column:
    """First three letters of the category upper-cased (or the default
    prefix), a dash, the first eight id characters upper-cased."""
    cat = _c(category)
    prefix = F.when(F.coalesce(cat, F.lit("")) == "", F.lit(SKU_DEFAULT_PREFIX)) \
        .otherwise(F.upper(F.left(cat, F.lit(3))))
    return F.concat(prefix, F.lit("-"), F.upper(F.left(_c(ident).cast("string"), F.lit(8))))


def display_name(full_name, username) -> Column:
    """Full name unless empty, else the user name."""
    return F.coalesce(F.nullif(_c(full_name), F.lit("")), _c(username))


def price_text(currency, price) -> Column:
    """``CUR 0.00``."""
    return F.format_string("%s %.2f", _c(currency), _c(price))
