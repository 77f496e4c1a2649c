"""Describing communities without a remote model.

Input: ``membership(node, community)`` where ``node`` is a readable
identifier, plus the E-details table (cohesion, coupling, size).  Tags and
patterns are per-node flags reduced by ``max``/``collect_set`` per
community — bounded by the number of tag classes, never by community size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# ---- fixed values: tag classes and their lower-case substrings ----------
TAG_PATTERNS = [
    ("test", ["test_", "_test", "tests/"]),
    ("config", ["config", "settings", "env"]),
    ("api", ["api", "endpoint", "service"]),
    ("model", ["model", "entity", "schema"]),
    ("util", ["util", "helper", "common"]),
    ("ui", ["ui", "view", "component"]),
    ("core", ["core", "base", "main"]),
]
# architecture pattern: first substring found wins, in this order
PATTERN_ORDER = [("test", "testing"), ("api", "api_layer"), ("model", "data_model"),
                 ("service", "service_layer")]
DEFAULT_PATTERN = "functional_module"
SUGGEST_COHESION_BELOW = 0.3
SUGGEST_COUPLING_ABOVE = 0.3
DIGEST_NODES = 20
# --------------------------------------------------------------------------


def _any_contains(c: Column, needles: list[str]) -> Column:
    out = None
    for n in needles:
        x = c.contains(n)
        out = x if out is None else out | x
    return out


def functional_tags(membership: DataFrame) -> DataFrame:
    """sorted tag set per community; ``['general']`` when none match."""
    low = F.lower(F.col("node"))
    tags = F.filter(F.array(*[F.when(_any_contains(low, pats), F.lit(t)) for t, pats in TAG_PATTERNS]),
                    lambda x: x.isNotNull())
    per = (membership.select("community", F.explode(tags).alias("tag"))
           .groupBy("community").agg(F.sort_array(F.collect_set("tag")).alias("tags")))
    comms = membership.select("community").distinct()
    return (comms.join(per, "community", "left")
            .select("community", F.coalesce("tags", F.array(F.lit("general"))).alias("functional_tags")))


def architecture_pattern(membership: DataFrame) -> DataFrame:
    """first of test / api / model / service present in any node."""
    low = F.lower(F.col("node"))
    flags = membership.groupBy("community").agg(
        *[F.max(low.contains(s).cast("int")).alias(f"has_{s}") for s, _ in PATTERN_ORDER])
    expr = None
    for s, name in PATTERN_ORDER:
        cond = F.col(f"has_{s}") == 1
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return flags.select("community", expr.otherwise(DEFAULT_PATTERN).alias("architecture_pattern"))


def design_quality(cohesion, coupling) -> Column:
    """clamp(truncate(10·cohesion − 20·coupling + 5), 1, 10)."""
    raw = (F.col(cohesion) * 10 - F.col(coupling) * 20 + 5).cast("int")  # truncates toward 0
    return F.greatest(F.lit(1), F.least(F.lit(10), raw))


def suggestions(cohesion, coupling) -> Column:
    """suggestion codes (cohesion < 0.3, coupling > 0.3, else keep)."""
    s = F.filter(F.array(F.when(F.col(cohesion) < SUGGEST_COHESION_BELOW, F.lit("raise_cohesion")),
                         F.when(F.col(coupling) > SUGGEST_COUPLING_ABOVE, F.lit("lower_coupling"))),
                 lambda x: x.isNotNull())
    return F.when(F.size(s) == 0, F.array(F.lit("keep_design"))).otherwise(s)


def size_name(size) -> Column:
    """large (>= 20), medium (>= 10), small."""
    return (F.when(F.col(size) >= 20, "large").when(F.col(size) >= 10, "medium")
            .otherwise("small"))


def member_digest(membership: DataFrame, k: int = DIGEST_NODES) -> DataFrame:
    """first ``k`` nodes (sorted) joined, then ``… and N more``.
    ``row_number() <= k`` is planned as a window group limit (partial
    top-k before the shuffle)."""
    w = Window.partitionBy("community").orderBy("node")
    head = (membership.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
            .groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("first")))
    sizes = membership.groupBy("community").agg(F.count("*").alias("n"))
    return head.join(sizes, "community").select(
        "community",
        F.concat(F.array_join("first", ", "),
                 F.when(F.col("n") > k, F.format_string(" ... and %d more", F.col("n") - k))
                 .otherwise(F.lit(""))).alias("digest"))


def basic_descriptions(membership: DataFrame, details: DataFrame) -> DataFrame:
    """one record per community from F1–F4 (+ F14 name by size)."""
    return (details.select("community", "size", "cohesion", "coupling")
            .join(functional_tags(membership), "community")
            .join(architecture_pattern(membership), "community")
            .select("community", "size", "functional_tags", "architecture_pattern",
                    design_quality("cohesion", "coupling").alias("design_quality"),
                    suggestions("cohesion", "coupling").alias("refactor_suggestions"),
                    F.array().cast("array<string>").alias("external_dependencies"),
                    size_name("size").alias("size_name")))


def prompt_text(digest_col: str = "digest", size_col: str = "size", cohesion_col: str = "cohesion",
                coupling_col: str = "coupling") -> Column:
    """one request text per community (our own wording) from its
    digest (F18) and metrics; element content is cut at 2000 characters by
    the caller's digest."""
    return F.format_string(
        "Describe this code community of %d members (cohesion %.3f, coupling %.3f). "
        "Members: %s. Answer as JSON with functionality, architecture_pattern, "
        "design_quality, refactor_suggestions, functional_tags, external_dependencies.",
        F.col(size_col), F.col(cohesion_col), F.col(coupling_col), F.col(digest_col))


ELEMENT_CHARS = 2000   # fixed value: so much of an element's code is sent


def element_prompt(code, chars: int = ELEMENT_CHARS) -> Column:
    """one request text per element (our own wording) with the first
    ``chars`` characters of its code; null code is empty."""
    return F.concat(
        F.lit("Analyse this code and answer as JSON with functionality, complexity (1-10), quality (1-10), "
              "suggestions, tags, dependencies.\n\n"),
        F.left(F.coalesce(F.col(code) if isinstance(code, str) else code, F.lit("")), F.lit(chars)))


def naming_prompt(context: DataFrame, sizes: DataFrame) -> DataFrame:
    """``community, prompt``, one naming request per community (our own
    wording) from its size and the samples of ``naming.context_sample``."""
    def listing(c: str) -> Column:
        return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")

    j = sizes.select("community", "size").join(context, "community", "left")
    return j.select("community", F.concat(
        F.lit("Name this code community in two to six words by what it does.\nId: "), F.col("community").cast("string"),
        F.lit("\nMembers: "), F.col("size").cast("string"), F.lit("\nFiles: "), listing("files"),
        F.lit("\nFunctions: "), listing("functions"), F.lit("\nClasses: "), listing("classes"),
        F.lit("\nAnswer with the name alone.")).alias("prompt"))
