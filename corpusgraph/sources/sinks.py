"""Sources and sinks around the analysis.

Writers are plain DataFrame writers (sharded, one file per partition).
Documents with arrays of any size are folders of numbered shards with a
manifest (``write_document``).  No array and no data row passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpusgraph.operators import tabular as tb
from corpusgraph.session import cut_lineage

GRAPH_FORMATS = ("edgelist", "json", "graphml", "gexf")
DEFAULT_NAME_PREFIX = "Community "
# path segments after which a short path starts
ROOT_SEGMENTS = ("src", "lib", "app", "packages")


# ------------------------------------------------------------------ A3, A4
def csv_ingest(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """A3: read a CSV (header), clean it (H1 + H2) and return it with a
    one-row history record ``(ingested_at, file, rows, columns)``."""
    reader = spark.read.option("header", "true").option("encoding", encoding)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    df = tb.clean(reader.csv(path))
    hist = df.agg(F.count("*").alias("rows")).select(
        F.current_timestamp().alias("ingested_at"), F.lit(path).alias("file"), "rows",
        F.lit(len(df.columns)).alias("columns"))
    return df, hist


def read_json(spark: SparkSession, path: str, schema=None, multiline: bool = True) -> DataFrame:
    """A4: JSON documents (multi-line by default)."""
    r = spark.read.option("multiLine", str(multiline).lower())
    return (r.schema(schema) if schema is not None else r).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A4: JSON lines, UTF-8."""
    df.write.mode(mode).option("encoding", "UTF-8").json(path)


# ------------------------------------------------------------------ A5
FIXED_SECTIONS = (0, 9)      # header and footer lines of the XML formats
BODY_SECTIONS = (1, 2, 3)


def graph_lines(nodes: DataFrame, edges: DataFrame, fmt: str) -> DataFrame:
    """A5: the graph as text lines of the chosen format (``line`` column,
    ``ord`` for the header/body/footer order).  Unknown format or empty
    graph → ValueError."""
    if fmt not in GRAPH_FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    if nodes.isEmpty():
        raise ValueError("graph is empty")
    spark = nodes.sparkSession
    n = nodes.select(F.col("node").cast("string").alias("node"))
    e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"),
                     F.coalesce(F.col("relationship") if "relationship" in edges.columns else F.lit(None),
                                F.lit("related")).alias("rel"),
                     (F.col("weight") if "weight" in edges.columns else F.lit(1.0)).alias("w"))
    if fmt == "edgelist":
        return e.select(F.lit(1).alias("ord"), F.concat_ws(" ", "src", "dst").alias("line"),
                        F.lit(0).alias("pos"))
    if fmt == "json":  # node-link form as JSON lines
        return (n.select(F.lit(1).alias("ord"), F.to_json(F.struct(F.lit("node").alias("kind"),
                                                                   F.col("node").alias("id"))).alias("line"))
                .unionByName(e.select(F.lit(2).alias("ord"), F.to_json(F.struct(
                    F.lit("link").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("target"),
                    F.col("rel").alias("relationship"), F.col("w").alias("weight"))).alias("line")))
                .withColumn("pos", F.lit(0)))
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"),
                                     '"', "&quot;")
    if fmt == "graphml":
        head = ['<?xml version="1.0" encoding="utf-8"?>',
                '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
                '<key id="d0" for="edge" attr.name="relationship" attr.type="string"/>',
                '<key id="d1" for="edge" attr.name="weight" attr.type="double"/>',
                '<graph edgedefault="undirected">']
        tail = ["</graph>", "</graphml>"]
        body_n = n.select(F.lit(1).alias("ord"), F.format_string('<node id="%s"/>', esc(F.col("node"))).alias("line"))
        body_e = e.select(F.lit(2).alias("ord"), F.format_string(
            '<edge source="%s" target="%s"><data key="d0">%s</data><data key="d1">%s</data></edge>',
            esc(F.col("src")), esc(F.col("dst")), esc(F.col("rel")), F.col("w").cast("string")).alias("line"))
    else:  # gexf
        head = ['<?xml version="1.0" encoding="utf-8"?>',
                '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">',
                '<graph defaultedgetype="undirected">', "<nodes>"]
        tail = ["</edges>", "</graph>", "</gexf>"]
        body_n = n.select(F.lit(1).alias("ord"), F.format_string('<node id="%s" label="%s"/>',
                                                                 esc(F.col("node")), esc(F.col("node"))).alias("line"))
        body_e = e.select(F.lit(3).alias("ord"), F.format_string(
            '<edge source="%s" target="%s" weight="%s"/>', esc(F.col("src")), esc(F.col("dst")),
            F.col("w").cast("string")).alias("line"))
        body_n = body_n.unionByName(spark.createDataFrame([(2, "</nodes><edges>")], "ord int, line string"))
    body = body_n.unionByName(body_e).withColumn("pos", F.lit(0))
    fixed = spark.createDataFrame([(o, line, k) for o, rows in ((0, head), (9, tail))
                                   for k, line in enumerate(rows)], "ord int, line string, pos int")
    return fixed.unionByName(body)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "edgelist") -> None:
    """A5: write the lines in several part files that concatenate in order
    header → nodes → edges → footer.  The sections are written one after the
    other as they are partitioned, a union without any shuffle or sort; only
    the few fixed lines are ordered, by position, in one task each."""
    lines = graph_lines(nodes, edges, fmt)
    out = None
    for section in sorted(FIXED_SECTIONS + BODY_SECTIONS):
        part = lines.where(F.col("ord") == section)
        if section in FIXED_SECTIONS:
            part = part.coalesce(1).sortWithinPartitions("pos")
        out = part if out is None else out.unionByName(part)
    out.select("line").write.mode("overwrite").text(path)


# ------------------------------------------------------------------ A6, A7, A9
#: Elements of a shard of a document's array.
SHARD_ROWS = 1_000_000


def _shard_number(file: str) -> tuple[int, int]:
    """A part file's task and its number among the task's files."""
    import re
    task, own = re.match(r"part-(\d+)-.*-c(\d+)", file).groups()
    return int(task), int(own)


def write_document(header: DataFrame, arrays: dict[str, DataFrame], path: str,
                   order: dict[str, list[str]] | None = None, formats: dict[str, str] | None = None,
                   shard_rows: int = SHARD_ROWS) -> None:
    """A document whose arrays may be larger than a task, as a folder: each
    array is a folder of numbered shards of at most ``shard_rows`` elements, one
    a line, in the order of its columns ``order`` over all shards, and ``manifest`` is one JSON line
    with the header's row (``header``) and, per array, its ``shards`` in order
    with their ``rows``.  An array in the format ``text`` has one column, the
    lines; the others are JSON.  The manifest comes last, so a folder without
    one is not finished.  The driver reads one row a shard."""
    spark = header.sparkSession
    listed = []
    for name, rows in arrays.items():
        at, kind = f"{path}/{name}", (formats or {}).get(name, "json")
        keys = (order or {}).get(name)
        rows = rows.orderBy(*keys) if keys else rows
        out = rows.select(rows.columns[0]) if kind == "text" else rows.select(
            F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
        out.write.mode("overwrite").option("maxRecordsPerFile", shard_rows).text(at)
        counts = {r["f"]: r["n"] for r in spark.read.schema("value string").text(at).groupBy(
            F.element_at(F.split(F.input_file_name(), "/"), -1).alias("f")).agg(F.count("*").alias("n")).collect()}
        listed.append((name, [(f"{name}/{f}", counts[f]) for f in sorted(counts, key=_shard_number)]))
    shards = spark.createDataFrame(listed, "name string, shards array<struct<file:string,rows:long>>").coalesce(1)
    one = shards.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("name", "shards"))).alias("arrays"))
    head = header.groupBy().agg(F.first(F.struct(*header.columns)).alias("header"))
    one.select(F.to_json(F.struct(head.scalar().alias("header"), "arrays"), {"ignoreNullFields": "false"}).alias(
        "value")).write.mode("overwrite").text(f"{path}/manifest")


def read_document(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The elements of a document's JSON array with ``shard``, their shard's
    number in the manifest; without a manifest the folder is not read."""
    manifest = spark.read.text(f"{path}/manifest").select(F.from_json(
        "value", "arrays map<string, array<struct<file:string,rows:long>>>")["arrays"][name].alias("s"))
    shards = manifest.select(F.posexplode("s").alias("shard", "s")).select(
        "shard", F.element_at(F.split("s.file", "/"), -1).alias("file"))
    lines = spark.read.schema("value string").text(f"{path}/{name}").select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.from_json("value", schema).alias("e"))
    return lines.join(shards, "file").select("shard", "e.*")


def write_results(summary: DataFrame, communities: DataFrame, path: str, order: list[str] | None = None,
                  stamp=None, shard_rows: int = SHARD_ROWS) -> None:
    """``{timestamp, analysis}`` with the communities as a sharded array."""
    stamp = stamp if stamp is not None else F.current_timestamp().cast("string")
    header = summary.select(stamp.alias("timestamp"), F.struct(*summary.columns).alias("analysis"))
    write_document(header, {"communities": communities}, path, {"communities": order or communities.columns[:1]},
                   shard_rows=shard_rows)


def write_descriptions(descriptions: DataFrame, path: str, order: list[str] | None = None, stamp=None,
                       shard_rows: int = SHARD_ROWS) -> None:
    """The descriptions, numbered from 1 by ``order``, as sharded JSON
    (``descriptions``) and Markdown (``report``, a title and one section each).
    A missing field reads ``N/A``; absent lists leave their part out."""
    order = order or ["community"]
    d = cut_lineage(number_rows(descriptions, order))
    have = set(descriptions.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")) if c in have else F.lit("N/A")
    lists = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")
    advice, tags = lists("refactor_suggestions"), lists("functional_tags")
    section = F.concat_ws(
        "\n", F.format_string("## %d. Community %s", F.col("number"), F.col("community").cast("string")), F.lit(""),
        F.concat(F.lit("**Functionality**: "), text("functionality")), F.lit(""),
        F.concat(F.lit("**Architecture pattern**: "), text("architecture_pattern")), F.lit(""),
        F.concat(F.lit("**Design quality**: "), text("design_quality"), F.lit("/10")), F.lit(""),
        F.when(F.size(advice) > 0, F.concat(F.lit("**Refactoring suggestions**:\n- "), F.array_join(advice, "\n- "), F.lit("\n"))),
        F.when(F.size(tags) > 0, F.concat(F.lit("**Tags**: "), F.array_join(tags, ", "), F.lit("\n"))), F.lit("---"), F.lit(""))
    n = d.agg(F.count("*")).scalar()
    stamp = stamp if stamp is not None else F.current_timestamp().cast("string")
    title = d.sparkSession.range(1).select(F.concat(
        F.lit("# Community descriptions\n\nGenerated: "), stamp, F.lit("\nCommunities: "), n.cast("string"),
        F.lit("\n")).alias("line"), F.lit(0).cast("long").alias("number"))
    report = title.unionByName(d.select(section.alias("line"), "number"))
    header = d.sparkSession.range(1).select(stamp.alias("timestamp"), n.alias("communities"))
    write_document(header, {"descriptions": d, "report": report}, path,
                   {"descriptions": ["number"], "report": ["number"]}, {"report": "text"}, shard_rows)


def report_sections(descriptions: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One Markdown section per community with a non-empty
    functionality, ordered by id (numerically when the id is digits); the
    title is ``name (id)`` unless the name is the default one."""
    d = descriptions.where(F.coalesce(F.length("functionality"), F.lit(0)) > 0)
    if names is not None:
        d = d.join(names.select("community", "name"), "community", "left")
    else:
        d = d.withColumn("name", F.lit(None).cast("string"))
    cid = F.col("community").cast("string")
    default = F.concat(F.lit(DEFAULT_NAME_PREFIX), cid)
    title = F.when(F.col("name").isNull() | (F.col("name") == default), default) \
        .otherwise(F.concat(F.col("name"), F.lit(" ("), cid, F.lit(")")))

    def listing(col):
        return F.when(F.size(F.coalesce(F.col(col), F.array())) == 0, F.lit("- (none)")) \
            .otherwise(F.concat(F.lit("- "), F.array_join(F.col(col), "\n- ")))
    text = F.concat_ws("\n", F.concat(F.lit("## "), title), F.lit(""),
                       F.concat(F.lit("**Functionality:** "), F.col("functionality")), F.lit(""),
                       F.lit("**Tags:**"), listing("functional_tags"), F.lit(""),
                       F.lit("**Suggestions:**"), listing("refactor_suggestions"), F.lit(""))
    order = F.coalesce(cid.try_cast("long"), F.lit(None))
    return d.select(order.alias("_num"), cid.alias("_id"), text.alias("section")) \
        .orderBy(F.col("_num").asc_nulls_last(), "_id").select("section")


def number_rows(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """1-based numbering in a global order without a single-task window.

    The data is range-partitioned and sorted; partition id and the position
    inside the partition are frozen in a written table (so a recomputed task
    cannot renumber); per-partition counts (one row per partition) give the
    offsets.  ``order_cols`` should be unique for a deterministic numbering.
    """
    mask = (1 << 33) - 1
    frozen = cut_lineage(df.orderBy(*order_cols)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(mask))))
    from pyspark.sql import Window
    counts = frozen.groupBy("_pid").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_off", F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))  # one row per partition
    return (frozen.join(offsets.select("_pid", F.coalesce("_off", F.lit(0)).alias("_off")), "_pid")
            .withColumn("number", F.col("_off") + F.col("_pos") + 1)
            .drop("_pid", "_pos", "_off"))


# ------------------------------------------------------------------ A8
def related_files(membership: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """``community, file``, one row for each distinct file of a community:
    the part before the first ``:`` of each node and each element's file path.
    ``write_document`` with order (community, file) writes them sorted."""
    files = membership.select("community", F.split("node", ":")[0].alias("file"))
    if elements is not None:
        files = files.unionByName(membership.join(elements.select("node", "file_path"), "node")
                                  .select("community", F.col("file_path").alias("file")))
    return files.where(F.col("file").isNotNull()).distinct()


def short_path(path) -> F.Column:
    """Cut at the first known root segment, else ``parent/file``."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    pos = F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)),
                                           lambda i: F.when(F.element_at(parts, i).isin(*ROOT_SEGMENTS), i)),
                               lambda x: x.isNotNull()))
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")
    return F.when(pos.isNotNull(), F.array_join(F.slice(parts, pos, F.size(parts)), "/")).otherwise(tail)


# ------------------------------------------------------------------ A10, A12
def export_entities(frames: dict[str, DataFrame], path: str, which: str = "all") -> None:
    """A10: rows of the chosen entity tables as JSON, partitioned by entity."""
    names = list(frames) if which == "all" else [which]
    unknown = [n for n in names if n not in frames]
    if unknown:
        raise ValueError(f"unknown entity {unknown}")
    out = None
    for n in names:
        part = frames[n].select(F.lit(n).alias("entity"), F.to_json(F.struct("*")).alias("record"))
        out = part if out is None else out.unionByName(part)
    out.write.mode("overwrite").partitionBy("entity").text(path)


def core_communities_from_json(spark: SparkSession, path: str, top: int = 10,
                               sample: int = 3) -> DataFrame:
    """``{total_core_communities, core_communities: map<id, {size,
    cohesion, coupling, nodes, total_nodes}>}`` → top communities by size
    with ``sample`` nodes each."""
    schema = ("total_core_communities int, core_communities map<string, struct<size:int, "
              "cohesion:double, coupling:double, nodes:array<string>, total_nodes:int>>")
    doc = spark.read.option("multiLine", "true").schema(schema).json(path)
    rows = doc.select(F.explode("core_communities").alias("id", "c")).select("id", "c.*")
    return (rows.orderBy(F.desc("size"), "id").limit(top)
            .withColumn("sample_nodes", F.slice("nodes", 1, sample)).drop("nodes"))


def project_summary_from_json(spark: SparkSession, path: str) -> DataFrame:
    """``project_summary.json`` → one row of project and graph figures."""
    schema = ("project_path string, analysis_time string, summary struct<total_files:int, "
              "total_classes:int, total_functions:int>, graph_info struct<nodes:int, edges:int, "
              "density:double, avg_degree:double>")
    doc = spark.read.option("multiLine", "true").schema(schema).json(path)
    return doc.select("project_path", "analysis_time", "summary.*", "graph_info.*")


def resolution_levels_from_json(spark: SparkSession, path: str, large: int = 5,
                                top: int = 5) -> tuple[DataFrame, DataFrame]:
    """A resolution hierarchy ``{resolution_<r>: {resolution,
    num_communities, modularity, statistics.community_details: {id: {size}}}}``
    → (levels: resolution, communities, modularity; large communities: per
    resolution the ``top`` communities with more than ``large`` nodes)."""
    schema = ("map<string, struct<resolution:double, num_communities:int, modularity:double, "
              "statistics:struct<community_details:map<string, struct<size:int>>>>>")
    raw = spark.read.option("multiLine", "true").text(path, wholetext=True)
    levels = raw.select(F.explode(F.from_json("value", schema)).alias("key", "v"))
    summary = levels.select("v.resolution", "v.num_communities", "v.modularity")
    from pyspark.sql import Window
    big = (levels.select("v.resolution", F.explode("v.statistics.community_details").alias("community", "d"))
           .select("resolution", "community", F.col("d.size").alias("size"))
           .where(F.col("size") > large))
    w = Window.partitionBy("resolution").orderBy(F.desc("size"), "community")
    return summary, big.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
