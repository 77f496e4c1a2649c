"""Sinks and file sources (A3–A10, A12) on small fixtures."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from corpusgraph.sources import sinks as sk


def scratch():
    return tempfile.mkdtemp(prefix="cg-sink-")


def test_export_graph_formats(spark, path_graph):
    nodes, edges = path_graph
    d = scratch()
    sk.export_graph(nodes, edges, f"{d}/el", "edgelist")
    lines = sorted(r["value"] for r in spark.read.text(f"{d}/el").collect())
    assert lines[0] == "A B" and len(lines) == 7
    sk.export_graph(nodes, edges, f"{d}/gx", "graphml")
    parts = sorted(f for f in os.listdir(f"{d}/gx") if f.startswith("part-"))  # they concatenate in this order
    txt = "".join(open(f"{d}/gx/{f}", encoding="utf-8").read() for f in parts).splitlines()
    assert txt[0].startswith("<?xml") and txt[-1] == "</graphml>" and sum("<edge " in t for t in txt) == 7
    js = [json.loads(r["line"]) for r in sk.graph_lines(nodes, edges, "json").collect()]
    assert sum(x["kind"] == "link" for x in js) == 7
    import pytest
    with pytest.raises(ValueError):
        sk.graph_lines(nodes, edges, "dot")
    with pytest.raises(ValueError):
        sk.graph_lines(spark.createDataFrame([], "node string"), edges, "edgelist")


def test_export_splits_nodes_and_edges_over_part_files(spark):
    nodes = spark.range(20_000).selectExpr("cast(id as string) node")
    edges = spark.range(50_000).selectExpr("cast(id % 20000 as string) src", "cast(id % 19997 as string) dst")
    d = scratch()
    sk.export_graph(nodes, edges, f"{d}/gexf", "gexf")
    parts = sorted(f for f in os.listdir(f"{d}/gexf") if f.startswith("part-"))
    texts = [open(f"{d}/gexf/{f}", encoding="utf-8").read() for f in parts]
    assert sum("<node " in t for t in texts) > 1 and sum("<edge " in t for t in texts) > 1
    import xml.etree.ElementTree as ET
    root = ET.fromstring("".join(texts).encode())
    assert len(list(root.iter())) > 70_000


def test_report_sections_order_and_titles(spark):
    desc = spark.createDataFrame(
        [("10", "does ten", ["api"], []), ("2", "does two", [], ["split"]), ("x", "", [], [])],
        "community string, functionality string, functional_tags array<string>, "
        "refactor_suggestions array<string>")
    names = spark.createDataFrame([("2", "Parser Module"), ("10", "Community 10")], "community string, name string")
    secs = [r["section"] for r in sk.report_sections(desc, names).collect()]
    assert secs[0].startswith("## Parser Module (2)") and secs[1].startswith("## Community 10")
    assert "- (none)" in secs[0] and len(secs) == 2


def test_results_document_and_entities(spark):
    summ = spark.createDataFrame([(5, 10, 20)], "total_files int, total_classes int, total_functions int")
    comm = spark.range(5000).selectExpr("(id * 7919) % 5000 as community", "0.5D as modularity", "cast(null as string) name")
    d = scratch()
    sk.write_results(summ, comm, f"{d}/res", stamp=F.lit("t0"), shard_rows=700)
    doc = json.loads(spark.read.text(f"{d}/res/manifest").first()["value"])
    assert doc["header"] == {"timestamp": "t0", "analysis": {"total_files": 5, "total_classes": 10, "total_functions": 20}}
    shards = doc["arrays"]["communities"]
    assert len(shards) > 1 and sum(x["rows"] for x in shards) == 5000
    lines = [line for x in shards for line in open(f"{d}/res/{x['file']}", encoding="utf-8")]
    assert [json.loads(x)["community"] for x in lines] == list(range(5000))
    back = sk.read_document(spark, f"{d}/res", "communities", "community long, modularity double, name string")
    assert back.agg(F.count("*"), F.sum("community"), F.max("shard")).first() == (5000, 5000 * 4999 // 2, len(shards) - 1)
    sk.write_results(summ, comm.limit(0), f"{d}/none")
    assert json.loads(spark.read.text(f"{d}/none/manifest").first()["value"])["arrays"] == {"communities": []}
    sk.export_entities({"users": spark.createDataFrame([(1, "a")], "id int, name string"),
                        "tasks": spark.createDataFrame([(7,)], "id int")}, f"{d}/out")
    assert {"entity=tasks", "entity=users"} <= set(os.listdir(f"{d}/out"))
    back = spark.read.text(f"{d}/out").where("entity = 'users'").first()
    assert json.loads(back["value"]) == {"id": 1, "name": "a"}


def test_core_communities_json_and_csv(spark):
    d = scratch()
    doc = {"total_core_communities": 3, "core_communities": {
        "0": {"size": 26, "cohesion": 0.08, "coupling": 0.02, "nodes": ["a", "b", "c", "d"], "total_nodes": 26},
        "3": {"size": 10, "cohesion": 1.0, "coupling": 0.0, "nodes": ["x"], "total_nodes": 10},
        "7": {"size": 30, "cohesion": 0.1, "coupling": 0.5, "nodes": ["p", "q"], "total_nodes": 30}}}
    with open(f"{d}/core.json", "w") as fh:
        json.dump(doc, fh, indent=2)
    top = sk.core_communities_from_json(spark, f"{d}/core.json", top=2).collect()
    assert [r["id"] for r in top] == ["7", "0"] and top[1]["sample_nodes"] == ["a", "b", "c"]
    with open(f"{d}/t.csv", "w") as fh:
        fh.write("k,x\na,1\na,1\nb,\n")
    df, hist = sk.csv_ingest(spark, f"{d}/t.csv")
    rows = sorted(map(tuple, df.collect()))
    assert rows == [("a", 1.0), ("b", 1.0)] and hist.first()["rows"] == 2


def test_related_files_short_path(spark):
    memb = spark.createDataFrame([("pkg/src/a.py:f", 1), ("pkg/src/a.py:g", 1), ("b.py:h", 1)],
                                 "node string, community int")
    assert sorted(map(tuple, sk.related_files(memb).collect())) == [(1, "b.py"), (1, "pkg/src/a.py")]
    el = spark.createDataFrame([("b.py:h", "other.py"), ("b.py:h", None)], "node string, file_path string")
    assert sk.related_files(memb, el).where("file = 'other.py'").count() == 1
    hot = spark.range(20_000).selectExpr("concat('f', id, '.py:x') node", "1 community")
    d = scratch()
    sk.write_document(spark.range(1), {"files": sk.related_files(hot)}, f"{d}/f", {"files": ["community", "file"]}, shard_rows=3000)
    shards = json.loads(spark.read.text(f"{d}/f/manifest").first()["value"])["arrays"]["files"]
    got = [json.loads(line)["file"] for x in shards for line in open(f"{d}/f/{x['file']}", encoding="utf-8")]
    assert len(shards) > 1 and got == sorted(f"f{i}.py" for i in range(20_000))
    r = spark.createDataFrame([("repo/src/x/y.py",), ("deep/dir/z.py",)], "p string") \
        .select(sk.short_path("p").alias("s")).collect()
    assert [x["s"] for x in r] == ["src/x/y.py", "dir/z.py"]


def test_number_rows_global_order(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"))
    out = sk.number_rows(df, ["k"])
    rows = out.orderBy("number").collect()
    assert [r["number"] for r in rows] == list(range(1, 5001))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)


def test_analysis_summaries_from_json(spark):
    d = scratch()
    with open(f"{d}/project_summary.json", "w") as fh:
        json.dump({"project_path": "/p", "analysis_time": "t", "summary": {"total_files": 3, "total_classes": 1,
                   "total_functions": 6}, "graph_info": {"nodes": 8, "edges": 7, "density": 7 / 64,
                                                         "avg_degree": 1.75}}, fh, indent=2)
    r = sk.project_summary_from_json(spark, f"{d}/project_summary.json").first()
    assert (r["total_files"], r["nodes"], r["edges"]) == (3, 8, 7) and r["avg_degree"] == 1.75
    hier = {"resolution_0.5": {"resolution": 0.5, "num_communities": 3, "modularity": 0.25,
                               "statistics": {"community_details": {"0": {"size": 9}, "1": {"size": 2},
                                                                    "2": {"size": 6}}}},
            "resolution_2.0": {"resolution": 2.0, "num_communities": 2, "modularity": -0.01,
                               "statistics": {"community_details": {"0": {"size": 1}}}}}
    with open(f"{d}/hier.json", "w") as fh:
        json.dump(hier, fh, indent=2)
    levels, big = sk.resolution_levels_from_json(spark, f"{d}/hier.json")
    assert sorted((r["resolution"], r["num_communities"]) for r in levels.collect()) == [(0.5, 3), (2.0, 2)]
    assert [(r["community"], r["size"]) for r in big.orderBy("rank").collect()] == [("0", 9), ("2", 6)]


def test_descriptions_as_json_and_markdown(spark):
    rows = [(f"c{i:04d}", f"does {i}" if i else None, ["api"] if i % 2 else [], ["split"] if i % 3 else None, 7)
            for i in range(3000)]
    desc = spark.createDataFrame(rows, "community string, functionality string, functional_tags array<string>, "
                                       "refactor_suggestions array<string>, design_quality int").repartition(7)
    d = scratch()
    sk.write_descriptions(desc, f"{d}/out", stamp=F.lit("t0"), shard_rows=900)
    doc = json.loads(spark.read.text(f"{d}/out/manifest").first()["value"])
    assert doc["header"] == {"timestamp": "t0", "communities": 3000}
    read = lambda name: [x for f in doc["arrays"][name] for x in open(f"{d}/out/{f['file']}", encoding="utf-8")]
    recs = [json.loads(x) for x in read("descriptions")]
    assert [(r["number"], r["community"]) for r in recs] == [(i + 1, f"c{i:04d}") for i in range(3000)]
    text = "".join(read("report"))
    assert text.startswith("# Community descriptions\n\nGenerated: t0\nCommunities: 3000\n")
    heads = [x for x in text.split("\n") if x.startswith("## ")]
    assert heads == [f"## {i + 1}. Community c{i:04d}" for i in range(3000)]
    assert "**Functionality**: N/A" in text and "**Architecture pattern**: N/A" in text and "- split" in text
    assert len(doc["arrays"]["report"]) > 1
