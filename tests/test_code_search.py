"""Postings against scans, name hubs against listed edges, the keyword
automaton against one test per term."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import components as cc
from corpusgraph.operators import graph as g
from corpusgraph.operators import naming as nm
from corpusgraph.operators import postings as po
from corpusgraph.operators import quality as qm
from corpusgraph.operators import search as se
from tests.conftest import SF_SMALL


def test_needles():
    assert po.needles("Licen[sc]e") == ["Licen"]
    assert po.needles("def (get|set)_value") == ["def ", "_value"]
    assert po.needles("(abc)+x?tail") == ["abc", "tail"]
    for p in ("a|bcd", "(?i)abcdef", r"\Qabc\E", "ab", "abc*+", "x{0,2}", "(?:abc)?", "[", "abc(?!d)|x"):
        assert po.needles(p) == []
    assert po.needles("(?:abc)?defg") == ["defg"] and po.needles("größe") == ["größe"]


def test_search_equals_scan_and_reads_less(spark, monkeypatch):
    monkeypatch.setattr(po, "BLOCK", 4)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "naïve Größe\nand größer"), (-4, "ab")], "doc_id long, text string"))
    index = po.build_index(docs, parts=16)
    for pattern in ("Licen[sc]e", "Grö[sß]e", "zzzz+q", "the .* and", "(?i)LICENSE", "^ab$", "er|an"):
        want = se.search_pattern(docs, pattern)
        got = po.search_pattern(index, pattern)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), pattern
    assert sorted(map(tuple, po.find_lines(index, "the ").collect())) == sorted(
        map(tuple, se._lines_with(docs, "the ", "doc_id", "text").collect()))
    assert [r[0] for r in po.find_texts(index, "Größe").collect()] == [-3]
    r = po.reading(index, ["Größe"]).first()
    assert r["texts"] == docs.count() and r["texts_scanned"] <= 8
    assert r["bytes_scanned"] <= r["bytes_in_read_partitions"] < r["bytes"] / 4
    assert po.reading(index, ["ab"]).first()["texts_scanned"] == docs.count()
    assert po.search_pattern(po.build_index(docs.limit(0)), "abc").count() == 0


def _elements(spark, n=60):
    r = random.Random(3)
    names = ["get", "run", "x", "y", "z", "w", "lonely"]
    rows = []
    for i in range(n):
        kind = r.choice(["function", "function", "class"])
        calls = [r.choice(names[:6]) for _ in range(r.randrange(3))] + r.choice([[], ["a.b"], ["nowhere"]])
        rows.append((f"e{i}", r.choice(names), kind, calls if kind == "function" else [],
                     [r.choice(names)] if kind == "class" and r.random() < 0.5 else []))
    return spark.createDataFrame(rows + [("e-null", None, "function", ["get"], [])],
                                 "element_id string, name string, kind string, calls array<string>, inheritance array<string>")


def test_hubs_equal_listed_edges(spark):
    el = _elements(spark)
    edges = g.call_edges(el).unionByName(g.inheritance_edges(el)).where("dst is not null")
    out = {r["src"]: r["n"] for r in edges.groupBy("src").agg(F.count("*").alias("n")).collect()}
    into = {r["dst"]: r["n"] for r in edges.groupBy("dst").agg(F.count("*").alias("n")).collect()}
    got = {r["node"]: (r["out_degree"], r["in_degree"]) for r in g.hub_degrees(el).collect()}
    assert got == {n: (out.get(n, 0), into.get(n, 0)) for n in out.keys() | into.keys()}
    nodes = el.select(F.col("element_id").alias("node"))
    want = cc.connected_components(nodes, edges.select("src", "dst"))
    assert sorted(map(tuple, g.hub_components(el).collect())) == sorted(map(tuple, want.collect()))
    memb = nodes.withColumn("community", F.pmod(F.xxhash64("node"), F.lit(4)))
    pairs = [(r["src"], r["dst"]) for r in edges.collect()]
    of = {r["node"]: r["community"] for r in memb.collect()}
    m, mass, inside = len(pairs), {}, 0
    for a, b in pairs:
        inside += of[a] == of[b]
        for x in (a, b):
            mass[of[x]] = mass.get(of[x], 0) + 1
    r = g.hub_modularity(el, memb).first()
    assert r["num_edges"] == m
    assert r["modularity"] == pytest.approx(inside / m - sum(k * k for k in mass.values()) / (4 * m * m))


def test_a_name_in_every_file_stays_linear(spark):
    n = 3000
    el = spark.range(n).selectExpr("concat('f', id) element_id", "'get' name", "'function' kind", "array('get') calls",
                                   "cast(array() as array<string>) inheritance")
    assert g.name_hubs(el).count() == 2 * n  # of n * n edges
    assert g.hub_degrees(el).agg(F.sum("out_degree")).first()[0] == n * n
    assert g.hub_components(el).select("community").distinct().count() == 1
    assert g.hub_components(el.limit(0)).count() == 0


def test_keyword_automaton(spark):
    r = random.Random(1)
    terms = [t for t, _ in nm.keyword_terms("en")]
    texts = ["".join(r.choice([r.choice(terms), " ", "X", "ab", r.choice(terms).upper()]) for _ in range(r.randrange(9)))
             for _ in range(300)] + [None, "", "API接口 用户界面"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for k in (1, 2, 5):
        want = {x["id"]: x["w"] or [] for x in df.select("id", nm.extract_keywords("t", k=k).alias("w")).collect()}
        assert {x["id"]: x["keywords"] for x in nm.with_keywords(df, "t", k=k).collect()} == want
    a = df.select("id", nm.name_from_description("t", F.array().cast("array<string>"), F.lit("unknown")).alias("n"))
    b = nm.with_keywords(df, "t").select("id", nm.name_from_description(
        "t", F.array().cast("array<string>"), F.lit("unknown"), keywords="keywords").alias("n"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_hub_modularity_counts_before_it_joins(spark, monkeypatch):
    """Ends are counted by name and community and never joined row by row; a
    node may lack a community or have several."""
    import random
    r = random.Random(3)
    rows = [(i, "function", r.choice("abcd"), [r.choice("abcdef") for _ in range(r.randrange(6))], []) for i in range(200)]
    el = spark.createDataFrame(rows, "element_id long, kind string, name string, calls array<string>, inheritance array<string>")
    memb = [(i, r.choice(["x", "y", "z", None])) for i in range(180)] + [(0, "x"), (1, "y")]
    hubs = g.name_hubs(el).join(spark.createDataFrame(memb, "node long, community string"), "node").collect()
    mass, callers, defs = {}, {}, {}
    for h in hubs:
        if h.community is not None:
            mass[h.community] = mass.get(h.community, 0) + (h.definitions if h.calls else h.callers)
            side = callers if h.calls else defs
            side[h.name, h.community] = side.get((h.name, h.community), 0) + 1
    inside = sum(n * defs.get(k, 0) for k, n in callers.items())
    m = sum(mass.values()) / 2
    monkeypatch.setattr(g, "name_hubs", None)
    got = g.hub_modularity(el, spark.createDataFrame(memb, "node long, community string")).first()
    assert got.num_edges == int(m)
    assert abs(got.modularity - (inside / m - sum((k / (2 * m)) ** 2 for k in mass.values()))) < 1e-9
