"""Extraction (B1–B6), code graph (C1, C2) and tree scan (A1, A2) on our own
small corpora (shapes of FIXTURES.md §1, F1–F3)."""

import os
import tempfile

from pyspark.sql import functions as F

from corpusgraph.operators import components as cc
from corpusgraph.operators import extract as ex
from corpusgraph.operators import graph as g
from corpusgraph.sources import corpus as cp

UNIT = {
    "shapes.py": '''
class Box:
    """A box."""
    def __init__(self, v):
        self.v = v
    def get_value(self):
        return self.v
    def set_value(self, v):
        self.v = v
''',
    "maths.py": '''
def plus(a, b):
    return a + b

def times(a, b):
    total = 0
    for _ in range(b):
        total = plus(total, a)
    return plus(total, 0)
''',
    "io_stuff.py": '''
import os, sys
from pathlib import Path
from typing import List, Dict
from . import sibling
from .mod import thing

def walk_files(root):
    return [Path(p) for p in os.listdir(root)]
''',
}

INTEGRATION = {
    "app.py": '''
from helpers import assist
from models import Record

class App:
    def __init__(self):
        self.r = Record()
    def run(self):
        assist()
        self.r.process()
''',
    "helpers.py": '''
def assist():
    return 1

def assist_more():
    return assist()
''',
    "models.py": '''
class Base:
    def validate(self):
        return True

class Record(Base):
    def __init__(self):
        super().__init__()
    def process(self):
        self.validate()
        print("done")
''',
}


def corpus_of(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, content string")


def test_unit_corpus(spark):
    recs = ex.extract_records(corpus_of(spark, UNIT)).cache()
    el = {r["element_id"]: r for r in ex.elements(recs).collect()}
    box = el["shapes.py:Box"]
    assert box["kind"] == "class" and box["methods"] == ["__init__", "get_value", "set_value"]
    assert box["docstring"] == "A box."
    # methods are functions too (the reference's method filter never fires)
    assert el["shapes.py:get_value"]["kind"] == "function"
    assert el["maths.py:times"]["calls"].count("plus") == 2 and "range" in el["maths.py:times"]["calls"]
    assert len(el) == 7
    imps = sorted(r["import"] for r in ex.imports(recs).collect())
    assert imps == ["mod.thing", "os", "pathlib.Path", "sys", "typing.Dict", "typing.List"]
    nodes, edges = g.code_graph(ex.elements(recs))
    assert sorted(map(tuple, edges.select("src", "dst").collect())) == [("maths.py:plus", "maths.py:times")]
    comps = cc.connected_components(nodes, edges).select("community").distinct().count()
    assert comps == 6
    s = ex.project_summary(ex.elements(recs), edges).first()
    assert (s["total_files"], s["total_classes"], s["total_functions"], s["graph_edges"]) == (3, 1, 6, 1)


def test_integration_corpus(spark):
    recs = ex.extract_records(corpus_of(spark, INTEGRATION))
    el = ex.elements(recs)
    assert el.count() == 10
    nodes, edges = g.code_graph(el)
    got = sorted(map(tuple, edges.select("src", "dst", "relationship").collect()))
    assert got == [("app.py:run", "helpers.py:assist", "calls"),
                   ("helpers.py:assist", "helpers.py:assist_more", "calls"),
                   ("models.py:Base", "models.py:Record", "inherits")]
    sizes = sorted(r["count"] for r in cc.connected_components(nodes, edges)
                   .groupBy("community").count().collect())
    assert sizes == [1, 1, 1, 1, 1, 2, 3]


def test_edge_cases(spark):
    files = {
        "bad.py": "def broken(:\n  pass\n",
        "dup.py": "class A:\n    def __init__(self): pass\nclass B:\n    def __init__(self): pass\n",
        "same.py": "class Thing:\n    pass\ndef Thing():\n    return Thing()\n",
        "asy.py": "async def fetch():\n    return 1\n",
        "rec.py": "def fact(n):\n    return 1 if n < 2 else n * fact(n - 1)\n",
        "bases.py": "import typing\nclass G(typing.Generic[int], object, mod.Base):\n    pass\n",
    }
    recs = ex.extract_records(corpus_of(spark, files)).cache()
    assert [r["file_path"] for r in ex.rejects(recs).collect()] == ["bad.py"]
    el = {r["element_id"]: r for r in ex.elements(recs).collect()}
    assert "dup.py:__init__" in el and el["dup.py:__init__"]["kind"] == "function"
    assert el["same.py:Thing"]["kind"] == "function"          # function wins
    assert "asy.py:fetch" not in el                            # async defs absent
    assert el["bases.py:G"]["inheritance"] == ["object", "mod.Base"]
    _, edges = g.code_graph(ex.elements(recs))
    assert ("rec.py:fact", "rec.py:fact") in set(map(tuple, edges.select("src", "dst").collect()))


def test_scan_tree_and_decode(spark):
    root = tempfile.mkdtemp(prefix="cg-scan-")
    layout = {"a.py": b"x = 1\n", "pkg/b.py": b"def f():\n    pass\n",
              "pkg/node_modules/c.py": b"y = 2\n", "pkg/deep/__pycache__/d.py": b"z = 3\n",
              "notes.txt": b"hi", "big.py": b"#" * 2000, "latin.py": b"s = '\xe9'\n"}
    for rel, data in layout.items():
        full = os.path.join(root, rel)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as fh:
            fh.write(data)
    files = cp.scan_tree(spark, root, max_bytes=1000)
    assert sorted(r["path"] for r in files.collect()) == ["a.py", "latin.py", "pkg/b.py"]
    corpus, rej = cp.decode_text(files)
    assert sorted(r["path"] for r in corpus.collect()) == ["a.py", "pkg/b.py"]
    assert [r["path"] for r in rej.collect()] == ["latin.py"]
    exact = cp.scan_tree(spark, root, max_bytes=2000)
    assert "big.py" in {r["path"] for r in exact.select("path").collect()}  # size bound inclusive


def test_naming_on_code_graph(spark):
    from corpusgraph.operators import naming as nm
    files = {
        "agents/agent_handler.py": "class AgentHandler:\n    def handle_message(self):\n        pass\n",
        "agents/agent_processor.py": "def process_message():\n    return handle_message()\n",
        "agents/agent_validator.py": "def validate_message():\n    pass\n",
    }
    recs = ex.extract_records(corpus_of(spark, files))
    el = ex.elements(recs)
    memb = el.select(F.col("element_id").alias("node"), F.lit("c0").alias("community"))
    names = {r["community"]: r["name"] for r in nm.community_names(
        memb, el.select(F.col("element_id").alias("node"), "name", "kind")).collect()}
    # common stem prefix "agent_" → "agent" → dictionary word "Agent"
    assert names["c0"].startswith("Agent")
    words = spark.range(1).select(nm.split_identifier(F.lit("parse_HTTPResponse_v2")).alias("w")).first()["w"]
    assert words == ["parse", "response", "parse", "httpresponse"]
    sample = nm.context_sample(memb, el.select(F.col("element_id").alias("node"), "name", "kind",
                                               "file_path")).first()
    assert sample["files"] == ["agent_handler", "agent_processor", "agent_validator"]
    assert sample["classes"] == ["AgentHandler"]


def test_search_operators_on_code(spark):
    from corpusgraph.operators import search as se
    recs = ex.extract_records(corpus_of(spark, INTEGRATION))
    el = ex.elements(recs).cache()
    ov = {r["file_path"]: (r["classes"], r["functions"], r["important"])
          for r in se.symbol_overview(el).collect()}
    assert ov["models.py"] == (2, 3, False)
    assert {r["element_id"] for r in se.find_symbol(el, "assist", kind="function").collect()} == \
        {"helpers.py:assist", "helpers.py:assist_more"}
    refs = {r["element_id"] for r in se.find_references(el, "assist").collect()}
    assert refs == {"app.py:run", "helpers.py:assist_more"}
    corpus = corpus_of(spark, {"a/b/c.py": "", "a/d.py": "", "e.txt": ""})
    fs = se.file_structure(corpus).first()
    assert (fs["files"], fs["py_files"], fs["directories"]) == (3, 2, 2)
    hits = se.search_pattern(corpus_of(spark, INTEGRATION), r"^def ", id_col="path", text_col="content",
                             path_col="path", extensions=[".py"])
    assert {r["doc_id"] for r in hits.collect()} == {"helpers.py"}


def test_routes_and_profile(spark):
    from corpusgraph.operators import entities as en
    from corpusgraph.operators import tabular as tb
    req = spark.createDataFrame([("GET", "/api/users/7"), ("POST", "/api/users/7"), ("GET", "/nope"),
                                 ("GET", "/api/users/7/x")], "method string, path string")
    got = [(r["path"], r["status"], r["route"]) for r in
           en.match_routes(req, [("GET", "/api/users/{id}"), ("GET", "/api/users/{id}/{sub}")]).collect()]
    assert got == [("/api/users/7", 200, 0), ("/api/users/7", 405, None), ("/nope", 404, None),
                   ("/api/users/7/x", 200, 1)]
    d = tempfile.mkdtemp(prefix="cg-prof-")
    with open(f"{d}/p.csv", "w") as fh:
        fh.write("g,x\na,1\nb,2\nb,4\nc,8\n")
    quality, stats = tb.profile_file(spark, f"{d}/p.csv")
    s = stats.where("column = 'x'").first()
    assert (s["q1"], s["median"], s["q3"]) == (1.75, 3.0, 5.0)
    assert quality.where("metric = 'total_rows'").first()["value"] == 4.0


def test_names_from_descriptions(spark):
    from corpusgraph.operators import naming as nm
    assert len(nm.DESCRIPTION_TERMS) == 108 and len(nm.SPECIAL_PHRASES) == 25
    df = spark.createDataFrame([
        ("负责输入验证和数据处理", ["api"], "api_layer"),
        ("", ["handler", "zzz"], "testing"),
        ("", ["unknown"], "testing"),
        ("", [], "data_model"),
        ("plain words", ["custom_tag"], None)],
        "functionality string, tags array<string>, pattern string")
    got = [r[0] for r in df.select(nm.name_from_description("functionality", "tags", "pattern")).collect()]
    assert got == ["Validation Processing Module", "Handler Module", None, "Data Model Layer",
                   "Custom_Tag Module"]


def test_waterfall_prefers_description(spark):
    from corpusgraph.operators import naming as nm
    memb = spark.createDataFrame([("a/agent_x.py:f", "c1"), ("b/zzz.py:g", "c2")], "node string, community string")
    desc = spark.createDataFrame([("c1", "负责消息处理", ["api"], "api_layer")],
                                 "community string, functionality string, functional_tags array<string>, "
                                 "architecture_pattern string")
    names = {r["community"]: r["name"] for r in nm.community_names(memb, descriptions=desc).collect()}
    assert names["c1"] == "Processing Message Module"   # keywords: 处理 → processing, message
    assert names["c2"] == "Zzz Module"                  # no description → file stem
