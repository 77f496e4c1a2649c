"""Descriptions (F1–F5, F14, F18) against the goldens of FIXTURES.md §3."""

from corpusgraph.operators import describe as ds


def test_design_quality_goldens(spark):
    det = spark.createDataFrame(
        [("a", 26, 0.08, 0.018868), ("b", 24, 0.097826, 0.018182), ("c", 10, 0.8, 0.2), ("d", 15, 0.7, 0.3)],
        "community string, size long, cohesion double, coupling double")
    got = {r["community"]: (r["q"], r["s"], r["n"]) for r in det.select(
        "community", ds.design_quality("cohesion", "coupling").alias("q"),
        ds.suggestions("cohesion", "coupling").alias("s"), ds.size_name("size").alias("n")).collect()}
    assert got["a"] == (5, ["raise_cohesion"], "large")
    assert got["b"] == (5, ["raise_cohesion"], "large")
    assert got["c"] == (9, ["keep_design"], "medium")
    assert got["d"] == (6, ["keep_design"], "medium")   # coupling 0.3 is not > 0.3


def test_tags_pattern_digest(spark):
    memb = spark.createDataFrame(
        [("agent_processor.py:run", "x"), ("agent_handler.py:api_call", "x"), ("tests/test_agent.py:t", "x"),
         ("plain.py:f", "y")], "node string, community string")
    tags = {r["community"]: r["functional_tags"] for r in ds.functional_tags(memb).collect()}
    assert tags == {"x": ["api", "test"], "y": ["general"]}
    pat = {r["community"]: r["architecture_pattern"] for r in ds.architecture_pattern(memb).collect()}
    assert pat == {"x": "testing", "y": "functional_module"}
    many = spark.createDataFrame([(f"n{i:02d}", "z") for i in range(25)], "node string, community string")
    dg = ds.member_digest(many, 20).first()["digest"]
    assert dg.startswith("n00, n01") and dg.endswith("n19 ... and 5 more")
