import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from corpusgraph.session import local_session
    s = local_session("*", shuffle_partitions=8, app="corpusgraph-tests")
    yield s


@pytest.fixture(scope="session")
def path_graph(spark):
    """G1: eight-node path A–H."""
    edges = spark.createDataFrame(
        [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E"), ("E", "F"), ("F", "G"), ("G", "H")],
        "src string, dst string").withColumn("weight", __import__("pyspark.sql.functions",
                                                                   fromlist=["lit"]).lit(1.0))
    nodes = spark.createDataFrame([(c,) for c in "ABCDEFGH"], "node string")
    return nodes, edges


def membership_of(spark, groups):
    rows = [(n, str(i)) for i, g in enumerate(groups) for n in g]
    return spark.createDataFrame(rows, "node string, community string")
