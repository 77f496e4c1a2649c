"""Python source extraction as a distributed job.

One ``mapInPandas`` pass parses every file of a corpus ``(path, content)``
with the standard-library ``ast`` module (the only per-row Python in the
library: parsing is not expressible in SQL) and emits flat records —
classes, functions, imports and rejects.  Everything after that (element
keys, edges, summaries) is DataFrame code.  Files are independent, so the
job parallelises over corpus partitions; one record per element keeps the
output proportional to the input.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

RECORD_SCHEMA = T.StructType([
    T.StructField("record", T.StringType()),        # class | function | import | reject
    T.StructField("file_path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("ordinal", T.IntegerType()),      # breadth-first position in the file
    T.StructField("docstring", T.StringType()),
    T.StructField("methods", T.ArrayType(T.StringType())),
    T.StructField("parameters", T.ArrayType(T.StringType())),
    T.StructField("decorators", T.ArrayType(T.StringType())),
    T.StructField("inheritance", T.ArrayType(T.StringType())),
    T.StructField("calls", T.ArrayType(T.StringType())),
    T.StructField("reason", T.StringType()),
])


class _FileReader(ast.NodeVisitor):
    """One depth-first pass over a file's tree.

    Callee texts go into one list for the file; what a definition calls is
    the stretch that was added while it was open, so nested definitions cost
    nothing extra.  ``found`` collects ``(depth, record)``; definitions on one
    depth are met in source order, which makes a stable sort by depth the
    breadth-first order that element keys are resolved in.
    """

    def __init__(self) -> None:
        self.depth = 0
        self.callees: list[str] = []
        self.found: list[tuple[int, dict]] = []

    def generic_visit(self, node: ast.AST) -> None:
        self.depth += 1
        super().generic_visit(node)
        self.depth -= 1

    @staticmethod
    def _dotted(node: ast.expr) -> list[str]:
        """The text of a plain or dotted name, else nothing."""
        return [ast.unparse(node)] if isinstance(node, (ast.Name, ast.Attribute)) else []

    def _definition(self, record: str, node, **columns) -> None:
        entry = {"record": record, "name": node.name, "line_number": node.lineno,
                 "docstring": ast.get_docstring(node) or "",
                 "decorators": [ast.unparse(d) for d in node.decorator_list],
                 "methods": [], "parameters": [], "inheritance": [], "calls": []} | columns
        self.found.append((self.depth, entry))
        opened = len(self.callees)
        self.generic_visit(node)
        if record == "function":
            entry["calls"] = self.callees[opened:]

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._definition(
            "class", node, methods=[x.name for x in node.body if type(x) is ast.FunctionDef],
            inheritance=sum(map(self._dotted, node.bases), []))

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:  # async ones are not elements
        self._definition("function", node, parameters=[x.arg for x in node.args.args])

    def visit_Call(self, node: ast.Call) -> None:
        self.callees += self._dotted(node.func)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        self._imported(x.name for x in node.names)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.module:
            self._imported(f"{node.module}.{x.name}" for x in node.names)

    def _imported(self, names) -> None:
        self.found += [(self.depth, {"record": "import", "name": n}) for n in names]


def parse_source(path: str, text: str | None) -> list[dict]:
    """Records of one file; a syntax error (or no text) gives one reject."""
    reader = _FileReader()
    try:
        if text is None:
            raise ValueError("no_text")
        reader.visit(ast.parse(text))
    except SyntaxError as e:
        return [{"record": "reject", "file_path": path, "reason": f"syntax_error: {e.msg}"}]
    except (ValueError, RecursionError) as e:
        reason = "no_text" if text is None else type(e).__name__
        return [{"record": "reject", "file_path": path, "reason": reason}]
    ordered = sorted(reader.found, key=lambda f: f[0])
    return [entry | {"file_path": path, "ordinal": k} for k, (_, entry) in enumerate(ordered)]


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [f.name for f in RECORD_SCHEMA.fields]
    for pdf in batches:
        data: dict[str, list] = {c: [] for c in cols}
        for path, text in zip(pdf["path"], pdf["content"]):
            for rec in parse_source(path, text):
                for c in cols:
                    data[c].append(rec.get(c))
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in data.items()})


def extract_records(corpus: DataFrame) -> DataFrame:
    """One pass over ``corpus(path, content)``."""
    return corpus.select("path", "content").mapInPandas(_parse_batches, RECORD_SCHEMA)


def elements(records: DataFrame) -> DataFrame:
    """One element per ``path:name`` — functions replace classes, and a
    later (breadth-first) definition replaces an earlier one.  Resolved
    with ``max_by`` (partial aggregate), never by sorting a whole group."""
    defs = records.where(F.col("record").isin("class", "function")).select(
        F.concat_ws(":", "file_path", "name").alias("element_id"),
        F.struct(F.col("record").alias("kind"), "name", "file_path", "line_number",
                 F.lit(1).alias("complexity"), "docstring", "methods", "parameters",
                 "decorators", "inheritance", "calls").alias("e"),
        F.struct(F.when(F.col("record") == "function", 2).otherwise(1).alias("r"),
                 F.col("ordinal").alias("o")).alias("rank"))
    return (defs.groupBy("element_id").agg(F.max_by("e", "rank").alias("e"))
            .select("element_id", "e.*"))


def imports(records: DataFrame) -> DataFrame:
    """``(path, import)`` rows (relative level dropped, ``from . import x``
    absent)."""
    return records.where(F.col("record") == "import").select(
        F.col("file_path").alias("path"), F.col("name").alias("import"))


def rejects(records: DataFrame) -> DataFrame:
    """Files that contributed nothing because they did not parse."""
    return records.where(F.col("record") == "reject").select("file_path", "reason")


def project_summary(elems: DataFrame, edges: DataFrame) -> DataFrame:
    """Files (among elements), classes, functions, nodes, edges."""
    counts = elems.agg(F.count_distinct("file_path").alias("total_files"),
                       F.count_if(F.col("kind") == "class").alias("total_classes"),
                       F.count_if(F.col("kind") == "function").alias("total_functions"),
                       F.count("*").alias("graph_nodes"))
    return counts.withColumn("graph_edges", edges.agg(F.count("*")).scalar())
