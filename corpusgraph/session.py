"""Session helpers.

Library code never changes cluster settings; only ``local_session`` (tests,
bench) builds a session, and ``ensure_checkpoint_dir`` sets a directory only
when the session has none configured and runs in local mode.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "corpusgraph") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CG_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of this session.

    Uses ``spark.checkpoint.dir`` when the cluster names one (a shared
    folder).  Only a local-mode session without one gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative jobs need a shared "
                "checkpoint folder on a cluster")
        configured = tempfile.mkdtemp(prefix="cg-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _scratch_table_path(spark, kind: str) -> str:
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/corpusgraph/{kind}-{uuid.uuid4().hex}"


def write_table(df, kind: str = "table") -> str:
    """Write ``df`` as parquet in the session's checkpoint folder (shared
    storage on a cluster) and return the path."""
    path = _scratch_table_path(df.sparkSession, kind)
    df.write.mode("overwrite").parquet(path)
    return path


def delete_table(spark, path: str) -> None:
    """Delete a table written by ``write_table``, on whatever file system the
    checkpoint folder lives."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df):
    """Write ``df`` as a parquet table in the session's checkpoint folder
    (shared storage on a cluster) and read it back.

    One job computes the data once; the returned DataFrame's lineage starts
    at the table, so an executor loss never replays earlier stages.  Never a
    local checkpoint.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df))


class RoundKeeper:
    """Lineage control for iterative jobs: every round's state becomes a
    written table, so plans never grow, nothing is computed twice and a lost
    executor costs at most the current round.  A round's table is deleted
    when its successor has been written.  The driver reads one scalar row per
    round."""

    def __init__(self, signed: tuple[str, ...] = ()) -> None:
        self.signed = signed
        self.path: str | None = None

    def _next(self, df):
        spark, old = df.sparkSession, self.path
        self.path = write_table(df, "round")
        if old is not None:
            delete_table(spark, old)
        return spark.read.schema(df.schema).parquet(self.path)

    def keep(self, df, flag: str | None = None):
        """The written state, and the rows (with ``flag`` set)."""
        from pyspark.sql import functions as F

        out = self._next(df)
        n = out.count() if flag is None else out.agg(F.count_if(F.col(flag))).first()[0]
        return out, n

    def keep_counts(self, df, **counts):
        """The written state, and figures over it that the write observes."""
        from pyspark.sql import Observation

        seen = Observation()
        out = self._next(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
        return out, seen.get

    def keep_signed(self, df):
        """The written state, and its order-free signature (rows, xor of the
        row hashes over the ``signed`` columns)."""
        from pyspark.sql import functions as F

        out = self._next(df)
        row = out.agg(F.count("*"), F.bit_xor(F.xxhash64(*self.signed))).first()
        return out, (row[0], row[1])
