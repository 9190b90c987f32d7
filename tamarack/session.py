"""Session factory and table access shared by every query."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tamarack", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every operator assumes (UTC, adaptive execution, Arrow)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where none is set, a local master (one process, as in tests) gets a folder of its own; a cluster gets an error, as a
    folder of one machine would lose what other machines write.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not re.match(r"local(\[[^,]*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tamarack-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


#: Paths of intermediate tables, oldest first: the one list that discard() goes through.
_written: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A path of its own below the shared folder; what is written there stays until discard() is called."""
    _written.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _written[-1]


def written() -> int:
    """How many intermediate paths there are: the mark that discard() goes back to."""
    return len(_written)


def discard(spark: SparkSession, since: int = 0) -> None:
    """Delete what was written below scratch paths after a mark; call it once the results that read it are stored."""
    while len(_written) > since:
        delete(spark, _written.pop())


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The table, written to the shared folder and read back: worked out once, however often it is read from here on.

    Lineage ends there, so a lost executor costs no recomputation. Results are lazy and may still read such tables.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
