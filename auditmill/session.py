"""Sessions, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

_own_dir: str | None = None


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session as the tests and the bench use it."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("auditmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("AUDITMILL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; a single Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(df: DataFrame) -> DataFrame:
    """``df`` with its timestamps without a zone read as UTC instants."""
    naive = [f.name for f in df.schema if isinstance(f.dataType, TimestampNTZType)]
    return df.withColumns({c: F.to_timestamp(F.col(c)) for c in naive}) if naive else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in tests one of our own."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="auditmill-")
    return _own_dir


def cut(df: DataFrame, *replaced: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    This ends the lineage, survives the loss of executors and gives the
    optimizer real sizes. ``replaced`` are earlier cuts that nothing needs any
    more; their files go at once, the others' when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/auditmill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._auditmill_path = path
    for old in replaced:
        gone = getattr(old, "_auditmill_path", None)
        if gone:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(gone), True)
    return out


def parallelism(spark: SparkSession) -> int:
    """Tasks a balanced stage should have in this session."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
