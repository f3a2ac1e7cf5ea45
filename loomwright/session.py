"""Session defaults, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("loomwright")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    """Scan ``<sf_dir>/<name>.parquet`` (a file or a folder of files).

    A narrower ``schema`` leaves out fields of structs inside arrays, which the optimizer
    can't prune once a lambda has seen the struct.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset, as in
    local tests, is a temporary folder made and set as the checkpoint folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="loomwright-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and scan it again.

    The table survives the loss of executors and is read with column pruning.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", compression).parquet(path)
    _staged.append(path)
    return spark.read.parquet(path)


_staged: list[str] = []


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables staged so far; results that still read them must be done. Their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        count += path.getFileSystem(conf).delete(path, True)
    return count
