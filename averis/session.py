"""Session helpers: table reading, lineage cuts in the shared folder, dealing small inputs over the cores."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only in local mode, where it may be unset, a local folder takes its
    place; a cluster without it is an error, since its hosts could not read each other's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="averis-checkpoint-")
        found = _LOCAL[app]
    return found.rstrip("/")


_LOCAL: dict[str, str] = {}
_STORED: list[str] = []


@atexit.register
def _remove_stored() -> None:
    """Tables written by this process go when it ends; a frame that reads one may live until then."""
    sc = SparkContext._active_spark_context
    if sc is None or sc._jvm is None or sc._jsc is None:
        return
    try:
        for path in _STORED:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def store(df: DataFrame, name: str = "t", partition_by: list[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back, as ``schema`` if one is given: a cheap cut
    that keeps column pruning."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _STORED.append(path)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def store_counted(df: DataFrame, name: str = "t") -> tuple[DataFrame, int]:
    """``store`` and the number of rows, observed while they are written. A task that ran twice may count twice, so the
    number tells an empty table from others and how large it is about."""
    seen = Observation()
    kept = store(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return kept, int(seen.get["n"])


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: rows of an input with fewer partitions than cores are dealt out; others stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def local_session(app: str = "averis", cores: str | None = None) -> SparkSession:
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]").appName(app)
        .config("spark.sql.shuffle.partitions", n).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="averis-checkpoint-"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
