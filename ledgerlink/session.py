"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Of the tables written here; digests and ids take about half of what they take with Spark's default.
CODEC = "zstd"
_own: list[tempfile.TemporaryDirectory] = []


def build_session(app: str = "ledgerlink", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow transfer switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local-mode session without that setting gets a fresh temporary folder that goes when the
    process ends; a cluster session without it is refused, because a driver-local folder would not
    survive.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        _own.append(tempfile.TemporaryDirectory(prefix="ledgerlink-", ignore_cleanup_errors=True))
        named = _own[-1].name
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def run_dir(spark: SparkSession) -> str:
    """The one folder below the shared one that holds everything this application writes."""
    return f"{shared_dir(spark)}/ledgerlink-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in this application's folder."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def clear_run(spark: SparkSession) -> None:
    """Remove this application's folder, once no result that reads from it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and continue from the table.

    For results that several branches of a run need: computed once, readable with column
    pruning, and safe when executors are lost.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.parquet(path)
