"""Session helpers: checkpoint directory lookup and a local session for tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder that holds checkpoints and intermediate tables.

    This is the folder named by ``spark.checkpoint.dir`` (or the one already
    set on the context). Only where neither is set and the session runs in one
    JVM (``local[...]``: tests, smoke runs) a folder below the session's
    warehouse is used. On a cluster without the setting we raise instead of
    picking a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        master = sc.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(
                "no checkpoint directory: set spark.checkpoint.dir to a folder that all executors share"
            )
        conf = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def local_session(checkpoint: str, cores: int = 8, shuffle_partitions: int = 8, app: str = "latentrec"):
    """Local session used by tests and the benchmark (never on a cluster)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", checkpoint)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint)
    return spark
