"""Spark session helpers shared by tests, bench and the driver entry."""

from __future__ import annotations

import contextlib
import os

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes (a
# broadcast only happens when the measured side is below the threshold, else a
# sort-merge join is kept), coalesces small shuffle partitions and splits
# skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "namekit", cpus: int | str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and bench; on a cluster use the existing one."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions",
                             str(shuffle_partitions or cpus))
    builder = builder.config("spark.driver.memory", "16g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when a local session names none (tests) a fresh scratch folder is
    created and registered; on a cluster that is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's checkpoint folder applies
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        known = sc._jsc.sc().getCheckpointDir()
        current = known.get() if known.isDefined() else None
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile
        current = tempfile.mkdtemp(prefix="namekit-ckpt-")
    if not (sc._jsc.sc().getCheckpointDir().isDefined()):
        sc.setCheckpointDir(current)
    return current


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Within, a job's shuffle files go when the job ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, for functions that run there."""
    sc = spark.sparkContext
    if getattr(sc, "_namekit_shipped", False):
        return
    import pathlib
    import tempfile
    import zipfile

    root = pathlib.Path(__file__).resolve().parent
    # read by the driver's own file server only; executors fetch it from there
    path = pathlib.Path(tempfile.mkdtemp(prefix="namekit-ship-")) / "namekit.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._namekit_shipped = True
