"""Session settings the engine relies on.

Timestamps are UTC throughout (calendar features depend on it), so every
public entry point calls :func:`prepare` on the session it is given; it
only touches runtime SQL settings, never cluster-level ones.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in _RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_code(spark)
    return spark


_SHIPPED: set = set()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable by the executors' Python workers.

    The pandas UDFs and grouped/partition functions refer to this package's
    functions, which executors must import.  The package is zipped once on
    the driver and added with ``addPyFile``; Spark's file server then hands
    it to every executor (the zip holds code only, never data).  Once per
    SparkContext; with an installed or PYTHONPATH copy it is a harmless
    safeguard.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. a Connect session)
        return
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="alertsieve-code-"), "alertsieve.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "alertsieve") -> SparkSession:
    """Session for tests and local benchmarks (no UI, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ALERTSIEVE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return prepare(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
    file system); without that setting this raises, since executors could
    not see each other's files.  Only a local master, where all tasks share
    one machine, gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="alertsieve-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def reliable_table(df, name: str):
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but keeps a columnar table, so the
    passes that follow prune columns and push filters into the scan.  The
    folder is the cluster's shared ``spark.checkpoint.dir``, so the table
    survives the loss of any executor.
    """
    return reliable_table_at(df, name)[1]


def reliable_table_at(df, name: str):
    """As :func:`reliable_table`; also the table's path."""
    import uuid

    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/alertsieve/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return path, spark.read.parquet(path)


def drop_reliable_table(spark, path: str) -> bool:
    """Delete one table that :func:`reliable_table_at` wrote and nothing reads any more."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(jpath, True))


def clear_reliable_tables(spark) -> bool:
    """Delete every table ``reliable_table`` wrote for this application.

    Call it when the DataFrames read from them are no longer needed (they
    read the tables lazily).  Uses Hadoop's FileSystem API, so it works on
    the shared file system behind ``spark.checkpoint.dir``.
    """
    sc = spark.sparkContext
    root = ensure_checkpoint_dir(spark)
    jpath = sc._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/alertsieve")
    fs = jpath.getFileSystem(sc._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath) and fs.delete(jpath, True))
