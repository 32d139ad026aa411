"""Session helpers: a local session for tests/bench and the checkpoint-dir policy.

On a cluster the checkpoint directory must be a shared folder named by the
cluster in ``spark.checkpoint.dir``; we only invent one when running in local
mode with nothing configured (tests, bench).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "logweave", cores: int | str = "*", shuffle_partitions: int = 8,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``logweave`` importable in Python workers (UDFs, Arrow maps): zip the package once
    per SparkContext and ``addPyFile`` it -- the same as ``--py-files`` on spark-submit."""
    import os
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import logweave
    root = os.path.dirname(os.path.dirname(os.path.abspath(logweave.__file__)))
    pkg = os.path.join(root, "logweave")
    zpath = os.path.join(tempfile.mkdtemp(prefix="logweave-pyfiles-"), "logweave.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it from the session conf.

    Order: an already-set SparkContext dir, then ``spark.checkpoint.dir``; only a
    local-mode session with neither gets a fresh scratch folder.
    """
    ship_package(spark)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset conf raises on some versions
            conf_dir = None
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: configure a shared folder for reliable checkpoints")
    local_dir = tempfile.mkdtemp(prefix="logweave-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def reliable_checkpoint(df):
    """Eager reliable checkpoint (cuts lineage; survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
