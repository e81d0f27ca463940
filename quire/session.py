"""Session helpers.

The library never sets cluster-level options itself; ``local_session`` is for
tests and the bench. ``checkpoint_dir`` reads the shared folder the cluster
names in ``spark.checkpoint.dir`` and only falls back to a fresh scratch folder
when the setting is absent (local tests).
"""

from __future__ import annotations

import os
import tempfile
import threading
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "quire") -> SparkSession:
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
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not checkpoint_dir(spark):  # tests only: the cluster names its own shared folder
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-ckpt-"))
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the cluster, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; an error when none is configured.

    Library code never invents a folder: a machine-local one would not survive
    the loss of that machine. Only ``local_session`` (tests, bench) sets one.
    """
    d = checkpoint_dir(spark)
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set: configure a shared folder for checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quire-{name}-{os.getpid()}-{os.urandom(4).hex()}"


def reliable_checkpoint(df):
    """``df.checkpoint()`` into the cluster's shared checkpoint folder (never ``localCheckpoint``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a file of ``staged``: so few that a task that reads files up to ``spark.sql.files.maxPartitionBytes`` gets no more rows than it can sort.
STAGE_ROWS = 20_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING: dict = {}
_LOCK = threading.Lock()


@contextmanager
def shuffles_removed(spark: SparkSession):
    """The shuffle files of a job started inside are removed when it ends, not when the driver next collects its garbage.

    For frames that are run once: one that is run again would have to shuffle anew.
    """
    session = spark._jsparkSession.hashCode()
    with _LOCK:
        users, before = _CLEANING.get(session) or (0, spark.conf.get(CLEANUP) if spark._jsparkSession.sessionState().conf().contains(CLEANUP) else None)
        _CLEANING[session] = users + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            users, before = _CLEANING.pop(session)
            if users > 1:  # another thread's, or one around this
                _CLEANING[session] = users - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


@contextmanager
def staged(df, schema=None):
    """``df`` written once under the shared checkpoint folder, packed by column, and read back (as ``schema``); the files are removed at the end of the ``with``.

    Unlike a checkpoint it leaves nothing behind, neither rows nor shuffle files, so whatever reads it must run inside.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    try:
        with shuffles_removed(spark):
            df.write.option("compression", "zstd").option("maxRecordsPerFile", STAGE_ROWS).parquet(path)
        yield spark.read.schema(schema or df.schema).parquet(path)
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable on every Python worker (``addPyFile`` of a zip of the package).

    Functions run by ``mapInArrow`` / Arrow UDFs refer to this package's modules,
    so executors need it whatever the driver's working directory is. Done once
    per application. The zip is built in memory and written through the Hadoop
    file system into the shared checkpoint folder, from where Spark distributes
    it; only in local mode without such a folder does it go to a temporary
    folder (on a cluster that is an error).
    """
    import hashlib
    import io
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(dp, f) for dp, _, fs in os.walk(pkg) for f in fs if f.endswith(".py"))
    buf, digest = io.BytesIO(), hashlib.sha256()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            with open(f, "rb") as fh:
                data = fh.read()
            digest.update(f.encode() + data)
            z.writestr(os.path.join("quire", os.path.relpath(f, pkg)), data)
    name = f"quire-{digest.hexdigest()[:12]}.zip"
    base = checkpoint_dir(spark)
    if base:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/quire-pyfiles-{sc.applicationId}/{name}")
        fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
        out = fs.create(target, True)
        out.write(bytearray(buf.getvalue()))
        out.close()
        path = target.toString()
    elif sc.master.startswith("local"):  # local development only: driver and workers share this machine
        path = os.path.join(tempfile.mkdtemp(prefix="quire-pyfiles-"), name)
        with open(path, "wb") as fh:
            fh.write(buf.getvalue())
    else:
        raise RuntimeError("spark.checkpoint.dir is not set: configure a shared folder for checkpoints")
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
