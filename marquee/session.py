"""SparkSession construction and cluster-safe defaults."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
import os
import re
import tempfile

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def get_spark(master: str | None = None, app: str = "marquee",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job here relies on.

    AQE stays on so joins re-plan at runtime (broadcast when a side turns out
    small, skew splitting, partition coalescing). The UI is off: no port.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(STATE_PROVIDER, ROCKSDB_PROVIDER)
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared filesystem);
    when it is unset there, this fails. Local runs and tests get a scratch
    folder.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="marquee-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for materialised intermediate tables under the shared
    checkpoint folder (never a machine-local temp dir on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which typed keyed
    state (``transformWithState``) needs, whatever session they are given, and
    deal it to at most two partitions a core: each costs a store and a Python
    worker in every batch. A stream copies the session's settings when it
    starts; the session's own are put back."""
    parts = min(int(spark.conf.get(SHUFFLE_PARTITIONS)), max(4, 2 * spark.sparkContext.defaultParallelism))
    wanted = {STATE_PROVIDER: ROCKSDB_PROVIDER, SHUFFLE_PARTITIONS: str(parts)}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def reliable_checkpoint(df):
    """``df.checkpoint()`` into the shared checkpoint folder, making sure the
    folder is set on this session first (never ``localCheckpoint``: its
    blocks die with the executor that holds them)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``marquee`` importable in executor Python workers.

    Operators that run Python tasks (``mapInPandas``, ``applyInPandas*``)
    pickle functions by reference to this package, so the workers must be
    able to import it. A deployment normally passes the package with
    ``--py-files`` or installs it on the executors; otherwise this zips it
    once per SparkContext and registers it with ``addPyFile`` (Spark then
    serves the file to every executor). The zip goes under the checkpoint
    folder when that is a local path, else into the driver's scratch area.
    """
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    ckpt = ensure_checkpoint_dir(spark)
    base = ckpt[len("file:"):] if ckpt.startswith("file:") else ckpt
    if "://" in base or not os.path.isdir(os.path.dirname(base.rstrip("/")) or "/"):
        base = tempfile.mkdtemp(prefix="marquee-pyfiles-")
    out_dir = os.path.join(base, "pyfiles")
    os.makedirs(out_dir, exist_ok=True)
    zpath = os.path.join(out_dir, f"marquee-{os.getpid()}-{key}.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
