"""Session helpers: building a local session for tests/bench and finding the
shared checkpoint folder.

Library code never creates its own session: every operator takes DataFrames
and works with whatever session produced them. These helpers exist for the
test-suite, the bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every session we build gets. AQE re-plans joins (broadcast only
# when the *measured* shuffle output is below the threshold, sort-merge
# otherwise), coalesces small partitions and splits skewed ones.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.pythonUDF.arrow.enabled": "true",
}


def default_heap() -> str:
    """Three tenths of the memory that this process may use, 1 to 8 GB: the
    rest is for Python workers, Arrow buffers and the system."""
    limit = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    for name in ("/sys/fs/cgroup/memory.max", "/sys/fs/cgroup/memory/memory.limit_in_bytes"):
        try:
            with open(name) as f:
                limit = min(limit, int(f.read()))
        except (OSError, ValueError):
            pass
    return f"{min(8 << 10, max(1 << 10, int(limit * 0.3) >> 20))}m"


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "sigflow", extra: dict | None = None) -> SparkSession:
    """A local[cpus] session with the settings above (tests and bench)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.driver.memory"] = os.environ.get("SIGFLOW_DRIVER_MEMORY", default_heap())
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared (distributed) folder and is used
    as is. Only when it is unset *and* the session is local (tests, bench) do
    we create a private folder; a cluster session without the setting is an
    error, because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="sigflow-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable
    checkpoint, never a local one) so iterative jobs keep short plans and
    survive executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sigflow`` importable in the Python workers (pandas UDFs and
    grouped functions are pickled by module reference): zip the package once
    and register it with ``addPyFile``, the programmatic ``--py-files``.
    Spark copies it to every executor."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="sigflow-pyfiles-"), "sigflow.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
