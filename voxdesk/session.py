"""Session for local runs, and the shared folder jobs write to."""

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def local_session(cpus: int = 8, app: str = "voxdesk") -> SparkSession:
    """A local[n] session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _base_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    Only a local session without the setting gets a folder of its own. On a
    cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        base = tempfile.mkdtemp(prefix="voxdesk-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path for one job under the session's shared folder."""
    return os.path.join(_base_dir(spark), f"{purpose}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make DataFrame.checkpoint() usable without overriding a cluster's choice."""
    _base_dir(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Models run on the executors, where the package need not be installed and the
    driver's working folder is not on the path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="voxdesk-"), "voxdesk")
    parent, name = os.path.split(_PACKAGE)
    context.addPyFile(shutil.make_archive(target, "zip", parent, name))
    _shipped.add(context.applicationId)
