"""Session construction and the shared scratch / checkpoint folder.

On a cluster the checkpoint folder must be a shared file system named by
``spark.checkpoint.dir``; it is read from the session and never replaced.
Only a local-mode session without that setting (tests, the bench) gets a
fresh folder under the system temp directory.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every weftcore session wants.  AQE coalesces the many small
# shuffle partitions of late tree rounds and turns small stats joins into
# broadcasts only after measuring them at run time.
_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # row_number() <= k gets a partial (map-side) group limit before the
    # exchange whatever k is.
    "spark.sql.optimizer.windowGroupLimitThreshold": "2147483647",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "weftcore",
    extra_conf: dict | None = None,
) -> SparkSession:
    """Create (or fetch) a session with weftcore's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.optimizer.windowGroupLimitThreshold",
              "spark.sql.mapKeyDedupPolicy", "spark.sql.session.timeZone"):
        spark.conf.set(k, conf[k])
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def _import_path(spark: SparkSession) -> None:
    """Let Python workers import the package where it is installed alike."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))


#: Arrow batches stay small even when single texts are long.
ARROW_ROWS, ARROW_BYTES = 256, 16 << 20


def bound_workers(spark: SparkSession) -> None:
    """Python workers hold small Arrow batches and give freed ones back instead
    of keeping them."""
    env = spark.sparkContext.environment
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_TRIM_THRESHOLD_", "4000000"), ("MALLOC_MMAP_THRESHOLD_", "1000000")):
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only if unset.

    The cluster's ``spark.checkpoint.dir`` wins.  A machine-local folder is
    only created for local-mode sessions; a cluster session without the
    setting is an error rather than a silent local write.
    """
    sc = spark.sparkContext
    _import_path(spark)
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; weftcore needs a shared folder "
            "for lineage cuts and streaming state on a cluster")
    local_dir = tempfile.mkdtemp(prefix="weftcore-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, wherever it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


class ScratchScope:
    """K6: the scratch tables and cached frames of one piece of work.

    Inside ``with ScratchScope(spark):`` every :func:`scratch_path` and every
    :func:`keep` of this thread belongs to the scope; on leaving it the
    folders are deleted and the frames released, also after an error.  What
    outlives the scope is written elsewhere before (``outside()`` gives a path
    that belongs to the scope around it).  Scopes nest."""

    _local = threading.local()

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.frames = spark, [], []

    @classmethod
    def stack(cls) -> list:
        if not hasattr(cls._local, "scopes"):
            cls._local.scopes = []
        return cls._local.scopes

    def __enter__(self) -> "ScratchScope":
        self.stack().append(self)
        return self

    def __exit__(self, *error) -> None:
        self.stack().remove(self)
        for df in self.frames:
            df.unpersist()
        for path in self.paths:
            delete_path(self.spark, path)

    def outside(self, name: str) -> str:
        path = scratch_path(self.spark, name)
        self.paths.remove(path)
        if len(self.stack()) > 1:
            self.stack()[-2].paths.append(path)
        return path


def keep(df: DataFrame) -> DataFrame:
    """Cache a frame, until the scope around it ends."""
    df = df.persist()
    if ScratchScope.stack():
        ScratchScope.stack()[-1].frames.append(df)
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables,
    deleted with the scope around it if there is one."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "weftcore", f"{name}-{uuid.uuid4().hex[:12]}")
    if ScratchScope.stack():
        ScratchScope.stack()[-1].paths.append(path)
    return path
