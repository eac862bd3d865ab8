"""Session construction and the shared folder used for lineage cuts and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "sparkwright", conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings every job here relies on.

    AQE stays on (coalescing, skew-join splitting, local shuffle reader); the session time zone is pinned to
    UTC so that timestamp text round-trips identically on every executor.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true"))
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOTS: dict[str, str] = {}   # local-mode fallback folder per application


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    Read from the session. Only a local-mode session (tests, the bench) may fall back to a folder of its own;
    a cluster session without the setting is an error, because a machine-local folder is not visible to the
    other executors.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session has no context; the setting is still readable
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (HDFS, S3, ...)")
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if d:
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (HDFS, S3, ...)")
    if sc.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="sparkwright-ckpt-")
        sc.setCheckpointDir(_LOCAL_ROOTS[sc.applicationId])
    return _LOCAL_ROOTS[sc.applicationId]


def fresh_location(spark: SparkSession, label: str) -> str:
    """A new, unused folder under the shared folder, for one written table."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/sparkwright_tables/{label}_{uuid.uuid4().hex[:12]}"


def fresh_table_name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"
