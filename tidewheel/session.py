"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more exchange above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # In streams, merge a task's own sessions before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch uploads what it changed rather than its whole state.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Share of the input's bytes that the largest exchange of a query takes: a quarter of the
#: columns, and rows that are rarely summed to less than a half.
SHUFFLED_SHARE = 0.125


def build_session(
    app: str,
    master: str | None = None,
    input_bytes: int = 0,
    extra: dict[str, str] | None = None,
    shuffled_share: float = SHUFFLED_SHARE,
) -> SparkSession:
    """A session with the settings above.

    The shuffle is sized to about 128 MB a partition of what is shuffled, not of
    ``input_bytes``: columns are pruned and sums are made before the shuffle, so the largest
    exchange takes about ``shuffled_share`` of the input. AQE merges what turns out small.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if input_bytes:
        partitions = max(8, int(input_bytes * shuffled_share) // (128 << 20))
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, under the shared folder the cluster names.

    Only a local session, whose tasks all see this machine, may do without
    that setting.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")
