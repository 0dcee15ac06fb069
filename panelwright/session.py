"""Session defaults and the shared scratch location."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; every one can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Aggregates that follow a skewed join re-shuffle on another key anyway,
        # so splitting the hot partition costs no extra exchange worth avoiding.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A temporary folder is used only for a local master without that setting.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="panelwright-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    sc.setCheckpointDir(root)
    return root


@dataclass
class Intermediates:
    """The intermediate tables of one result; ``release`` deletes them once the result is written."""

    spark: SparkSession
    paths: list[str] = field(default_factory=list)

    def release(self) -> int:
        """Delete the tables; returns how many there were."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        done = len(self.paths)
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)
        return done


_SCRATCH: list[str] = []
_OPEN: ContextVar[tuple[Intermediates, ...]] = ContextVar("open_intermediates", default=())


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[Intermediates]:
    """Collect the tables that results composed inside the block write, apart from those of other results.

    They stay after the block, since a frame made in it may not have been read yet: call ``release`` of the handle then.
    Blocks may be nested; a table belongs to the innermost one.
    """
    handle = Intermediates(spark)
    token = _OPEN.set((*_OPEN.get(), handle))
    try:
        yield handle
    finally:
        _OPEN.reset(token)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared root for one intermediate table, remembered for its release."""
    path = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    handles = _OPEN.get()
    (handles[-1].paths if handles else _SCRATCH).append(path)
    return path


#: Bytes of the tables read for which one more partition is made.
BYTES_PER_PARTITION = 8 << 20


def partitions_for(*frames: DataFrame) -> int:
    """By the size of the tables that are read, and no fewer than the session's shuffle partitions.

    The plan's own estimate is of no use here: that of a join is the product of its sides. Tables of unknown size, which
    Spark takes for the largest possible, do not count.
    """
    sizes = []
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes += [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    by_size = min(sum(n for n in sizes if n < 1 << 62) // BYTES_PER_PARTITION, 100_000)
    return max(int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), by_size)


@contextmanager
def shuffles_of(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Joins and aggregates that run inside the block are dealt over so many partitions, if the session has fewer.

    A task's share then stays the same however large the tables are; partitions by size are not merged again.
    """
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    if partitions <= int(before["spark.sql.shuffle.partitions"]):
        yield
        return
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def pinned(df: DataFrame) -> DataFrame:
    """The frame written once as Parquet in the shared folder, for plans that read it several times.

    What it is made from is shuffled into partitions by the size of the tables read.
    """
    path = scratch_path(df.sparkSession, "pinned")
    with shuffles_of(df.sparkSession, partitions_for(df)):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of all results composed outside ``intermediates``; returns how many there were.

    Frames not yet read lose their tables too; use ``intermediates`` where several results are under way.
    """
    return Intermediates(spark, _SCRATCH).release()
