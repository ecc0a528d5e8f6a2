"""Session set-up and the scale limits that every operator works under."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

GROUP_ROWS_CONF = "editlore.group.rows"
GROUP_ROWS = 4_000_000  # rows of one group that one task may hold

BROADCAST_ROWS = 100_000  # rows of a dimension; with labels and descriptions well under 100 MB

# Shuffled bytes that one task is given. Rows are several times as large in memory, and a task sorts them for one scan after another.
TASK_BYTES = 8 << 20

# The limit grows with the log, so that it has at most this many groups above it: their keys can be broadcast.
MAX_HOT_GROUPS = 200_000


class Scale:
    """How large a change log is, and which of its groups are too large for one task.

    A log that fits into the limit as a whole cannot contain a larger group; nothing is counted then. For a larger
    log the rows of each statement are counted once (a narrow scan with map-side combine), coarser keys are summed
    from that, and the few groups above the limit are kept as a table with at most ``MAX_HOT_GROUPS`` rows.
    """

    LEVELS = (("entity_id", "property_id", "value_id"), ("entity_id", "property_id"), ("entity_id",))

    def __init__(self, rows: int, group_rows: int = GROUP_ROWS, logs: Callable[[], DataFrame] | None = None):
        """``logs`` gives key columns and ``weight`` of all rows that may meet in one scan; used above the limit only."""
        self.rows = rows
        self.limit = max(group_rows, rows // MAX_HOT_GROUPS)
        self._logs = logs
        self._counts: DataFrame | None = None
        self._hot: dict[tuple[str, ...], DataFrame | None] = {}

    @property
    def fits(self) -> bool:
        return self.rows <= self.limit

    def level(self, keys: Sequence[str]) -> tuple[str, ...] | None:
        """The finest key of the log that ``keys`` refine: groups of ``keys`` are no larger than its groups."""
        return next((level for level in self.LEVELS if set(level) <= set(keys)), None)

    def hot(self, level: tuple[str, ...]) -> DataFrame | None:
        """Keys of the groups above the limit, None if there are none."""
        if self.fits:
            return None
        if level not in self._hot:
            self._hot[level] = hot_groups(self._counted(), level, self.limit, F.sum("weight"))
        return self._hot[level]

    def shared_by(self, parts: int) -> Scale:
        """The scale of steps that hold ``parts`` values per row of a group; rows per key are counted once for both."""
        if parts <= 1:
            return self
        return Scale(self.rows, max(self.limit // parts, 1), self._counted)

    def _counted(self) -> DataFrame:
        """Rows of each statement as logs of their own."""
        if self._counts is None:
            self._counts = materialise(self._logs().groupBy(*self.LEVELS[0]).agg(F.sum("weight").alias("weight")))
        return self._counts

    @classmethod
    def configured(cls, spark: SparkSession, rows: int, logs: Callable[[], DataFrame] | None = None) -> Scale:
        return cls(rows, int(spark.conf.get(GROUP_ROWS_CONF, str(GROUP_ROWS))), logs)


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int, size: Column | None = None) -> DataFrame | None:
    """Keys of the groups with more than ``limit`` rows, None if there are none."""
    counted = df.groupBy(*keys).agg((F.count(F.lit(1)) if size is None else size).alias("_n"))
    found = materialise(counted.filter(F.col("_n") > limit).select(*keys))
    return None if found.isEmpty() else found


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the results and the plans rely on; safe to call repeatedly."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed join even where a later operator then needs one more shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # The JVM never compiles longer methods; wide rows then run interpreted where a whole stage is one method.
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    for key, value in settings.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def spread_shuffles(spark: SparkSession, rows: int) -> None:
    """Start shuffles of large logs with enough partitions (about a million rows each); adaptive execution merges
    small ones again, up to ``TASK_BYTES``. Sessions that chose a number or a size themselves keep it."""
    chosen = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES)}
    wanted = min(rows // 1_000_000, 100_000)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        chosen["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(wanted)
    for key, value in chosen.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def _checkpoint_folder(spark: SparkSession) -> bool:
    """Whether there is a shared folder for checkpoints; the one of ``spark.checkpoint.dir`` is put to use."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir() is not None


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once for several readers and cut its lineage.

    On a cluster this is a reliable checkpoint in the shared folder, which survives lost executors; without one
    (tests) it is a persisted, recomputable frame.
    """
    return df.checkpoint() if _checkpoint_folder(df.sparkSession) else df.persist(StorageLevel.MEMORY_AND_DISK)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: inside the checkpoints', or a temporary one of a local session."""
    if _checkpoint_folder(spark):
        return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp()


def model_folder(spark: SparkSession) -> str:
    """Where models of this application are kept for its other queries: beside its checkpoints, or in a temporary folder of a local session."""
    context = spark.sparkContext
    if _checkpoint_folder(spark):
        return f"{context.getCheckpointDir()}/models"
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/editlore-{context.applicationId}/models"


def shared(df: DataFrame, scale: Scale) -> DataFrame:
    """A step with several readers: computed once for a large log, where a small one is as quickly computed again."""
    return df if scale.fits else materialise(df)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A dimension for joins: broadcast if it has at most ``rows`` rows, else left to shuffled joins."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
