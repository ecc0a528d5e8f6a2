"""Helpers of the corpus operators: shared tables, partition counts, running sums, column hygiene."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FOLDER = "spark.checkpoint.dir"
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that names none (tests)."""
    folder = spark.conf.get(_FOLDER, None) or spark.sparkContext.getConf().get(_FOLDER)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_FOLDER} to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="corpus-")
    return _own_folders[app]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: computed once, short lineage, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(spark: SparkSession, rows: int, per_task: int = 250_000) -> int:
    """Partitions for ``rows`` narrow rows: as many as they fill, not more than the session's shuffles have unless needed."""
    return max(1, -(-rows // per_task))


def texts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Exactly the two columns an operator reads, null texts as empty ones; further columns may have any name."""
    return df.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))


def running(df: DataFrame, keys: Sequence[str], size: str, out: str) -> DataFrame:
    """``df`` with the sum of ``size`` over all rows before each in the order of ``keys``, as column ``out``.

    Rows are range-partitioned by the keys; each task sums its rows, and the sums of the tasks (one row per partition) are
    added up and broadcast. Rows with equal keys keep any order.
    """
    spark = df.sparkSession
    schema = df.schema
    placed = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)

    def add(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes) + total
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(ends - sizes)],
                names=[*batch.schema.names, "_part", "_before"])

    from pyspark.sql import types as T

    wide = T.StructType([*schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())])
    table = stored(placed.mapInArrow(add, wide))
    return offset_by_part(table, size).withColumn(out, F.col("_before") + F.col("_offset")).drop("_part", "_before", "_offset")


def offset_by_part(table: DataFrame, size: str) -> DataFrame:
    """``table`` with ``_offset``, the sum of ``size`` in all partitions (``_part``) before its own: one row per partition is broadcast."""
    sums = table.groupBy("_part").agg(F.sum(size).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_offset"))
    return table.join(F.broadcast(offsets), "_part")


def add_column(docs: DataFrame, name: str, kind: str, of_texts, text: str = "text") -> DataFrame:
    """``docs`` plus a column that ``of_texts(list of texts) -> list or array`` computes in Arrow batches; all other columns pass through,
    and one of the same name is replaced. Null texts are given as empty ones."""
    from pyspark.sql import types as T

    kept = [f for f in docs.schema.fields if f.name != name]
    field = T._parse_datatype_string(f"x {kind}").fields[0].dataType
    arrow = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}.get(kind)
    schema = T.StructType([*kept, T.StructField(name, field)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(text)):
                values = ["" if v is None else v for v in part.column(part.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(of_texts(values), arrow)], names=[*part.schema.names, name])

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release() -> None:
    """Give memory that was freed back to the system: workers live on, and the next operator's memory comes on top."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do this by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, most: int = 500_000):
    """Slices of a batch with about ``most`` bytes of text at most, or one row."""
    import pyarrow.compute as pc

    ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64)))
    start = 0
    while start < len(batch):
        before = ends[start - 1] if start else 0.0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    release()


def fold(key: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; a null id is in fold -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts, F.lit(-1))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, parts: int, held_out: int, max_bytes: int = 65_536) -> list[tuple[str, int]]:
    """A bounded sample of (text, label) to fit on: of each label at most ``per_class`` documents in the order of a hash of the id,
    none from fold ``held_out`` of ``parts``, none with a null or longer text than ``max_bytes``."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).filter(
        F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & (fold("_id", parts) != held_out))
    chosen = None
    for value in (0, 1):
        some = rows.filter(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = F.broadcast(chosen.dropDuplicates(["_id"]))  # at most 2 * per_class rows
    texts_ = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).filter(F.octet_length("_text") <= max_bytes)
    return [(r._text, r._label) for r in texts_.join(chosen, "_id").orderBy(F.xxhash64("_id"), "_id").limit(4 * per_class).select("_text", "_label").collect()]


def stretched(values: np.ndarray, cut: float, at: float = 0.3) -> np.ndarray:
    """Values from 0 to 1 stretched so that ``cut`` becomes ``at``; order is kept."""
    cut = min(max(cut, 1e-6), 1 - 1e-6)
    return np.where(values < cut, values / cut * at, at + (values - cut) / (1 - cut) * (1 - at))


def best_cut(values: np.ndarray, truth: np.ndarray) -> float:
    """The cut with the highest mean of both classes' accuracies, in the middle of its gap."""
    order = np.argsort(values, kind="stable")
    v, t = values[order], truth[order]
    below = np.concatenate([[0], np.cumsum(1 - t)]) / max(1, (1 - t).sum())
    above = 1 - np.concatenate([[0], np.cumsum(t)]) / max(1, t.sum())
    edges = np.concatenate([[True], v[1:] > v[:-1], [True]])
    gain = np.where(edges, below + above, -1)
    k = int(np.flatnonzero(gain == gain.max()).mean()) if (gain == gain.max()).sum() == 1 else int(np.flatnonzero(gain == gain.max())[0])
    low, high = v[k - 1] if k else 0.0, v[k] if k < len(v) else 1.0
    return float((low + high) / 2)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression (last one constant), classes weighted evenly, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + ridge * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w
