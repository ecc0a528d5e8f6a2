"""Reading and writing tables as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPORT_ROWS_PER_FILE = 1_000_000
BATCH = "batch"  # partition column of appended tables

CHANGE_SCHEMA = (
    "revision_id bigint, entity_id bigint, entity_label string, property_id bigint, property_label string, value_id string, "
    "timestamp timestamp, action string, change_target string, label string, change_type string, is_reverted int, "
    "reversion int, reversion_timestamp timestamp, new_datatype string, new_value_label string, new_value string, "
    "old_value string, old_datatype string, old_value_label string")
REVISION_SCHEMA = (
    "revision_id bigint, entity_id bigint, timestamp timestamp, year int, user_type string, user_id bigint, username string, "
    "comment string")
REFERENCE_SCHEMA = (
    "revision_id bigint, entity_id bigint, property_id bigint, value_id string, timestamp timestamp, action string, "
    "change_target string, ref_hash string, ref_property_id bigint, new_value string")


def column_names(schema: str) -> list[str]:
    return T.StructType.fromDDL(schema).fieldNames()


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, multiline: bool = False) -> DataFrame:
    """A CSV with header; only ``columns`` are parsed. Missing change targets mean value changes.

    ``multiline`` allows line breaks inside quoted values; such a file cannot be split and is read by one task.
    """
    # RFC quoting: JSON values double their quotes, nothing is escaped by backslash.
    # An empty field is NULL, a quoted empty one an empty text; with another word for NULL the reader tells them apart.
    df = (spark.read.schema(schema).option("header", True).option("escape", '"').option("nullValue", r"\N")
          .option("multiLine", multiline).csv(path))
    if "change_target" in df.columns:
        df = df.fillna("", ["change_target"])
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, rows_per_file: int = EXPORT_ROWS_PER_FILE) -> None:
    """Write with all microseconds; ``read_csv`` gives the same rows back."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
     .option("maxRecordsPerFile", rows_per_file).csv(path))


def export_active_entities(entities: DataFrame, path: str, more_than: int = 20, rows_per_file: int = EXPORT_ROWS_PER_FILE) -> None:
    """Entities with more than ``more_than`` value changes, one file per million rows. Partitions are written in
    parallel; nothing is paged by offset."""
    write_csv(active_entities(entities, more_than), path, rows_per_file)


def active_entities(entities: DataFrame, more_than: int = 20) -> DataFrame:
    return entities.filter(F.col("num_value_changes") > more_than)


def load_dimension(spark: SparkSession, path: str, schema: str, columns: list[str], table: str) -> None:
    """Replace a dimension table by the given columns of a CSV."""
    read_csv(spark, path, schema, columns).write.mode("overwrite").saveAsTable(table)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Features, train and test sets, predictions and metrics; ``by`` splits them into folders."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*by) if by else writer).save(path)


def sparql_bindings(results: DataFrame, column: str, variables: list[str]) -> DataFrame:
    """Rows out of SPARQL JSON results: one column per variable, NULL where it is unbound."""
    term = T.StructType([T.StructField("value", T.StringType())])
    row = T.StructType([T.StructField(v, term) for v in variables])
    schema = T.StructType([T.StructField("results", T.StructType([T.StructField("bindings", T.ArrayType(row))]))])
    parsed = results.select(F.explode(F.from_json(column, schema)["results"]["bindings"]).alias("_b"))
    return parsed.select(*(F.col(f"_b.{v}.value").alias(v) for v in variables))


def exists(spark: SparkSession, path: str) -> bool:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name)


def append_missing(df: DataFrame, path: str, key: str, batches: int = 16) -> int:
    """Append the rows whose key is not in ``path`` yet, so an interrupted job continues where it stopped; returns their number.

    Rows go in ``batches`` by hash of the key. A batch is written beside the data, where readers of ``path`` do not look, and published by one
    rename of its folder: a job that is stopped keeps its finished batches and leaves no half one. Each batch computes only its own rows,
    so what it costs to make a row is paid once; the key column of both sides is read once per batch. What is there already is known from the
    data itself, not from a bookmark. Of rows that share a key in ``df`` one is written, and NULL is a key. One writer at a time.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    run, rows = uuid.uuid4().hex, 0
    for batch in range(batches):
        in_batch = F.pmod(F.xxhash64(key), F.lit(batches)) == batch
        once = df.filter(in_batch).dropDuplicates([key])
        missing = once
        if fs.exists(folder) and any(not s.getPath().getName().startswith("_") for s in fs.listStatus(folder)):
            there = spark.read.parquet(path).filter(in_batch).select(F.col(key).alias("_there"))
            missing = once.join(there, F.col(key).eqNullSafe(F.col("_there")), "left_anti")
        pending = f"{path}/_pending"
        missing.write.mode("overwrite").parquet(pending)
        written = spark.read.schema(missing.schema).parquet(pending).count()  # out of the footers
        if not written:
            continue
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BATCH}={run}-{batch:05d}")
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(pending), done):
            raise OSError(f"cannot publish {done}")
        rows += written
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_pending"), True)
    return rows
