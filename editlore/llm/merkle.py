"""Merkle fixity audit of archive replicas.

Records are hashed where they lie. A replica's tree covers ranges of its offsets: a leaf is the hash of the digests of the records that begin in one range
of ``RANGE`` bytes, in the order of their offsets, and a node is the hash of up to ``FAN`` nodes below it, up to a root. So no node gathers more than
``FAN`` children, and no leaf more than the records that fit into a range. Two trees are compared from the root down; only children of nodes that
differ are looked at, and only the records of differing ranges are compared one by one.

Records without a digest (null payload) are hashed as empty. A record at an offset that one replica lacks is missing there. Equal records are
told apart by their offsets. Empty replicas have no tree and are equal to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editlore.llm import common

RANGE = 65_536
FAN = 16


def warc_record(url: str | Column, body: str | Column) -> Column:
    """A WARC response record as text; nulls are empty."""
    url, body = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (url, body))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
                    F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def tree(records: DataFrame, size: int, fan: int = FAN, range_bytes: int = RANGE) -> DataFrame:
    """Nodes (level, node, digest) over ``records`` (offset, digest) of an archive of ``size`` bytes; the last level has the root."""
    level, width = 0, range_bytes
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "digest"))), lambda r: r.digest), "")
    nodes = common.stored(records.groupBy(F.expr(f"offset div {range_bytes}").alias("node")).agg(F.sha2(ordered, 256).alias("digest")))
    out = nodes.select(F.lit(0).alias("level"), "node", "digest")
    while width < size:
        level, width = level + 1, width * fan
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda r: F.concat(r.node.cast("string"), F.lit(":"), r.digest)), "\n")
        nodes = nodes.groupBy(F.expr(f"node div {fan}").alias("parent")).agg(F.sha2(children, 256).alias("digest")).withColumnRenamed("parent", "node")
        out = out.unionByName(nodes.select(F.lit(level).alias("level"), "node", "digest"))
    return common.stored(out)


def audit(one: DataFrame, other: DataFrame, fan: int = FAN, range_bytes: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Differences between two replicas (offset, digest): a table of records (offset, state: altered, missing or extra in ``other``), and the
    nodes that were visited and differ (level, node)."""
    size = max((r[0] or 0) + 1 for r in (x.agg(F.max("offset")).first() for x in (one, other)))
    trees = [tree(x, size, fan, range_bytes) for x in (one, other)]
    top = 0
    while range_bytes * fan ** top < size:
        top += 1
    suspects, visited = None, None
    for level in range(top, -1, -1):
        sides = [t.filter(F.col("level") == level).select("node", "digest") for t in trees]
        if suspects is not None:
            sides = [s.join(suspects.withColumnRenamed("node", "_up"), F.expr(f"node div {fan}") == F.col("_up"), "left_semi") for s in sides]
        a, b = sides[0].withColumnRenamed("digest", "a"), sides[1].withColumnRenamed("digest", "b")
        suspects = common.stored(a.join(b, "node", "full").filter("not (a <=> b)").select("node"))
        level_rows = suspects.select(F.lit(level).alias("level"), "node")
        visited = level_rows if visited is None else visited.unionByName(level_rows)
        if suspects.isEmpty():
            break
    ranges = suspects.withColumnRenamed("node", "_range")
    a, b = (x.select("offset", F.col("digest").alias(n)).join(ranges, F.expr(f"offset div {range_bytes}") == F.col("_range"), "left_semi") for x, n in ((one, "a"), (other, "b")))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("altered")
    return a.join(b, "offset", "full").filter("not (a <=> b)").select("offset", state.alias("state")), visited


def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records of an archive, audited against a replica with damage at urls whose hash begins with 0 (a changed body) or 1 (lost)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    mark = F.substring(F.sha2(F.coalesce("url", F.lit("")), 256), 1, 1)
    damaged = F.when(mark == "0", F.translate(F.coalesce("html", F.lit("")), "e", "a")).otherwise(F.coalesce("html", F.lit("")))
    rows = pages.select(
        "page_id", F.octet_length(warc_record("url", "html")).cast("long").alias("length"), F.sha2(warc_record("url", "html"), 256).alias("digest"),
        F.when(mark != "1", F.sha2(warc_record("url", damaged), 256)).alias("replica"))
    records = common.stored(common.running(rows, ["page_id", "digest"], "length", "offset"))
    found, _ = audit(records.select("offset", "digest"), records.filter("replica is not null").select("offset", F.col("replica").alias("digest")))
    return records.join(found, "offset", "left").select("page_id", "offset", "length", "digest", F.coalesce("state", F.lit("intact")).alias("state"))


SQL = r"""
WITH p AS (
  SELECT page_id, substr(sha256(coalesce(url, '')), 1, 1) AS mark, coalesce(html, '') AS body,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' AS head, chr(13) || chr(10) || chr(13) || chr(10) AS gap
  FROM pages),
r AS (SELECT page_id, mark, body, head || CAST(strlen(body) AS VARCHAR) || gap || body || gap AS record FROM p),
d AS (SELECT page_id, mark, body, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest FROM r)
SELECT page_id, CAST(coalesce(sum(length) OVER (ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       length, digest, CASE WHEN mark = '1' THEN 'missing' WHEN mark = '0' AND contains(body, 'e') THEN 'altered' ELSE 'intact' END AS state
FROM d
"""
