"""Reproducible samples: the order is a hash of the row's identity, never of its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlore.operators.quantiles import quantile_columns
from editlore.session import Scale
from editlore.vocabulary import SANDBOX_ENTITIES


HASH_BITS = 52  # a double holds these exactly


def hash_order(*identity: str, seed: int = 42) -> Column:
    """A number that depends on the identity and the seed only; the same in any engine that knows MD5."""
    digest = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in identity), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def no_sandboxes(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("entity_id").isin(SANDBOX_ENTITIES))


def top_by_hash(df: DataFrame, group: str, identity: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of every group. The rank limit is applied before the shuffle as well, so no group travels whole."""
    line = Window.partitionBy(group).orderBy(hash_order(*identity, seed=seed), *identity)
    return df.withColumn("_rank", F.row_number().over(line)).filter(F.col("_rank") <= n).drop("_rank")


def sample_entities(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` entities of every property, none of them a sandbox."""
    return top_by_hash(no_sandboxes(pairs).select("entity_id", "property_id").distinct(), "property_id",
                       ["entity_id", "property_id"], n, seed)


def limited_pairs(pairs: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """At most ``n`` (entity, property) rows, the same ones every time; None keeps all.

    A hash threshold from one count leaves a little more than ``n`` rows, and only those are sorted.
    """
    found = no_sandboxes(pairs).select("entity_id", "property_id")
    if n is None:
        return found
    total = found.count()
    if total <= n:
        return found
    order = hash_order("entity_id", "property_id", seed=seed)
    # Twenty deviations above the expected number, so that no more than chance can leave too few.
    share = min(1.0, (n + 20 * n**0.5 + 100) / total)
    return found.filter(order < int(share * 2**HASH_BITS)).orderBy(order, "entity_id", "property_id").limit(n)


def _within_share(df: DataFrame, group: list[str], identity: list[str], share: float, scale: Scale, seed: int) -> DataFrame:
    """Add ``_within``: true for the ``share`` of each group that comes first in hash order (one row more or less).

    The cut-off is an exact quantile of the hashes, so large groups are neither sorted nor numbered as a whole.
    """
    hashed = df.withColumn("_hash", hash_order(*identity, seed=seed).cast("double"))
    cuts = quantile_columns(hashed, group, {"_cut": F.col("_hash")}, [share], scale)
    return hashed.join(cuts, group).withColumn("_within", F.col("_hash") <= F.col("_cut")[0]).drop("_hash", "_cut")


def keep_share(
    df: DataFrame, condition: Column, share: float, identity: list[str], scale: Scale, seed: int = 42
) -> DataFrame:
    """Keep ``share`` of the rows that meet ``condition`` and all the others."""
    marked = df.withColumn("_meets", F.coalesce(condition, F.lit(False)))
    split = _within_share(marked, ["_meets"], identity, share, scale, seed)
    return split.filter(~F.col("_meets") | F.col("_within")).drop("_meets", "_within")


def stratified_split(
    df: DataFrame, label: str, identity: list[str], scale: Scale, test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test) in which every class gives the same share to the test set."""
    split = _within_share(df, [label], identity, test_share, scale, seed).select(*df.columns, "_within")
    return split.filter(~F.col("_within")).drop("_within"), split.filter("_within").drop("_within")
