"""A change log: the tables every analysis reads, each opened when first used."""

from __future__ import annotations

from functools import cache, cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlore.operators.ordered import STATEMENT
from editlore.session import Scale, prepare, spread_shuffles
from editlore.sources.views import view_sql


class Tables:
    """Driver tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder
        self.table = cache(self._table)
        self.view = cache(self._view)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        text = view_sql(name, "spark")
        used = {t: self.table(t) for t in ("events", "part", "embeddings") if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def scale(self) -> Scale:
        # A count without columns is answered from the Parquet footers. An event gives at most one value change, two
        # reference rows and one qualifier row, weighted as below.
        rows = (1 + 2 * 2 + 2) * self.table("events").count()
        spread_shuffles(self.spark, rows)
        return Scale.configured(self.spark, rows, self._weighted_keys)

    def _weighted_keys(self) -> DataFrame:
        """Statements of all logs. Intervals put two rows on the time axis, so their logs count twice."""
        weights = {"raw_change": 1, "reference_change": 2, "qualifier_change": 2}
        keys = [self.view(name).select(*STATEMENT, F.lit(w).alias("weight")) for name, w in weights.items()]
        return reduce(DataFrame.unionByName, keys)

    @property
    def log(self) -> ChangeLog:
        return ChangeLog(self)


class ChangeLog:
    """Value, reference and qualifier changes, their revisions and the dimension tables."""

    def __init__(self, tables: Tables):
        self.tables = tables

    @property
    def value_change(self) -> DataFrame:
        """Changes of values and ranks, with the value they set."""
        return self.tables.view("raw_change")

    def __getattr__(self, name: str) -> DataFrame:
        """The other tables go by the names of their views."""
        return self.tables.view(name)
