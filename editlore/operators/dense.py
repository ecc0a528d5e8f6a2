"""Vectors with all their values in place."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame


class DenseVectors(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The vectors of a column as dense ones, with the names of their slots.

    An assembled vector is sparse where most slots are zero, and a tree then searches the places of its values at every node.
    """

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name = self.getInputCol()
        dense = array_to_vector(vector_to_array(name))
        return dataset.withColumn(self.getOutputCol(), dense.alias(self.getOutputCol(), metadata=dataset.schema[name].metadata)).drop(name)
