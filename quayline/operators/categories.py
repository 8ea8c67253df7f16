"""Rare categories as one: an estimator whose model keeps the frequent names in a table, not in a plan or on the driver."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .curation import PORT_ROWS

RARE = "infrequent"


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns of names", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "columns with rare names as one", TypeConverters.toListString)
    minRows = Param(Params._dummy(), "minRows", "rows that a name needs to stay", TypeConverters.toInt)

    def _io(self) -> list[tuple[str, str]]:
        return list(zip(self.getOrDefault(self.inputCols), self.getOrDefault(self.outputCols), strict=True))


class RareCategories(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Counts the names of each column; names of fewer than minRows rows become RARE, and so do names that were never seen. Null stays null."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None, minRows: int = 10) -> None:
        super().__init__()
        self._setDefault(minRows=10)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, rows: DataFrame) -> RareCategoriesModel:
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("name")) for c in self.getOrDefault(self.inputCols))))
        names = rows.select(each.alias("x")).where("x.name IS NOT NULL").groupBy("x.column", "x.name").agg(F.count("*").alias("n")).where(F.col("n") >= self.getOrDefault(self.minRows))
        model = RareCategoriesModel(kept(names.select("column", "name")))
        return self._copyValues(model)


class RareCategoriesModel(_Columns, Model, MLReadable, MLWritable):
    """names: column, name of all that stay; joined when rows are transformed, by broadcast only if they are few."""

    def __init__(self, names: DataFrame | None = None) -> None:
        super().__init__()
        self.names = names
        self.few = names is not None and names.limit(PORT_ROWS + 1).count() <= PORT_ROWS

    def _transform(self, rows: DataFrame) -> DataFrame:
        for c, out in self._io():
            own = self.names.where(F.col("column") == c).select(F.col("name").alias("_name"))
            own = F.broadcast(own) if self.few else own
            new = F.when(F.col(c).isNotNull(), F.coalesce("_name", F.lit(RARE)))
            rows = rows.join(own, F.col(c) == F.col("_name"), "left").withColumn(out, new).drop("_name")
        return rows

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: RareCategoriesModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.names.write.parquet(f"{path}/names")


class _Reader(MLReader):
    def load(self, path: str) -> RareCategoriesModel:
        spark: SparkSession = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = RareCategoriesModel(spark.read.parquet(f"{path}/names"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
