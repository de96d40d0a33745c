"""Preprocessing as a pyspark.ml estimator and model: stages of a pipeline that are fitted, saved and loaded."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .preprocess import STRATEGIES, Preprocessor, Strategy
from .schema import ColumnTypes, infer_column_types


class _Columns(Params):
    """Parameters that the estimator and its model share."""

    strategy = Param(Params._dummy(), "strategy", "the name of a strategy", TypeConverters.toString)
    continuous = Param(Params._dummy(), "continuous", "numeric columns to scale", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "columns to encode", TypeConverters.toListString)
    excluded = Param(Params._dummy(), "excluded", "columns that are no features, such as ids", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "the column of the features, an array of doubles", TypeConverters.toString)


class TablePreprocessor(Estimator, _Columns, DefaultParamsWritable, DefaultParamsReadable):
    """Fits a Preprocessor; columns that are neither named nor excluded have their types inferred if none is named."""

    @keyword_only
    def __init__(self, *, strategy: str = "standard+onehot", continuous: list[str] | None = None, categorical: list[str] | None = None, excluded: list[str] | None = None, outputCol: str = "features"):
        super().__init__()
        self._setDefault(strategy="standard+onehot", continuous=[], categorical=[], excluded=[], outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> TablePreprocessorModel:
        own = {p.name: self.getOrDefault(p) for p in self.params}
        if own["strategy"] not in STRATEGIES:
            raise ValueError(f"unknown strategy {own['strategy']!r}")
        types = ColumnTypes(own["continuous"], own["categorical"], own["excluded"])
        if not types.continuous and not types.categorical:
            types = infer_column_types(dataset, tuple(types.excluded))
        return self._copyValues(TablePreprocessorModel(Preprocessor(types, STRATEGIES[own["strategy"]]).fit(dataset)))


class TablePreprocessorModel(Model, _Columns, MLWritable, MLReadable):
    """Adds the features to a table, whatever its other columns; a column of the output's name is replaced."""

    def __init__(self, preprocessor: Preprocessor | None = None):
        super().__init__()
        self._setDefault(outputCol="features")
        self.preprocessor = preprocessor

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name = self.getOrDefault(self.outputCol)
        keep = [c for c in dataset.columns if c.lower() != name.lower()]
        made = self.preprocessor.transform(dataset, keep=[*keep])
        return made.select(*(F.col(f"`{c}`") for c in keep), F.col("features").alias(name)) if "features" not in map(str.lower, keep) else made.toDF(*keep, name)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    """Parameters and small tables as JSON in the metadata; code tables of many values as Parquet beside it."""

    def __init__(self, instance: TablePreprocessorModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        p = self.instance.preprocessor
        held = {k: getattr(p, k) for k in ("medians", "centre", "scale", "grids", "ranks", "lambdas")}
        held |= {"types": asdict(p.types), "strategy": asdict(p.strategy), "numeric": sorted(p.numeric), "tables": sorted(p.tables)}
        held |= {"categories": {c: [[v["z"], v["v"]] for v in values] for c, values in p.categories.items()}, "shares": {c: [[v["z"], v["v"], s] for v, s in values] for c, values in p.shares.items()}}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"preprocessor": json.dumps(held)})
        for i, c in enumerate(sorted(p.tables)):
            p.tables[c].write.parquet(f"{path}/tables/{i}")


class _Reader(MLReader):
    def __init__(self, cls: type[TablePreprocessorModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TablePreprocessorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        held = json.loads(metadata["preprocessor"])
        p = Preprocessor(ColumnTypes(**held["types"]), Strategy(**held["strategy"]))
        for k in ("medians", "centre", "scale", "grids", "ranks", "lambdas"):
            setattr(p, k, held[k])
        p.numeric = set(held["numeric"])
        p.categories = {c: [Row(z=z, v=v) for z, v in values] for c, values in held["categories"].items()}
        p.shares = {c: [(Row(z=z, v=v), s) for z, v, s in values] for c, values in held["shares"].items()}
        p.tables = {c: self.sparkSession.read.parquet(f"{path}/tables/{i}") for i, c in enumerate(held["tables"])}
        model = self.cls(p)
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
