"""Preprocessing as pipeline stages: fitted, saved, loaded, and the same afterwards."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from clustrum.operators import preprocess
from clustrum.operators.ml import TablePreprocessor, TablePreprocessorModel
from clustrum.operators.preprocess import STRATEGIES, Preprocessor
from clustrum.operators.schema import ColumnTypes


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, float(i * 37 % 101) if i % 9 else None, float(i * i % 53), "xyz"[i % 3] if i % 7 else None, i % 4) for i in range(120)]
    return spark.createDataFrame(rows, "Id long, a double, b double, c string, d int")


def as_rows(df):
    return sorted((r["Id"], tuple(r["features"])) for r in df.collect())


@pytest.mark.parametrize(("name", "inline"), [("standard+onehot", 256), ("standard+onehot+yeo", 256), ("quantile+ordinal", 256), ("robust+ordinal", 2), ("robust+freq", 2), ("quantile+freq+yeo", 2)])
def test_saved_and_loaded(table, tmp_path, monkeypatch, name, inline):
    """The loaded model gives what the fitted one gives, with code tables inside and beside it."""
    monkeypatch.setattr(preprocess, "INLINE_CATEGORIES", inline)
    types = {"continuous": ["a", "b"], "categorical": ["c", "d"], "excluded": ["Id"]}
    model = TablePreprocessor(strategy=name, **types).fit(table)
    want = as_rows(Preprocessor(ColumnTypes(**types), STRATEGIES[name]).fit(table).transform(table))
    assert as_rows(model.transform(table)) == want
    model.write().overwrite().save(f"{tmp_path}/model")
    assert as_rows(TablePreprocessorModel.load(f"{tmp_path}/model").transform(table)) == want


def test_in_a_pipeline(table, tmp_path):
    stage = TablePreprocessor(strategy="robust+ordinal", excluded=["Id"], outputCol="x")
    pipeline = Pipeline(stages=[stage])
    pipeline.save(f"{tmp_path}/pipeline")
    fitted = Pipeline.load(f"{tmp_path}/pipeline").fit(table)
    fitted.save(f"{tmp_path}/fitted")
    unseen = table.withColumn("c", F.lit("other")).withColumn("extra", F.lit(1)).withColumn("X", F.lit("clash"))
    one, two = fitted.transform(unseen), PipelineModel.load(f"{tmp_path}/fitted").transform(unseen)
    assert one.columns == ["Id", "a", "b", "c", "d", "extra", "x"] and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    with pytest.raises(ValueError, match="unknown strategy"):
        TablePreprocessor(strategy="none", excluded=["Id"]).fit(table)
