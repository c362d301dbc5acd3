"""Inference by a model in a file."""

import math

import pandas as pd
import pytest

from helixmill.plans import pipelines


@pytest.fixture
def load():
    def of(content):  # nested, so that it travels with the plan
        weight = float(content)
        return lambda texts: pd.DataFrame({0: [0.0] * len(texts), 1: [weight * len(x) for x in texts]})

    return of


def test_scores_by_a_model_file(spark, tmp_path, load):
    (tmp_path / "model").write_text("0.5")
    path = f"file://{tmp_path}/model"
    texts = ["A" * n for n in range(9)] + [None, "", "AA"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, tokens string").repartition(3)
    got = {r.i: (r.tokens, r.prob) for r in pipelines.scored_by_model(df, path, load, batch=2).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i][0] == text and math.isclose(got[i][1], 1 / (1 + math.exp(-0.5 * len(text or ""))))
    assert pipelines.scored_by_model(df, f"file://{tmp_path}", load).count() == len(texts)  # the folder of one file
    none = pipelines.scored_by_model(df.where("false"), path, load)
    assert none.columns == ["i", "tokens", "prob"] and none.collect() == []


def test_model_files_that_are_refused(spark, tmp_path, load):
    df = spark.createDataFrame([("A",)], "tokens string")
    (tmp_path / "a").write_text("0.25")
    with pytest.raises(ValueError, match="at most 3 bytes"):
        pipelines.scored_by_model(df, f"file://{tmp_path}", load, most=3)
    (tmp_path / "b").write_text("1")
    with pytest.raises(ValueError, match="one model file"):
        pipelines.scored_by_model(df, f"file://{tmp_path}", load)
