"""Repetitions in lots, each gone before the next; a sample that tasks thin out before they send it."""

import os

import numpy as np
import pytest

from foldwise.operators import neighbors
from foldwise.plans import experiment
from foldwise.session import checkpoint_dir, release_tables
from foldwise.sources.sink import write_and_read

CFG = {"feature_selection": ["none"], "data_list": ["a"], "classifiers": ["nb_1"], "n_components": ["2"], "folds": "2"}


@pytest.fixture
def slots(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(i % 2, 1, 2)), i % 2) for i in range(50)] + [(50, 0.1, 0.2, 1), (51, 0.3, 0.1, 1)]
    df = write_and_read(spark.createDataFrame(rows, "row_id long, x double, y double, DX int"), "lot_rows")
    yield {"a": df}
    release_tables(df)


def test_lots_give_the_same_and_leave_their_metrics_only(spark, slots, monkeypatch):
    whole = experiment.run_many("c", CFG, slots, [1, 2])[0].collect()
    before = set(os.listdir(checkpoint_dir(spark).removeprefix("file:")))
    monkeypatch.setattr(experiment, "REPEATED_ROWS", 60)
    calls = []
    many = experiment.cross_validate_many
    monkeypatch.setattr(experiment, "cross_validate_many", lambda cfg, s, seeds, *a: calls.append(list(seeds)) or many(cfg, s, seeds, *a))
    lots = experiment.run_many("c", CFG, slots, [1, 2])[0]
    assert calls == [[1], [2]]
    left = set(os.listdir(checkpoint_dir(spark).removeprefix("file:"))) - before
    assert {p.split("-")[0] for p in left} == {"cv_metrics"} and len(left) == 2
    key = lambda r: (r["repetition"], r["fold"], r["metric"], str(r["class"]))
    for a, b in zip(sorted(whole, key=key), sorted(lots.collect(), key=key), strict=True):
        assert key(a) == key(b) and a["value"] == pytest.approx(b["value"], nan_ok=True)


def test_a_sample_is_thinned_out_in_the_tasks(spark):
    df = spark.range(20_000).withColumnRenamed("id", "__id")
    few = neighbors._hashed_first(df, 500, 20_000)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan
    from pyspark.sql import functions as F
    assert few.collect() == df.orderBy(F.xxhash64("__id"), "__id").limit(500).collect()
    assert neighbors._hashed_first(df, 20_000, 20_000).count() == 20_000
