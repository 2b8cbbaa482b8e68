"""Registered queries against their SQL statements (DuckDB) on the smallest tables,
plus contract and plan checks."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import ROOT, SF

SQL = E.oracle_sql()
SLOW = {"repeat_experiments"}  # twenty runs of what cross_validate checks; tools/check_oracle.py compares it


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_a_name_and_sql_keys_are_queries():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60


@pytest.mark.parametrize("name", sorted(n for n in SQL if not re.match(r"op\d", n) and n not in SLOW))
def test_query_matches_sql(spark, con, name):
    import sys
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    from check_oracle import compare
    msg = compare(spark, con, SF, name, E.queries()[name], E.oracle_sql()[name])
    assert ": ok" in msg, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert [c for c in df.columns] == ["rank", "feature", "score"]
    assert len(df.collect()) == 3


def engine_files():
    for dirpath, _, files in os.walk(os.path.join(ROOT, "foldwise")):
        if "llm" not in dirpath.split(os.sep):
            yield from (os.path.join(dirpath, f) for f in files if f.endswith(".py"))


def test_no_local_checkpoints_pandas_collects_or_rdds_in_engine():
    bad = [f for f in engine_files() if re.search(r"toPandas\(|localCheckpoint\(|\.rdd\.", open(f).read())]
    assert not bad, bad


# Every collect() of the engine, and why what it brings is bounded.
COLLECTS = {
    "datasets.py": 1,     # catalog entries: one per feature
    "neighbors.py": 3,    # pivots, cell radii, k distances a cell: MAX_PIVOTS x k
    "network.py": 2,      # a row a network; the averaged weights of each
    "boosting.py": 2,     # cuts by model and feature; a split by model, node and class
    "forest.py": 2,       # class labels; a row a large node
    "kernel_svm.py": 4,   # a row a model; its landmarks; a row a machine; counts in bins
    "mixtures.py": 4,     # one row; candidates of a round, twice; the components
    "relief.py": 2,       # one row of ranges; one row per class
    "sampling.py": 1,     # at most three class names, for an error
    "scaling.py": 1,      # a row per group and feature
    "selectors.py": 5,    # a row per feature, or per pair of features
    "rules.py": None,     # one row of means a stage
    "experiment.py": None,
}


def test_collects_are_the_known_ones():
    for f in engine_files():
        n = len(re.findall(r"\.collect\(\)", open(f).read()))
        name = os.path.basename(f)
        allowed = COLLECTS.get(name, 0)
        assert allowed is None or n <= allowed, (name, n)


@pytest.mark.parametrize("name", ["stratified_folds", "ordered_holdout", "smote", "clean_all", "left_join_enrich", "knn_join"])
def test_no_window_puts_all_rows_in_one_partition(spark, name):
    """A window without partition keys may only stand above an aggregate (one row per class or key)."""
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    for i, line in enumerate(plan):
        m = re.search(r"\bWindow \[.*?\](?:, \[(.*?)\])?", line)
        if m and "windowspecdefinition(specifiedwindowframe" in line.replace(" ", ""):
            below = "\n".join(plan[i + 1:])
            assert "Aggregate" in below, line


def test_cluster_without_shared_folder_is_refused():
    from foldwise.session import checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "local-cluster[2,1,512]"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_scratch_tables_are_released(spark):
    from foldwise.session import release_scratch
    from foldwise.sources.sink import write_and_read
    path = write_and_read(spark.range(3), "probe").inputFiles()[0].replace("file://", "").replace("file:", "")
    assert os.path.exists(path)
    assert release_scratch(spark) > 0 and not os.path.exists(path)


def test_engine_does_not_need_the_training_data_package():
    for f in engine_files():
        assert not re.search(r"foldwise\.llm|from \.+llm|corpus_pipeline", open(f).read()), f
