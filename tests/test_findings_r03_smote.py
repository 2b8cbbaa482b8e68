"""SMOTE looks for neighbours of the base rows that synthetic rows start from, and of no others (F5)."""

from foldwise.operators import neighbors, sampling


def test_only_used_bases_look_for_neighbours(spark, monkeypatch):
    rows = [(i, float(i % 7), float(i * i % 11), 0) for i in range(40)] + [(100 + i, float(i % 5), float(i * i % 13), 1) for i in range(37)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, DX int")
    asked, search = [], neighbors.knn_join

    def spied(left, right, *args, **kw):
        asked.append((left.count(), right.count()))
        return search(left, right, *args, **kw)
    monkeypatch.setattr(neighbors, "knn_join", spied)
    out = sampling.smote(df, ["a", "b"], seed=3).collect()
    assert asked == [(3, 37)]
    assert len(out) == 80 and sum(r["synthetic"] for r in out) == 3
    at = {r["row_id"]: (r["a"], r["b"]) for r in df.where("DX = 1").collect()}
    for r in out:  # every synthetic row lies between a base row and one of its five nearest
        if r["synthetic"]:
            assert any(abs((r["a"] - p[0]) * (q[1] - p[1]) - (r["b"] - p[1]) * (q[0] - p[0])) < 1e-9 for p in at.values() for q in at.values())


def test_boxes_of_leaves_from_many_batches(spark, monkeypatch):
    """The search by leaves (also with several Arrow batches a task) agrees with the plain one."""
    rows = [(i, float(i * 37 % 101), float(i * 53 % 97), i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, DX int")
    want = sorted(map(tuple, neighbors.knn_join(df, df, ["a", "b"], 3, by=["DX"], exclude_self=True).collect()))
    monkeypatch.setattr(neighbors, "TASK_PAIRS", 10)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, neighbors.knn_join(df, df, ["a", "b"], 3, by=["DX"], exclude_self=True).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want
