"""Cleaning rules on literal fixtures (hand-worked answers)."""

from pyspark.sql import types as T

from foldwise.operators.rules import RuleProgram, clean, null_report


def col(df, name):
    return [r[name] for r in df.orderBy("row_id").collect()]


def frame(spark, values, dtype):
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("x", dtype)])
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema)


def test_tokens_mean_replace_cast(spark):
    df = frame(spark, ["200", ">1700", None, "-4", "100"], T.StringType())
    rules = {"x": {"nullVals": ["-1", "-4", "None"], "nullHandling": "mean_imputation",
                   "replaceVals": [[">1700", "1700"]], "fieldType": "float"}}
    assert col(clean(df, rules), "x") == [200.0, 1700.0, 150.0, 150.0, 100.0]


def test_null_key(spark):
    df = frame(spark, ["Male", "Female", "None", None], T.StringType())
    rules = {"x": {"nullVals": ["None"], "nullHandling": "none",
                   "replaceVals": [["null", "2"], ["Male", "0"], ["Female", "1"]], "fieldType": "integer"}}
    assert col(clean(df, rules), "x") == [0, 1, 2, 2]


def test_ordered_regex(spark):
    df = frame(spark, ["Not Hisp/Latino", "Hisp/Latino", "Unknown", None], T.StringType())
    rules = {"x": {"replaceVals": [["null", "0"], ["Unknown", "0"], ["Not Hisp/Latino", "1"], ["Hisp/Latino", "2"]],
                   "fieldType": "integer"}}
    assert col(clean(df, rules), "x") == [1, 2, 0, 0]


def test_truncating_cast(spark):
    df = frame(spark, [0, 1, None], T.IntegerType())
    rules = {"x": {"nullHandling": "mean_imputation", "fieldType": "integer"}}
    assert col(clean(df, rules), "x") == [0, 1, 0]


def test_ratio_and_case_insensitive_rename(spark):
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("vol", T.DoubleType()),
                           T.StructField("ICV_bl", T.DoubleType())])
    df = spark.createDataFrame([(0, 10.0, 4.0), (1, 20.0, 0.0)], schema)
    out = clean(df, {"icv_bl": {"fieldType": "float"}, "vol": {"normalizeOtherFt": "ICV_bl"}})
    assert "icv_bl" in out.columns and "ICV_bl" not in out.columns
    assert col(out, "vol") == [2.5, None]


def test_residual_null(spark):
    df = frame(spark, ["80", "<80", None], T.StringType())
    out = clean(df, {"x": {"nullHandling": "mean_imputation", "fieldType": "float"}})
    assert col(out, "x") == [80.0, None, 80.0]
    rep = {r["feature"]: r["n_null"] for r in null_report(out).collect()}
    assert rep["x"] == 1


def test_remove_keeps_literal_null_string(spark):
    df = frame(spark, ["a", None, "null"], T.StringType())
    out = clean(df, {"x": {"nullHandling": "remove"}})
    assert col(out, "x") == ["a", "null"]


def test_drop_and_missing_columns_are_noops(spark):
    df = frame(spark, ["1", "2"], T.StringType())
    out = clean(df, {"x": {"drop": "true"}, "absent": {"fieldType": "float", "drop": "true"},
                     "ghost": {"nullHandling": "mean_imputation"}})
    assert out.columns == ["row_id"]


def test_one_aggregate_per_stage(spark):
    schema = T.StructType([T.StructField("row_id", T.LongType())] +
                          [T.StructField(f"c{i}", T.StringType()) for i in range(5)])
    df = spark.createDataFrame([(0, "1", "2", None, "4", "x"), (1, None, "3", "5", None, "y")], schema)
    rules = {f"c{i}": {"nullHandling": "mean_imputation", "fieldType": "float"} for i in range(4)}
    p = RuleProgram(df, rules)
    p.result()
    assert p.aggregate_jobs == 1
    rules2 = dict(rules)
    rules2["c4"] = {"nullHandling": "remove"}
    rules2["c9"] = {}
    p2 = RuleProgram(df, {**{k: v for k, v in rules.items() if k in ("c0", "c1")}, "c4": {"nullHandling": "remove"},
                          "c2": {"nullHandling": "mean_imputation"}})
    p2.result()
    assert p2.aggregate_jobs == 2


def test_int_minus4_matches_token_double_does_not(spark):
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("i", T.IntegerType()),
                           T.StructField("d", T.DoubleType())])
    df = spark.createDataFrame([(0, -4, -4.0), (1, 3, 3.0)], schema)
    out = clean(df, {"i": {"nullVals": ["-4"]}, "d": {"nullVals": ["-4"]}})
    assert col(out, "i") == [None, 3]
    assert col(out, "d") == [-4.0, 3.0]
