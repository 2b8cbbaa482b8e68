import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, clashing names."""
    rows = [(1, "A text of some words, with 12 numbers."), (2, None), (3, ""), (4, LONG), (5, "same"), (6, "same"), (6, "same"),
            (None, "same"), (None, None), (7, "Other text entirely, it’s ünïcode \U0001f600 <|endoftext|>"), (-8, " \n\t ")]
    df = spark.createDataFrame([(i, t, None if n % 2 else "en", None, None) for n, (i, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["keep_id", "fp", "row", "spans", "hash", "words", "score", "kept", "component_id", "__text", "__id", "__row", "x",
             "tag", "conv_id", "turn", "nth", "flat", "item_id", "__stay", "__leaked"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def plain(awkward):
    """The awkward rows as Python values: (doc_id, text with null as empty)."""
    return [(r["doc_id"], r["text"] or "") for r in awkward.select("doc_id", "text").collect()]
