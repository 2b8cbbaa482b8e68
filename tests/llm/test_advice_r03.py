"""op9: the end token counts even where its share of the training tokens is tiny."""

import math

import pytest

from foldwise.llm import pst


def test_one_very_long_training_text(spark):
    words = 300_000
    rows = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(words)))], "doc_id long, text string")  # crc32('0') % 7 is not 2
    r = pst.score_documents(rows).first()
    n = words + 1
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (False, n, n, n)
    assert r["base_score"] == pytest.approx(n * math.log10(2 / (n + n + 1)), abs=1e-3)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_copies_without_an_id_are_dealt_out(spark, keep):
    """op2: a third of all rows is one text with a null id, another text has the smallest long among its ids."""
    from foldwise.llm import exact_dedup
    least = -2 ** 63
    rows = [(None, "hot")] * 2000 + [(i, f"text {i}") for i in range(4000)] + [(least, "low"), (5, "low"), (least, "low")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    out = exact_dedup.group_copies(df, keep=keep).collect()
    assert len(out) == len(rows)
    hot = [r for r in out if r["group_size"] == 2000]
    assert len(hot) == 2000 and sum(r["kept"] for r in hot) == 1 and all(r["keep_id"] is None for r in hot)
    low = [r for r in out if r["group_size"] == 3]
    assert sum(r["kept"] for r in low) == 1 and {r["keep_id"] for r in low} == {5 if keep == "largest" else least}
    salts = exact_dedup._decide(df, "doc_id", "text", None, keep, False).where("__hot").groupBy("__salt").count().collect()
    assert max(r["count"] for r in salts) < 1000
