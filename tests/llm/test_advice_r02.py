"""Cases of the second review: each failed before the change it came with."""

from collections import Counter

import numpy as np

from foldwise.llm import chat, decontam, pst, quality


def _leaked(spark, docs, items):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontam.leaks(df, bench).collect()}


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    item = "the old grey mill by the river was sold to a man who had never seen it before"
    words = item.split()
    halves = [" ".join(words[:10]) + " and so on", "so on and " + " ".join(words[6:])]  # pooled, they would reach `need`
    rows = [(None, item), (None, "a clean text"), (None, "another clean text"), (5, item), (5, "clean, too"), (6, halves[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {tuple(r) for r in decontam.keep_clean(df, bench).collect()} == {(None, "a clean text"), (None, "another clean text"),
                                                                           (5, "clean, too"), (6, halves[0])}
    apart = ["x " + " ".join(words[:11]), "x " + " ".join(words[:7]) + " y " + " ".join(words[8:])]
    df = spark.createDataFrame([(7, t) for t in apart], "doc_id long, text string")
    assert decontam.leaks(df, bench, need=6).count() == 0 and decontam.keep_clean(df, bench).count() == 2


def test_numbers_may_change_one_by_one(spark):
    item = "a box holds 3 apples and 5 oranges and a bag holds 3 pears so how many fruits are there in all of them"
    equal = item.replace("3 apples and 5 oranges", "4 apples and 4 oranges")
    one = item.replace("3 pears", "7 pears")
    assert _leaked(spark, [equal, one], [item]) == {(0, 0), (1, 0)}


def test_exact_copies_are_found_whatever_the_template_says(spark):
    items = ["What is the capital city of France?", "12 + 30 = 42"]
    docs = ["Geography quiz\nWhat is the capital city of France?\nParis.", "We know that 12 + 30 = 42, as it should be.",
            "We know that 12 - 30 = 42 is wrong.", "We know that 13 + 29 = 42."]
    assert _leaked(spark, docs, items) == {(0, 0), (1, 1)}


def test_names_that_begin_sentences_may_change(spark):
    item = "Tom has 3 red apples in a basket. Tom gives Anna 2 of them at noon. Tom eats one on the way home."
    copy = item.replace("Tom", "Bob").replace("Anna", "Carla").replace("3", "8")
    docs = ["Some words before. " + copy, copy.replace("Bob eats", "Dan eats").replace("Bob gives", "Eve gives")]
    assert _leaked(spark, docs, [item]) == {(0, 0)}


def test_turns_are_rendered_after_the_whole_conversation(spark):
    def numbered(turns):
        return "".join(f"{i}[{r}]{t}" for i, (r, t) in enumerate(turns))

    def late(turns):
        return ("new" if len(turns) > 60 else "") + "".join(f"[{r}]{t}" for r, t in turns)
    turns = [("user" if i % 2 else "assistant", f"t{i}") for i in range(100)]
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = sorted(chat.format_turns(df, template=numbered).collect(), key=lambda r: r["nth"])
    assert "".join(r["piece"] for r in got) == numbered(turns)
    assert {r["nth"] for r in chat.format_turns(df, template=late).where("rewrites").collect()} == set(range(60, 100))


def test_copies_of_a_labelled_row_reach_the_driver_once(spark, monkeypatch):
    rows = [(i % 40, f"some text {i % 40} of {'words' * (i % 5)}") for i in range(400)] + [(40, "a hot text")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id long, quality int")
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, n=None, accept=0.3: seen.append((x, y, n)) or fit(x, y, n, accept))
    quality.learn(docs, labels)
    quality.learn(docs, labels, max_labels=10)
    copies = Counter(d for d, _ in rows)
    (x, y, n), (few, _, _) = seen
    assert len(x) <= 41 and len(few) <= 10 and n.sum() == sum(copies[d] for d in range(41) if quality_trains(d))


def quality_trains(d):
    import zlib
    return zlib.crc32(str(d).encode()) % 5 != 0


def test_weights_are_copies():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + rng.normal(scale=0.5, size=300) > 0).astype(int)
    n = rng.integers(1, 6, 300)
    a, b = quality.fit(x, y, n), quality.fit(np.repeat(x, n, axis=0), np.repeat(y, n))
    assert np.allclose(a.mean, b.mean) and np.allclose(a.scale, b.scale) and np.allclose(a.w, b.w, atol=0.15)


def test_a_pair_of_words_is_learned_however_large_the_corpus(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50, 400))) for i in range(500)]
    trained = _ids(12, False)
    held = _ids(2, True)
    rows += [(d, f"w{d % 50} quark zeta") for d in trained] + [(held[0], "w1 quark zeta"), (held[1], "w1 zeta quark")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pst.score_documents(df).where(f"doc_id in ({held[0]}, {held[1]})").collect()}
    assert got[held[0]] - got[held[1]] > 2  # 12 of some 170 000 tokens


def _ids(n, held_out):
    import zlib
    return [d for d in range(1000, 1100) if (zlib.crc32(str(d).encode()) % 7 == 2) == held_out][:n]
