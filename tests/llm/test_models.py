"""Quality ranking, suffix-tree scores, chat formatting, decontamination, and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldwise.llm import chat, decontam, pst, quality
from tests.conftest import SF


def crc(d):
    return zlib.crc32(str(d).encode()) if d is not None else 0


# -- quality --------------------------------------------------------------------------------

def test_ranking_separates_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.95


def test_bradley_terry_learns_a_known_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] - 2 * x[:, 1] + rng.normal(scale=0.2, size=600) > 0).astype(int)
    m = quality.fit(x, y)
    w = m.w / m.scale
    assert w[0] > 0 > w[1] and abs(w[1] / w[0] + 2) < 0.3 and abs(w[2]) < 0.1 * abs(w[1])
    assert ((m.score(x) >= 0.3) == y).mean() > 0.95
    order = np.argsort(m.strength(x))
    assert (np.diff(m.score(x)[order]) >= 0).all()


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (7, 0), (7, None), (None, 1), (99, 0), (6, 5)], "doc_id long, quality int")
    a, b = (Counter(map(tuple, quality.score_documents(awkward, labels).collect())) for _ in range(2))
    assert a == b and sum(a.values()) == awkward.count()
    none = quality.score_documents(awkward, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {1}
    kept = quality.keep_accepted(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() <= awkward.count()
    assert quality.score_documents(empty, labels).count() == 0 and quality.keep_accepted(empty, labels).count() == 0


def test_quality_ignores_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                                  1 - F.col("quality")).otherwise(F.col("quality")))
    assert Counter(map(tuple, quality.score_documents(docs, labels).collect())) == Counter(
        map(tuple, quality.score_documents(docs, flipped).collect()))


# -- suffix tree ----------------------------------------------------------------------------

def _base(rows):
    words = [t.encode().lower().split() + [None] for _, t in rows]
    c = Counter(w for (d, _), ws in zip(rows, words) if crc(d) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, crc(d) % 7 == 2, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            for (d, _), ws in zip(rows, words)]


def _check_base(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)


def test_base_scores_and_model_beats_them(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pst.score_documents(df).collect()
    _check_base(got, _base([(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def _brute_score(tree, codes, contexts, words, discount, counts, n, v):
    """Longest retained suffix, word by word, with dictionaries."""
    total, history = 0.0, [codes[None]]
    nodes = {(int(p), int(c)): int(t) for p, c, t in zip(tree.steps >> pst.CTX_BITS, tree.steps & pst.young(1), tree.to)}
    named = dict(zip(tree.named.tolist(), tree.log_named.tolist()))
    for w in words:
        code, node = codes.get(w, 0), 0
        for c in history[::-1][:pst.DEPTH]:
            if not 0 < c <= contexts or (node, c) not in nodes:
                break
            node = nodes[(node, c)]
        while node and (node << pst.SYM_BITS | code) not in named:
            total, node = total + tree.log_share[node], int(tree.parent[node])
        if node:
            total += named[node << pst.SYM_BITS | code]
        else:
            total += math.log10((counts[w] - discount if w in counts else discount * v + 1) / (n + 1))
        history.append(code)
    return total


def test_scores_equal_a_word_by_word_walk_and_states_add_up(spark):
    text = ["of the cat", "of the dog", "in the cat of the cat", "new york is big", "new york of the dog"]
    rows = [(i, " ".join(text[(i + k) % 5] for k in range(1 + i % 4)) + f" w{i % 50} once{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = pst.texts_of(df).where(F.col("doc_id") >= 0)
    model, counts, totals = pst.learn(train)
    tree, counts = model.tree, {r["word"] and bytes(r["word"]): r["n"] for r in counts.collect()}
    n, v, discount = totals["tokens"], totals["vocabulary"], totals["discount"]
    assert len(tree.parent) > 1 and max(tree.parent) > 0  # contexts of more than one word are retained
    linear = {c: 10 ** tree.root[c] for c in model.codes.values()}
    known = {w: (c - discount) / (n + 1) for w, c in counts.items()}
    assert sum(known.values()) + (discount * v + 1) / (n + 1) == pytest.approx(1)
    for node in range(1, len(tree.parent)):  # every state is a distribution over known words and the unknown one
        mass = 0.0
        x = np.array([*linear, 0])
        for code in x.tolist():
            lp, at = 0.0, node
            while at and (at << pst.SYM_BITS | code) not in set(tree.named.tolist()):
                lp, at = lp + tree.log_share[at], int(tree.parent[at])
            if at:
                mass += 10 ** (lp + tree.log_named[np.searchsorted(tree.named, at << pst.SYM_BITS | code)])
            else:
                mass += 10 ** lp * (linear[code] if code else 1 - sum(linear.values()))
        assert mass <= 1 + 1e-9
    held = pst.score_documents(df).collect()
    model, counts, totals = pst.learn(pst.texts_of(df).where(F.col("doc_id").isin([d for d, _ in rows if crc(d) % 7 != 2])))
    counts = {r["word"] and bytes(r["word"]): r["n"] for r in counts.collect()}
    texts = dict(rows)
    for r in held:
        words = [*texts[r["doc_id"]].encode().lower().split(), None]
        want = _brute_score(model.tree, model.codes, model.contexts, words, totals["discount"], counts, totals["tokens"],
                            totals["vocabulary"])
        assert r["score"] == pytest.approx(want, rel=1e-9)


def test_suffix_tree_awkward(awkward, empty, plain):
    got = pst.score_documents(awkward).collect()
    _check_base(got, _base(plain))
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert pst.score_documents(empty).count() == 0
    only = awkward.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    assert all(r["train_tokens"] == 0 and r["score"] == 0 and r["n_known"] == 0 for r in pst.score_documents(only).collect())


# -- chat -----------------------------------------------------------------------------------

text_st = st.lists(st.sampled_from([*"\\#</turn>\n: ab=é\U0001f600", "### User: ", "### ", "</turn>\n", "\\\\", "\ue0f1\ue0f2\ue0f3"]),
                   max_size=12).map("".join)
turns_st = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "User", "", "=x", "a:b\\", "tool"]), text_st), max_size=9)


@given(turns_st, st.integers(2, 5))
@settings(max_examples=200, deadline=None)
def test_pieces_read_back(turns, window):
    r = chat.IncrementalRenderer(chat.default_template, window)
    pieces = [r.add(*t) for t in turns]
    assert "".join(p for p, _, _ in pieces) == chat.default_template(turns)
    assert [chat.read_turn(p) for p, _, _ in pieces] == turns
    assert [chat.unescape(p[a:b]) for p, a, b in pieces] == [t for _, t in turns]


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert not chat.rewrites_history(chat.default_template, turns)
    assert chat.rewrites_history(lambda ts: f"{len(ts)} turns:" + chat.default_template(ts), turns)
    assert chat.rewrites_history(lambda ts: "".join(t if i == len(ts) - 1 else t[:0] for i, (_, t) in enumerate(ts)), turns)
    head = lambda ts: "<s>" + "".join(f"[{r}]{t}" for r, t in ts)
    r = chat.IncrementalRenderer(head)
    assert [p[a:b] for p, a, b in (r.add(*t) for t in turns)] == ["a", "b", "c"]


def _want_chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, ts in by.items():
        turns = [t[2:] for t in sorted(ts)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), len(chat.default_template(turns))))
    return Counter(out)


def test_chat_awkward(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, None, "x"), (None, 0, "user", ""),
            (None, 1, "assistant", "### User: </turn>"), (2, 5, "assistant", "long " * 50_000)]
    rows += [(3, i, "user" if i % 2 else "assistant", f"t{i} \\") for i in range(200)]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "conv_id long, turn long, role string, text string, nth string, piece string")
    got = chat.digest_conversations(chat.format_turns(df)).drop("rewrites").collect()
    assert Counter(map(tuple, got)) == _want_chat(rows)
    assert chat.digest_conversations(chat.format_turns(df.limit(0))).count() == 0
    def _counting(turns):
        return f"{len(turns)}:" + chat.default_template(turns)
    counted = chat.format_turns(df, template=_counting).where("nth > 0").collect()
    assert counted and all(r["rewrites"] and r["piece"] is None for r in counted)


def test_chat_query(spark):
    from foldwise.llm.queries import QUERIES
    trap = "\\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op7_chat_format"](spark, SF).collect()
    assert Counter(map(tuple, got)) == _want_chat([*rows, (-7, 0, "user", trap), (-7, 1, "assistant", trap)])


# -- decontamination ------------------------------------------------------------------------

ITEM = "A train leaves the old town at 9 and covers 120 km before Anna meets it there. How far does Anna walk to her house?"


def test_leaks_and_clean_documents(spark):
    filler = "Quite other words stand here and go on for a while without any meaning at all. "
    docs = [(1, filler + ITEM + " " + filler), (2, ITEM.upper().lower()), (3, filler * 3),
            (4, filler + ITEM.replace("9", "7").replace("120", "340").replace("Anna", "Berta")),  # re-parameterised
            (5, ITEM.replace("before Anna", "before Carl")),  # Anna is two persons, but 13 words in a row are the item's
            (11, ITEM.replace("9", "7").replace("120", "340").replace("before Anna", "before Carl")),  # contradicting slots
            (6, "A train leaves the old town and nothing else."), (None, ITEM), (7, None), (8, ""),
            (9, "short item here"), (10, "Is it that the short item here counts?"), (4, ITEM)]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(70, ITEM), (70, ITEM), (71, "Short item here!"), (72, None), (73, " "), (None, filler + "Never seen at all.")],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(df, bench).where("item_id is not null").collect()}
    assert {k for k in got if k[1] == 70} == {(1, 70), (2, 70), (4, 70), (5, 70), (None, 70)}
    assert {k for k in got if k[1] == 71} == {(9, 71), (10, 71)}
    only = decontam.leaks(df.where("text like '%Berta%'"), bench).first()
    assert only["reparameterised"] and only["n_slots"] == 4
    clean = decontam.keep_clean(df, bench.where("item_id is not null"))
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {3, 6, 7, 8, 11}
    assert decontam.leaks(df.limit(0), bench).count() == 0
    assert decontam.leaks(df, bench.limit(0)).count() == 0
    assert decontam.keep_clean(df, bench.limit(0)).count() == len(docs)


def test_unbroadcast_benchmark_gives_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    a = Counter(map(tuple, decontam.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert a == Counter(map(tuple, decontam.leaks(docs, bench).collect()))


def test_planted_passages_are_found_and_nothing_else(spark):
    docs, bench = ([(r[0], " ".join((r[1] or "").split())) for r in spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").select(c, "text").collect()]
                   for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    from foldwise.llm.queries import QUERIES
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontamination"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {(d, i) for d, t in docs for i, x in bench if x in t}


def test_decontamination_needs_no_python(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontam.keep_clean(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- pipeline -------------------------------------------------------------------------------

def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_dedup import _components, _fingerprint
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    accepted = {r["doc_id"] for r in quality.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r["predicted"]}
    last = {rows[d]: d for d in sorted(accepted)}  # the largest id of equal texts
    ids = sorted(last.values())
    parts = _components([_fingerprint(rows[d]) for d in ids], ids)
    ids = [d for d, c in zip(ids, parts) if d == c]
    bench = [" ".join(r[0].split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    ids = [d for d in ids if not any(b in " ".join(rows[d].split()) for b in bench)]
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == ids
    assert {r["doc_id"]: r["decoded_sha256"] for r in out} == {d: hashlib.sha256(rows[d].encode()).hexdigest() for d in ids}
    assert all(len(r["ids"]) == r["n_tokens"] for r in out)


def test_pipeline_stages_keep_columns_on_awkward_rows(spark, awkward, empty):
    import corpus_pipeline
    for docs in (awkward, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == awkward.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_quality_learns_from_every_label(spark, monkeypatch):
    """More labelled rows than the driver fits: none is left out, and the model is that of the small fit, nearly."""
    rng = np.random.default_rng(2)
    rows = [(i, ("Some quiet words in a row. " if i % 2 else "BUY NOW !!! $$$ ") * int(rng.integers(1, 9)) + f"word{rng.integers(99)}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i % 2) ^ int(rng.random() < 0.1)) for i in range(900)], "doc_id long, quality int")
    one = quality.learn(docs, labels)
    sizes, many = [], quality.fit_many
    monkeypatch.setattr(quality, "MAX_LABELS", 100)
    monkeypatch.setattr(quality, "fit_many", lambda found, size, accept: sizes.append((size, found.agg(F.sum("n")).first()[0])) or many(found, size, accept, per_bucket=200))
    all_ = quality.learn(docs, labels)
    trained = sum(crc(i) % 5 != 0 for i in range(900))
    assert sizes == [(trained, trained)]
    assert np.allclose(one.mean, all_.mean) and np.allclose(one.scale, all_.scale)
    x = np.array([quality.measures(t) for _, t in rows])
    assert np.corrcoef(one.strength(x), all_.strength(x))[0, 1] > 0.99
    assert ((one.score(x) >= 0.3) == (all_.score(x) >= 0.3)).mean() > 0.95
