"""Tests of the round's findings on memory, disk and time of the training-data operators."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from foldwise.llm import pretok, pst, simple8b, suffix_dedup


@pytest.mark.parametrize("step", suffix_dedup.CUTS)
def test_cut_runs_leave_a_task_in_small_batches(step):
    rng = np.random.default_rng(3)
    n, size = 400, suffix_dedup.LENGTH + 23
    data = [rng.bytes(size) for _ in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array([5] * n), pa.array(range(n)), pa.array([1] * n), pa.array([30] * n, pa.int32()),
                                        pa.array(data, pa.binary())], names=["h", "d", "n", "back", "data"])
    out = list(suffix_dedup._cut_rows(step)(iter([batch] * 30)))
    assert max(b.nbytes for b in out) < 2 * suffix_dedup.CUT_BYTES
    covered = defaultdict(int)
    for b in out:
        for row in b.to_pylist():
            windows = len(row["data"]) - suffix_dedup.LENGTH + 1
            assert windows <= step
            assert data[row["of_d"]][row["skip"]:row["skip"] + len(row["data"])] == row["data"]
            covered[row["of_d"]] += windows
    assert covered == {i: 30 * 24 for i in range(n)}  # every window once for each batch


def test_ends_of_large_batches_are_cut_in_small_ones(spark, monkeypatch):
    rows = [(i, ("é" if i % 3 else "x") * 300 + f"{i:05d}") for i in range(60)] + [(70, None), (71, "y" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = {r["doc_id"]: tuple(r) for r in suffix_dedup.digest_repeats(df).collect()}
    monkeypatch.setattr(suffix_dedup, "TEXT_BYTES", 1000)
    assert {r["doc_id"]: tuple(r) for r in suffix_dedup.digest_repeats(df).collect()} == whole
    assert len(whole) == len(rows)


def test_slices_that_come_again_stay_in_a_full_table():
    asked = []

    def encode(slices):
        asked.extend(slices)
        return np.array([len(s) for s in slices for _ in s], np.uint32), np.array([len(s) for s in slices])
    table = pretok.SliceTable(encode, limit=50)
    often = [" the", " of", " and"]
    for k in range(40):
        text = "".join(often) + "".join(f" w{chr(97 + i)}{chr(97 + k % 26)}{'x' * (k // 26)}" for i in range(20))
        ids, offs = table.encode([text, ""])
        slices, _ = pretok.split([text])
        assert ids.tolist() == [len(s) for s in slices for _ in s]
        assert offs.tolist() == [0, len(ids), len(ids)]
        assert len(table.rows) < 50 + 23
    assert all(asked.count(s) == 1 for s in often)


def test_letters_and_numbers_lie_below_the_last_planes():
    import sys
    import unicodedata
    assert not any(unicodedata.category(chr(c))[0] in "LN" for c in range(pretok.PLANES, sys.maxunicode + 1))
    assert len(pretok.class_table()) == sys.maxunicode + 1


@pytest.mark.parametrize("width", [1, 2, 7, 16, 30, 60])
def test_words_hold_ids_of_every_width(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 5000, dtype=np.uint64)
    ids[::977] = (1 << 60) - 1
    assert (simple8b.unpack(simple8b.pack(ids), len(ids)) == ids).all()


def test_seldom_terms_are_looked_up_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.integers(0, 40, rng.integers(0, 9)).tolist()) for i in [*range(50), 1 << 40, (1 << 40) + 1]]
    values = {k: k / 7 for k in range(0, 40, 3)}
    names, write = [], pst.written

    def noted(df, name):
        names.append((name, df.count()))
        return write(df, name)
    monkeypatch.setattr(pst, "written", noted)
    found = pst.cold_sums(spark.createDataFrame(rows, "row long, cold array<long>"),
                          spark.createDataFrame(list(values.items()), "key long, value double"))
    got = {r["row"]: r["cold_score"] for r in found.collect()}
    want = {i: sum(values[k] for k in keys if k in values) for i, keys in rows if any(k in values for k in keys)}
    assert got.keys() == want.keys() and got == pytest.approx(want)
    assert len(names) == pst.COLD_ROUNDS and max(n for _, n in names) < len(want) / 2
