"""Work of the neighbour search."""

import numpy as np
import pandas as pd

from foldwise.operators import neighbors


def test_rows_look_only_where_their_neighbours_can_be(monkeypatch):
    """One far row of a leaf does not make the others look as far as it does; the rows found are those of brute force."""
    rng = np.random.default_rng(3)
    right = rng.random((20_000, 3))
    left = np.vstack([rng.random((200, 3)) * 0.1, [[5.0, 5.0, 5.0]]])
    leaf = (right * 8).astype(int) @ [64, 8, 1]
    seen, best = [], neighbors._best
    monkeypatch.setattr(neighbors, "_best", lambda lid, L, rid, R, *a: seen.append(len(lid) * len(rid)) or best(lid, L, rid, R, *a))
    table = lambda x, at, first: pd.DataFrame({"__id": np.arange(len(x)) + first, "__grp": "", "x": list(x), "leaf": at})
    out = neighbors._block_topk(4, False, "manhattan")(table(left, 0, 0), table(right, leaf, 1_000))
    assert sum(seen) < 0.2 * len(left) * len(right)
    found = {i: rows["right_id"].tolist() for i, rows in out.sort_values(["dist", "right_id"]).groupby("left_id")}
    assert found == {i: (np.lexsort((np.arange(len(right)), np.abs(right - x).sum(axis=1)))[:4] + 1_000).tolist() for i, x in enumerate(left)}


def test_equal_rows_halve_into_groups():
    rows = neighbors._together(np.zeros((100, 2)), np.arange(100))
    assert sorted(np.concatenate(rows)) == list(range(100)) and max(map(len, rows)) <= neighbors.NEAR_ROWS
