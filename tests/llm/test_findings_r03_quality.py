"""The quality stage's memory: one text at a time beside the Arrow array."""

import tracemalloc

import numpy as np
import pyarrow as pa

from foldwise.llm import quality


def test_one_text_of_a_batch_is_held_at_a_time():
    texts = [None, "", *["some words " * 4000 + str(i) for i in range(200)]]
    array = pa.array(texts)
    tracemalloc.start()
    x = quality.measures_of(array)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < array.nbytes / 2
    assert (x[:4] == np.array([quality.measures(t or "") for t in texts[:4]])).all()
