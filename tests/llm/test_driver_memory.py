"""What training holds in the driver: few copies of its bounded sample, and the same model for any order of rows."""

import tracemalloc

import numpy as np

from paywarden.llm import toxicity


def test_the_driver_holds_few_copies_of_the_sample():
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 60_000, 4_000, dtype=np.int32)) for _ in range(1_500)]
    marks = draw.integers(0, 2, len(rows)).astype(float)
    found, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    tracemalloc.start()
    model = toxicity.fit(*toxicity._in_order(found, sizes, marks), passes=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * found.nbytes + 30e6
    turned = draw.permutation(len(rows))
    again = toxicity.fit(*toxicity._in_order(np.concatenate([rows[k] for k in turned]), sizes[turned], marks[turned]), passes=1)
    assert again.bias == model.bias and np.array_equal(again.features, model.features) and np.array_equal(again.values, model.values)
