"""The disposition model separates the history it was trained on."""

import os

import pytest

from paywarden.operators import learning as L
from paywarden.plans.registry import Context

PATH = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(PATH), reason="no test data")
def test_model(spark):
    c = Context(spark, PATH)
    rows = L.training_rows(c.s.silver_outcomes)
    model = L.train(rows, iterations=4)
    assert L.evaluate(model, rows)["auc"] > 0.8
    candidates = L.candidate_rows(c.s.queue)
    best = L.score(model, candidates).collect()
    assert candidates.count() == 3 * len(best) == 3 * c.s.queue.count()
    assert all(0 <= r.improper_probability <= 1 for r in best)
    assert all(r.predicted_net_value_usd >= 0 for r in best)  # releasing is always an option
