"""The index of near-duplicate vectors beyond one list: what it holds on the disk, and large groups against all pairs."""

import os
import threading

import numpy as np
import pytest

from paywarden.llm import pivots
from paywarden.session import work_dir

SCHEMA = "vec_id bigint, embedding array<float>"


def unit(values):
    return values / np.linalg.norm(values, axis=-1, keepdims=True)


def around(rng, centre, count, cosine):
    """Vectors whose cosine with ``centre`` is about ``cosine``."""
    aside = rng.normal(size=(count, len(centre)))
    aside = unit(aside - (aside @ centre)[:, None] * centre)
    return cosine * centre + np.sqrt(1 - cosine * cosine) * aside


def all_pairs(values, threshold=0.9):
    """The number of links and the smallest place of the component of each vector."""
    close = (u := unit(values.astype(np.float32).astype(np.float64))) @ u.T >= threshold
    np.fill_diagonal(close, False)
    tree, _ = pivots._joined(np.arange(len(values)), *np.nonzero(close))
    return close.sum(axis=1), tree


def near(spark, values, **more):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values.tolist())], SCHEMA)
    rows = sorted(pivots.near_vectors(frame, **more).collect())
    assert [r.vec_id for r in rows] == list(range(len(values)))
    return np.array([r.n_links for r in rows]), np.array([r.component_id for r in rows])


def bytes_in(folders):
    found = 0
    for folder in folders:
        for at, _, names in os.walk(folder):
            for name in names:
                try:
                    found += os.stat(os.path.join(at, name)).st_size
                except OSError:  # removed meanwhile
                    pass
    return found


def test_the_disk_holds_a_few_copies_of_the_vectors(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(pivots, "AT_ONCE", 1, raising=False)
    rows, length = 12_000, 64
    values = np.random.default_rng(8).normal(size=(rows, length)).astype(np.float32)
    path = str(tmp_path / "vectors")
    spark.createDataFrame([(i, v) for i, v in enumerate(values.tolist())], SCHEMA).write.parquet(path)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    folders = [*local, os.path.dirname(work_dir(spark, "x"))]
    before, most, end = bytes_in(folders), [0], threading.Event()

    def watch():
        while not end.wait(0.02):
            most[0] = max(most[0], bytes_in(folders) - before)
    thread = threading.Thread(target=watch)
    thread.start()
    try:
        found = pivots.near_vectors(spark.read.parquet(path))
    finally:
        end.set()
        thread.join()
    assert most[0] < 4 * values.nbytes
    assert found.count() == rows and spark.conf.get(pivots.CLEANUP_KEY) == "false"


@pytest.mark.parametrize("block", [16, 512])
def test_large_groups_with_and_without_a_centre_equal_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(pivots, "LISTED", 32)
    rng = np.random.default_rng(6)
    tight, beside, loose = (unit(rng.normal(size=32)) for _ in range(3))
    beside = around(rng, tight, 1, 0.93)[0]
    values = np.concatenate([
        around(rng, tight, 300, 0.99), around(rng, beside, 250, 0.995),  # two centres whose members are links in part
        around(rng, tight, 60, 0.9), around(rng, tight, 40, 0.8),  # visitors
        around(rng, loose, 150, 0.955), rng.normal(size=(1200, 32))])  # about 0.91 to each other; alone
    values = values[rng.permutation(len(values))] * rng.uniform(0.1, 9, size=(len(values), 1))
    (links, named), (expected, least) = near(spark, values, block=block), all_pairs(values)
    index = pivots.index_of(unit(values), len(values), 0.9)
    assert len(index.tables) > 1 and len(index.centres) > 1
    home, visits = index.visits(unit(values))
    assert np.array_equal(links[home >= 0], expected[home >= 0]) and (home >= 0).sum() > 400 and visits.sum() > 100
    assert (links <= expected).all() and links.sum() >= 0.99 * expected.sum() and (named >= least).all()
    assert (named == least).mean() > 0.99


def test_pairs_at_the_threshold_meet_in_some_table():
    rng = np.random.default_rng(2)
    for length, count in ((64, 50_000), (64, 15_000_000), (8, 1_000_000), (300, 1_000_000)):
        sample = unit(rng.normal(size=(2000, length)))
        index = pivots.index_of(sample, count, 0.9)
        others = unit(rng.normal(size=(4000, length)))
        x, y = index.lists(others), index.lists(pivots._twins(others, 0.9, rng))
        assert pivots._meet(x, y).mean() > 0.985, (length, count)
        # A list is as long however many vectors there are.
        at, rows = np.unique(x[x >= 0], return_counts=True)
        assert (rows * rows).sum() / rows.sum() / len(others) < 0.4 if count > 100_000 else True


def test_a_pair_counts_in_the_first_list_it_shares():
    x, y = np.array([[4, 2, 9, 13, 11, 10]] * 4), np.array([[9, 7, 8, 13, 17, 16], [0, 1, 3, 11, 16, 10], [0, 1, 3, 16, 17, 11], [0, -1, -1, 12, -1, -1]])
    assert [pivots._first_met(x, y, k, 10).tolist() for k in (9, 10, 11, 13)] == [
        [True] * 4, [False, True, True, True], [False, False, True, True], [False, False, False, True]]


def test_a_forest_of_links_grown_in_parts_spans_the_same_components():
    rng = np.random.default_rng(3)
    i, j = rng.integers(0, 400, 500), rng.integers(0, 400, 500)
    tree, kept = np.arange(400), []
    for k in range(0, 500, 90):
        tree, more = pivots._joined(tree, i[k:k + 90], j[k:k + 90])
        kept += (more + k).tolist()
    whole, some = pivots._joined(np.arange(400), i, j)
    again, all_kept = pivots._joined(np.arange(400), i[kept], j[kept])
    assert np.array_equal(tree, whole) and np.array_equal(again, whole)
    assert len(kept) == len(some) == len(all_kept) == 400 - len(np.unique(whole))
