"""Exact search in units against numpy, and what the quantised index finds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paywarden.operators import vector_index as V
from paywarden.session import work_dir

SIZE = 16


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(25, SIZE))
    rows = [(i, (middle[i % 25] + 0.4 * rng.normal(size=SIZE)).tolist()) for i in range(n)]
    return rows + [(10_000 + i, rows[3][1]) for i in range(400)] + [(20_000, None), (20_001, [0.0] * SIZE)]


@pytest.fixture(scope="module")
def data(spark):
    rows = clustered(1500)
    return rows, spark.createDataFrame(rows, "id bigint, v array<float>").repartition(6).cache()


def by_numpy(rows, asked, k):
    rows = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if v is not None]
    unit = {i: v / np.linalg.norm(v) if v.any() else v for i, v in rows}
    ids, matrix = np.array(list(unit)), np.array(list(unit.values()))
    out = {}
    for q in asked:
        s = np.round(matrix @ unit[q], 9)
        out[q] = ids[np.lexsort((ids, -s))[:k]].tolist()
    return out


def hits(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.key)
    return out


@pytest.mark.parametrize("rows_a_unit,queries_a_unit", [(20_000, 2_000), (300, 7)])
def test_exact_search_is_exact_however_it_is_cut(data, monkeypatch, rows_a_unit, queries_a_unit):
    monkeypatch.setattr(V, "ROWS", rows_a_unit)
    monkeypatch.setattr(V, "QUERIES", queries_a_unit)
    rows, frame = data
    asked = [i for i, v in rows if i % 50 == 0 and v is not None]
    got = hits(V.exact_top_k(frame, "id", "v", frame.filter("id % 50 = 0"), 7))
    assert got == by_numpy(rows, asked, 7)


@pytest.mark.parametrize("rows_a_unit", [20_000, 120])
def test_the_index_finds_nine_tenths_and_prunes_lists(spark, data, monkeypatch, rows_a_unit):
    monkeypatch.setattr(V, "ROWS", rows_a_unit)
    monkeypatch.setattr(V, "RERANK", 5)
    rows, frame = data
    path = work_dir(spark, "vector-index")
    book = V.write_index(frame, "id", "v", path, codes=32)
    asked = frame.filter("id % 50 = 0")
    exact, near = V.exact_top_k(frame, "id", "v", asked, 10), V.near_top_k(spark, path, book, "id", "v", asked, 10)
    assert V.recall(exact, near).first().recall >= 0.9
    assert book.probes < len(book.centres) / 2
    assert spark.read.parquet(path).count() == sum(v is not None for _, v in rows)
    found = near.collect()
    assert len({(r.query_id, r.key) for r in found}) == len(found)
    one = V.near_top_k(spark, path, book, "id", "v", frame.filter("id = 50"), 3, probes=2)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert one.first().key == 50


def test_codes_stand_for_what_is_left_after_the_centre(data):
    rows, frame = data
    book = V.learn(frame, "id", "v", 30, codes=32)
    unit = V._unit(np.array([v for _, v in rows[:200]]))
    near, codes = book.encode(unit)
    built = book.centres[near] + np.concatenate([book.codes[p][codes[:, p]] for p in range(codes.shape[1])], axis=1)
    assert np.linalg.norm(unit - built, axis=1).mean() < 0.6 * np.linalg.norm(unit - book.centres[near], axis=1).mean()


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id bigint, v array<float>")
    path = work_dir(spark, "vector-index")
    book = V.write_index(few, "id", "v", path)
    assert hits(V.near_top_k(spark, path, book, "id", "v", few, 5, probes=9)) == {1: [1, 2], 2: [2, 1]} == hits(V.exact_top_k(few, "id", "v", few, 5))
    with pytest.raises(ValueError):
        V.learn(few.filter(F.col("id") == 3), "id", "v", 2)
