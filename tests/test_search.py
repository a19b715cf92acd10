"""Text rank and vector search against plain Python on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paywarden.operators import classify as C
from paywarden.operators import search as S
from paywarden.session import work_dir

DOCS = [(1, "Hold the payment, hold it!"), (2, "release payment"), (3, ""), (4, "hold, release; HOLD über alles"), (5, None)]


def docs(spark):
    return spark.createDataFrame(DOCS, "d long, t string")


def test_text_rank(spark):
    got = {r.doc: r.score for r in S.bm25(docs(spark).filter("t is not null"), "d", "t", "Hold alles", 10).collect()}
    toks = {1: "hold the payment hold it".split(), 2: "release payment".split(), 3: [], 4: "hold release hold über alles".split()}
    avg = sum(map(len, toks.values())) / len(toks)

    def score(words):
        total = 0.0
        for term in ("hold", "alles"):
            df = sum(term in w for w in toks.values())
            tf = words.count(term)
            idf = math.log(1 + (len(toks) - df + 0.5) / (df + 0.5))
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
        return -total

    assert got == {d: pytest.approx(score(w), abs=1e-6) for d, w in toks.items() if score(w)}


def test_postings_and_statistics(spark):
    got = sorted(map(tuple, S.postings(docs(spark), "d", "t").collect()))
    assert [g for g in got if g[1] == "hold"] == [(1, "hold", 2), (4, "hold", 2)]
    assert len(got) == 4 + 2 + 4
    stats = {r.term: (r.df, r.cf) for r in S.term_statistics(docs(spark), "t").collect()}
    assert stats["hold"] == (2, 4) and stats["payment"] == (2, 2) and stats["über"] == (1, 1)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # a large group of copies
    rows += [(2000, None), (2001, [0.0] * 8)]
    return rows, spark.createDataFrame(rows, "id long, v array<float>").repartition(5)


def exact(rows, q, k):
    q = np.asarray(q, dtype=np.float32).astype(float)
    out = []
    for i, v in rows:
        if v is None:
            continue
        v = np.asarray(v, dtype=np.float32).astype(float)
        n = np.linalg.norm(v)
        out.append((-round(float(v @ q / n / np.linalg.norm(q)) if n else 0.0, 9), i))
    return [i for _, i in sorted(out)[:k]]


def test_vector_top_k(vectors):
    rows, df = vectors
    asked = S.request_vectors(df, "id", "v", [0, 5, 2000])
    assert [q for q, _ in asked] == [0, 5]
    got = S.vector_top_k(df, "id", "v", asked, 7).collect()
    for q, vec in asked:
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == exact(rows, vec, 7)


def test_many_queries_take_several_passes(vectors, monkeypatch):
    rows, df = vectors
    monkeypatch.setattr(S, "QUERIES_PER_PASS", 2)
    asked = S.request_vectors(df, "id", "v", [1, 2, 3, 4, 5])
    got = S.vector_top_k(df, "id", "v", asked, 3).collect()
    assert {q: [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q, _ in asked} == {
        q: exact(rows, v, 3) for q, v in asked}


@pytest.mark.parametrize("k", [5, 350])
def test_approximate_search_returns_k_rows(spark, vectors, k):
    rows, df = vectors
    asked = S.request_vectors(df, "id", "v", [0, 7])
    path = work_dir(spark, "ann")
    model = S.ann_index(df, "id", "v", path)
    got = S.ann_top_k(spark, path, model, "id", asked, k).collect()
    for q, vec in asked:
        hits = [r.id for r in got if r.query_id == q]
        assert len(hits) == len(set(hits)) == k and q in hits
        assert len(set(hits) & set(exact(rows, vec, k))) >= 0.4 * k


def test_embed_only_what_is_missing(spark):
    rows = spark.createDataFrame([(1, [0.5], "kept"), (2, None, "new words here"), (3, None, None)],
                                 "id int, embedding array<float>, text string")
    got = {r.id: r.embedding for r in S.embed_missing(rows, S.hashing_encoder(16)).collect()}
    assert got[1] == [0.5] and got[3] is None
    assert len(got[2]) == 16 and abs(sum(x * x for x in got[2]) - 1) < 1e-5


def test_fusion(spark):
    t = spark.createDataFrame([(1, 1), (2, 2)], "doc long, rank int")
    v = spark.createDataFrame([(2, 1), (3, 2)], "doc long, rank int")
    assert [r.doc for r in S.hybrid(t, v, 3).collect()] == [2, 1, 3]


def test_every_signal_needs_a_label(spark):
    flags = spark.createDataFrame([("deceased_payee",), ("income_mismatch",), ("manual_review_flag",), (None,)], "signal string")
    labels = C.require_all_classified(C.classify_signals(flags))
    assert {r.signal: r.signal_category for r in labels.collect()} == {
        "deceased_payee": "fraud", "income_mismatch": "eligibility", "manual_review_flag": "administrative"}
    with pytest.raises(RuntimeError):
        C.require_all_classified(C.classify_signals(spark.createDataFrame([("unheard_of",)], "signal string")))
    assert C.classify_signals(flags, lambda c: F.lit("x")).filter("signal_category = 'x'").count() == 3
