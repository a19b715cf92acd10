"""The stored index against scoring every document, what a search reads, and stems against published pairs."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from paywarden.functions.stems import stem, stem_sql
from paywarden.operators import text_index as I
from paywarden.session import work_dir

PAIRS = """caresses caress, ponies poni, ties ti, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing,
conflated conflat, troubled troubl, sized size, hopping hop, tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file,
happy happi, sky sky, relational relat, conditional condit, rational ration, valenci valenc, digitizer digit, conformabli conform, radicalli radic,
differentli differ, vileli vile, analogousli analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis,
hopefulness hope, callousness callous, formaliti formal, sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative form, formalize formal,
electriciti electr, electrical electr, hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop,
adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt, communism commun,
activate activ, homologous homolog, effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll,
generalizations gener, oscillators oscil, by by, yellow yellow, naïve naïve, über über, 漢字 漢字, 123s 123s"""


def test_stems(spark):
    pairs = [tuple(p.split()) for p in PAIRS.replace("\n", " ").split(",")]
    words = spark.createDataFrame(pairs, "term string, want string")
    assert [tuple(r) for r in words.withColumn("got", stem(F.col("term"))).filter("got <> want").collect()] == []
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS term", [[a for a, _ in pairs]])
    assert dict(con.execute(f"WITH {stem_sql('words')} SELECT term, stem FROM stems").fetchall()) == dict(pairs)


def corpus(n, seed=1):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        words = [pick.choice(["pays", "paying", "hold", "holds", "release", "claim", "claims", "x"]) for _ in range(pick.randint(1, 12))]
        rows.append((i * 37 - 500, " ".join(words)))
    return [*rows, (10**12, "payed payed payed"), (7, None), (8, ""), (9, "--"), (None, "pays hold")]


def by_hand(rows, stems, k):
    """Rank over all documents, with frequencies of stems."""
    plain = {"pays": "pai", "paying": "pai", "payed": "pai", "hold": "hold", "holds": "hold", "claim": "claim", "claims": "claim", "release": "releas", "x": "x"}
    texts = {d: [plain[w] for w in t.split()] for d, t in rows if t and t != "--" and d is not None}
    n, length = len(rows), sum(map(len, texts.values()))
    idf = {}
    for s in stems:
        df = sum(s in w for w in texts.values())
        idf[s] = math.log(1 + (n - df + 0.5) / (df + 0.5))
    out = []
    for d, w in texts.items():
        total = sum(idf[s] * w.count(s) * 2.2 / (w.count(s) + 1.2 * (0.25 + 0.75 * len(w) / (length / n))) for s in stems)
        if total:
            out.append((round(-total, 6), d))
    return [(d, s) for s, d in sorted(out)[:k]]


@pytest.mark.parametrize("asked,stems,k", [("Paying holds", ["pai", "hold"], 10), ("claim pay claims pays", ["claim", "pai"], 3), ("released", ["releas"], 1000)])
def test_search_equals_scoring_everything(spark, monkeypatch, asked, stems, k):
    monkeypatch.setattr(I, "STRETCH", 6)  # many small blocks
    rows, path = corpus(400), work_dir(spark, "text-index")
    I.write_index(spark.createDataFrame(rows, "d bigint, t string").repartition(5), "d", "t", path)
    search = I.Search(spark, path, asked, k, first=2)
    got = [(r.doc, r.score) for r in search.top().collect()]
    want = by_hand(rows, stems, k)
    assert [d for d, _ in got] == [d for d, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)


def test_blocks_that_cannot_matter_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(I, "STRETCH", 4)
    rows = [(i, "filler words here and hold") for i in range(1600)] + [(5000 + i, "hold hold hold") for i in range(12)]
    path = work_dir(spark, "text-index")
    I.write_index(spark.createDataFrame(rows, "d bigint, t string"), "d", "t", path)
    search = I.Search(spark, path, "holding", 10, first=2)
    assert [r.doc for r in search.top().collect()] == list(range(5000, 5010))
    assert search.left.count() == 0 and search.bounds.count() > 100
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(search.mine._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[[^\n]*folder", plan) and re.search(r"PushedFilters: \[[^\n]*\(term", plan)


def test_tasks_follow_the_words_and_postings_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(I, "STRETCH", 4)
    monkeypatch.setattr(I, "WORDS_PER_TASK", 500)
    monkeypatch.setattr(I, "BROADCAST_STEMS", 2)  # most terms are stemmed by the rules
    rows, path = corpus(400), work_dir(spark, "text-index")
    I.write_index(spark.createDataFrame(rows, "d bigint, t string"), "d", "t", path)
    blocks = I.index_blocks(spark, path).withColumn("file", F.input_file_name())
    assert blocks.groupBy("folder").agg(F.countDistinct("file").alias("n")).agg(F.max("n")).first()[0] > 2
    assert blocks.groupBy("term", "stretch").count().filter("count > 1").isEmpty()
    assert [(r.doc, r.score) for r in I.Search(spark, path, "Paying holds", 10).top().collect()] == by_hand(rows, ["pai", "hold"], 10)


def test_rows_of_one_id_are_one_document(spark, monkeypatch):
    path = work_dir(spark, "text-index")
    I.write_index(spark.createDataFrame([(1, "hold x"), (1, "holds x"), (2, "hold"), (None, "hold")], "d bigint, t string").repartition(3), "d", "t", path)
    held = I.index_blocks(spark, path).filter("term = 'hold'").first()
    assert (held.docs, held.tfs, held.lengths, held.n, held.occurrences) == ([1, 2], [2, 1], [2, 1], 2, 3)


def test_nothing_indexed_and_nothing_asked(spark):
    path = work_dir(spark, "text-index")
    I.write_index(spark.createDataFrame([], "d bigint, t string"), "d", "t", path)
    assert I.Search(spark, path, "hold", 5).top().count() == 0 and I.Search(spark, path, " ?! ", 5).top().count() == 0
