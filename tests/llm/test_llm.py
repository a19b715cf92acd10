"""Each operator against a brute-force version on small fixtures, with nulls, empty tables, repeated rows and clashing names."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from paywarden.llm import bpe, decontaminate, html_text, licenses, minhash, pivots, quality, secret_scan, toxicity, url_rules
from paywarden.llm.components import components

PATH = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, kept string, row string"
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], DOCS)


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice(["an", "er", "th", "on", "re", "st"]) for _ in range(pick.randint(1, 4))) for _ in range(n))


def test_components_on_a_chain_a_star_and_odd_links(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (5, None), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bpe_equals_the_library_and_round_trips(spark):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    texts = [None, "", "  \n ", "the the", "naïve 漢字 🙂 don't", "a" * 5000, "ab" * 3000, prose(1, 400), prose(1, 400)]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for r in bpe.encoded(docs(spark, texts), path, public_tokenizers.PATTERN).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    first = bpe.digests(docs(spark, texts), path, public_tokenizers.PATTERN).filter("doc_id = 1").first()
    assert first.n_tokens == 0 and first.ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(docs(spark, []), path, public_tokenizers.PATTERN).count() == 0


def words4(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_minhash_equals_all_pairs(spark):
    base = prose(3, 120).split()
    texts = [None, "", " \t ", "one two", "ONE two", "one"]
    for k in range(30):
        w = list(base)
        w[(k * 7) % 110] = f"changed{k}"
        texts.append(" ".join(w + [f"tail{k % 3}"] * (k % 5)))
    texts += [texts[6]] * 3 + [prose(s, 60) for s in range(10)] + ["x" * 3_000_000 + " a b c d e"]
    sets = [words4(t, 4) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), n=4).collect()}
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), up[i], up[i] == i), i
    again = docs(spark, texts[:8]).union(docs(spark, texts[:8]))
    left = minhash.without_copies(again, n=4)
    assert left.columns == ["doc_id", "text", "kept", "row"] and left.filter("doc_id = 6").count() == 1
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_one_row_of_every_group_is_left_by_row(spark):
    def near(words, *places):
        return " ".join(f"{w}x" if k in places else w for k, w in enumerate(words))
    base, other, more = prose(70, 200).split(), prose(71, 200).split(), prose(72, 60)
    # A chain whose middle text has no id: its ends are linked through it only.
    chain = [near(base, *range(0, 24, 4)), near(base), near(base, *range(150, 170, 4))]
    texts = [(3, "t one of the texts"), (5, "t one of the texts"), (5, "t two is not like it"),  # a copy and a text of its own, one id
             (9, chain[0]), (None, chain[1]), (8, chain[2]), (None, chain[1]),
             (20, near(other)), (20, near(other, 100)), (None, near(other)),  # one id with two sets of one group
             (30, more), (30, more), (30, "quite another text here"), (30, more.upper()),
             (None, prose(73, 50)), (None, prose(73, 50)), (None, prose(74, 50)), (None, None), (None, ""), (3, None), (3, None)]
    sets = [words4(t, 4) for _, t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    assert up[3] == up[4] == up[5] and 100 * len(sets[3] & sets[5]) < 80 * len(sets[3] | sets[5])
    rows = spark.createDataFrame([(i, t, "clash", str(k)) for k, (i, t) in enumerate(texts)], DOCS)
    left = [int(r["row"]) for r in minhash.without_copies(rows, n=4).collect()]
    groups = [u for u, s in zip(up, sets) if s]
    assert sorted(up[k] for k in left if sets[k]) == sorted(set(groups))  # one of each group
    assert [k for k in sorted(left) if not sets[k]] == [k for k, s in enumerate(sets) if not s]  # and all without words
    for k in left:
        ids = [texts[i][0] for i in range(len(texts)) if up[i] == up[k] and texts[i][0] is not None]
        assert not sets[k] or texts[k][0] == min(ids, default=None)
    got = minhash.near_duplicates(rows, n=4)
    assert {r.component_id for r in got.filter("doc_id in (8, 9)").collect()} == {8}


def test_a_passage_takes_only_its_own_row(spark):
    item = prose(11, 60)
    texts = [(None, item), (None, prose(12, 80)), (4, prose(13, 20) + " " + item), (4, prose(14, 90)), (4, None), (None, None)]
    rows = spark.createDataFrame([(i, t, "clash", str(k)) for k, (i, t) in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert sorted(r["row"] for r in decontaminate.without_benchmark(rows, bench).collect()) == ["1", "3", "4", "5"]


def test_estimates_follow_the_similarity(spark):
    pick = np.random.default_rng(1).integers(1, 1 << 62, 8000, dtype=np.uint64)
    base, true, rows = pick[:3000], [], []
    for cut in (0, 100, 335, 700, 1500, 3000):  # similarities 1, 0.94, 0.8, 0.62, 0.33 and 0
        other = pick[cut:cut + 3000]
        true.append((3000 - cut) / (3000 + cut))
        rows.append((cut, minhash.low_bits(minhash.minima(base)).tolist(), minhash.low_bits(minhash.minima(other)).tolist()))
    frame = spark.createDataFrame(rows, "cut int, a array<bigint>, b array<bigint>")
    got = frame.select(minhash.estimate(frame.a, frame.b).alias("fine"), minhash.coarse_estimate(frame.a, frame.b).alias("coarse")).collect()
    for s, r in zip(true, got):
        assert abs(r.fine - s) < 0.09 and abs(r.coarse - s) < 0.2, (s, r)
    assert 0.73 < minhash.lowest_estimate(80, minhash.MINIMA) < 0.74


def test_a_family_near_the_threshold_equals_all_pairs(spark):
    pick, base, texts = random.Random(5), prose(8, 100).split(), []
    for k in range(160):
        w = list(base)
        for at in pick.sample(range(4, 96), pick.choice([1, 2, 2, 3, 4])):
            w[at] = f"word{k}x{at}"
        texts.append(" ".join(w))
    sets = [words4(t, 4) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    assert len(set(up)) > 20
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, texts), n=4).collect()} == dict(enumerate(up))


def test_forests_of_unsure_pairs_join_texts_and_forests_of_links_join_components():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(1, 1 << 62, 300).astype(np.uint64))
    # a0 and b0 may be a link by the sketch and are none; a1 and b1 are one. Both pairs are of the components A and B.
    fresh = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    sets = [np.unique(x) for x in (np.r_[base[:260], fresh(33)], np.r_[base[:260], fresh(33)], np.r_[base[:285], fresh(8)], np.r_[base[:285], fresh(9)])]
    lowest = [minhash.minima(x) for x in sets]
    rows = [{"group": 0, "low": 0, "high": 0, "part": 0, "root": r, "set_key": bytes([k]), "n_shingles": len(x),
             "bands": [0] * minhash.BANDS, "low_bits": minhash.low_bits(m).tolist(), "members": x.view(np.int64).tolist()}
            for k, (r, x, m) in enumerate(zip([b"A", b"B", b"A", b"B"], sets, lowest))]
    batch = pa.RecordBatch.from_pylist(rows)
    met = {frozenset((r["a"], r["b"])) for b in minhash._sketched(70)(iter([batch.slice(0, 1), batch.slice(1)])) for r in b.to_pylist()}
    assert frozenset().union(*met) == {bytes([k]) for k in range(4)}
    links = [r for b in minhash._exact(85)(iter([batch])) for r in b.to_pylist()]
    assert [(r["a"], r["b"]) for r in links] == [(bytes([2]), bytes([3]))]


def test_parts_of_a_hot_bucket_meet_each_other(spark):
    rows = spark.createDataFrame([(7, bytes([k]), 10) for k in range(40)] + [(8, bytes([k]), 10) for k in range(2)], "band long, set_key binary, n_shingles long")
    cut = minhash.in_units(rows, "band", 5, 1000).collect()
    met = {}
    for r in cut:
        met.setdefault((r.group, r.low, r.high), []).append((r.part, bytes(r.set_key)))
    pairs = {frozenset((x, y)) for unit in met.values() for p, x in unit for q, y in unit
             if x < y and (p != q or len({part for part, _ in unit}) == 1)}
    assert len(pairs) == 40 * 39 // 2 and len({u for u in met if u[0] == 7}) > 20 and (8, 0, 0) in met


def test_vectors_equal_all_pairs_and_recall_is_whole(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.08 * (i % 3)).tolist()) for i in range(200)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, rows[0][1]), (904, rows[0][1]), (None, rows[1][1])]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id bigint, embedding array<double>, node string")
    got = pivots.near_vectors(frame, pivots=32, block=16).collect()
    assert len(got) == len(rows)
    x = np.array([v for _, v in rows[:200]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    expected = {i: int(close[i].sum()) - 1 + 2 * int(close[i, 0]) + int(close[i, 1]) for i in range(200)}
    by_id = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id < 200}
    assert sum(by_id[i].n_links for i in range(200)) >= 0.9 * sum(expected.values())
    assert all(by_id[i].n_links <= expected[i] for i in range(200))
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id in (900, 901, 902, 903))
    assert pivots.near_vectors(frame.limit(0)).count() == 0


def test_vectors_of_every_length_are_linked(spark):
    rng = np.random.default_rng(5)
    rows = [(100 * d + i, v) for d, n in ((16, 30), (12, 29), (3, 2), (1, 3)) for c in [rng.normal(size=d)]
            for i, v in enumerate((c + rng.normal(size=(n, d)) * 0.02).tolist())] + [(7000, [1.0] * 5), (None, [2.0] * 5), (7001, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in pivots.near_vectors(frame, pivots=8, block=8).collect()}
    for i, v in rows:
        close = [j for j, w in rows if len(w) == len(v) and np.dot(v, w) >= 0.9 * np.linalg.norm(v) * np.linalg.norm(w)]
        named = min(j for j in close if j is not None)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(close) - 1, named, i == named), i


def test_url_rules(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    urls = {None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Example.ORG/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"),
            "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"), "http://x.com/de/1#f": ("x.com", "/de/1", "com/de/", "block"),
            "http://x.org": ("x.org", "", None, "allow"), "ftp://org/": ("org", "/", "org/", "allow"), "http://x.com/" + "a" * 100_000: ("x.com", "/" + "a" * 100_000, None, "allow")}
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(2, list(urls)[2], "clash")], "page_id bigint, url string, rule string")
    got = url_rules.judged(pages, rules).collect()
    assert len(got) == len(urls) + 1
    assert all(tuple(r)[1:] == list(urls.values())[r.page_id] for r in got)
    none = url_rules.judged(pages, rules.limit(0), "block")
    assert {r.verdict for r in none.collect()} == {"block"} and url_rules.judged(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<p>", ""), ("just  text &amp; more", "just text & more"),
    ("<nav><a href=x>Menu</a></nav><article><h1>T</h1><p>One,\n two<br>three.</p><p><b>Four <i>five</article><footer>no</footer>", "T\n\nOne, two three.\n\nFour five"),
    ("<nav><ul><li>open<article><p>Kept here</p></article>", "Kept here"),
    ("<div class='ad'>buy</div><div><script>var a='</p>';</script><p>Long enough, with commas, to be the main part of it.</p></div><div id=comments><p>first!</p></div>",
     "Long enough, with commas, to be the main part of it."),
    ("<article><p>Body</p><form>no</form><aside>no</aside><section class='comment'>no</section></article>", "Body")])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


LONG = "A text that is long enough, with commas, and with more than one clause, to be the main part of the page."


@pytest.mark.parametrize("html, text", [
    *[(f"<div {names}><article><p>{LONG}</p></article></div>", LONG)
      for names in ("class='page no-sidebar'", "class='layout with-sidebar'", "class='has-banner'", "id=sidebar", "class='widget'")],
    (f"<section id='search-results'><p>{LONG}</p></section><div class='ad'>buy</div>", LONG),
    (f"<div class='widget'><p>{LONG}</p></div><div class='site-footer'>no</div>", LONG),  # holds most of the text
    (f"<article><h2 id='related-work'>Related</h2><p class='notice'>{LONG}</p><h2 class='share'>Share</h2></article>", f"Related\n\n{LONG}\n\nShare"),
    (f"<div data-id='ad'><p>{LONG}</p></div>", LONG), ("<div class='widget'>a</div><div class='widget'>b</div><div class='widget'>c</div>", "a\n\nb\n\nc"),
    (f"<article><p>{LONG}</p><div class='related-posts'>no</div></article><div id='comment-list'><p>{'no ' * 20}</p></div>", LONG),
    (f"<div id='comments'><p>{LONG} {LONG}</p></div><article><p>{LONG}</p></article>", LONG)])
def test_names_alone_lose_no_article(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("html, text", [
    (f"<article><p>{LONG}</p><p class='newsletter'>Sign up now</p><p class='ad'>Buy now</p></article>", LONG),
    (f"<main><article><p>{LONG} {LONG} {LONG}</p></article><article><p>A short one.</p></article></main>", f"{LONG} {LONG} {LONG}\n\nA short one."),
    (f"<body><h1>Head</h1><div>{LONG}</div><div>short</div></body>", f"Head\n\n{LONG}\n\nshort"),
    ("<p>a &#" + "1" * 5000 + "; b &#" + "0" * 5000 + "65;</p>", "a \ufffd b A"),
    ("<p class=\"x>one</p><p>two</p>", "one\n\ntwo"), ("a < b <c", "a < b <c"), ("<p>x<!-- <p>no", "x")])
def test_adverts_siblings_and_broken_markup(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("part", ["<b ", "a <b x ", "<div>x", "<article><p>x", "<p><td><div>x", "<b '>' ", "<b \"> ", "</script ", "<script>", "<ul><li>x",
                                  "<p class='ad'>x", "<!-- ", "<", "<![CDATA[", "<a href='x'>y", "&#1", "<table><tr><td>x", "<main><div class=widget>x"])
def test_long_pages_take_linear_time(part):
    import time
    page = part * (250_000 // len(part))
    started = time.process_time()
    html_text.main_text(page)
    short = time.process_time() - started
    started = time.process_time()
    html_text.main_text(page * 4)
    assert time.process_time() - started < max(10 * short, 1) and short < 4


def test_repeated_ids_stay_within_the_bound_of_training(spark):
    many = spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    picked = toxicity.labelled(many, labels, "toxic", 10)
    assert picked.count() == 10 and picked.collect() == toxicity.labelled(many.repartition(7), labels, "toxic", 10).collect()


def test_what_bpe_broadcasts_needs_no_package(spark):
    import pickletools

    from pyspark import cloudpickle
    shared = bpe._codec(docs(spark, ["a"]), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert type(shared.ranks.value) is dict and {type(k) for k in shared.ranks.value} == {bytes}
    shared.ranks = None
    named = [arg for op, arg, _ in pickletools.genops(cloudpickle.dumps(shared)) if isinstance(arg, str)]
    assert isinstance(shared, bpe._Shared) and "_make_skeleton_class" in named


def test_reference_points_do_not_depend_on_how_they_are_drawn(spark):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(rng.normal(size=4).tolist(),) for _ in range(2000)], "embedding array<double>")
    few = pivots._drawn(vectors, 2000, 40).to_pylist()
    assert len(few) == 40 and few == pivots._drawn(vectors, 100, 40).to_pylist()


def test_licenses_equal_every_template_at_every_place(spark):
    pick, texts = random.Random(11), [None, "", "mit", "x " * 3000 + "released under the mit license " * 40]
    loose = sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()})
    for _ in range(120):
        parts = []
        for _ in range(pick.randint(1, 6)):
            words = pick.choice(licenses.TEMPLATES)[1].split()
            if pick.random() < 0.4:
                words[pick.randrange(len(words))] = "other"
            parts += pick.choices(loose, k=pick.randint(0, 5)) + words[pick.choice([0, 0, 2]):]
        texts.append(" ".join(parts).title())
    texts += [texts[-1]] * 2
    frame = docs(spark, texts)
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for t in texts]
    seen = [{w for w in words} for words in split]
    idf = {w: np.log((len(texts) + 1) / (sum(w in s for s in seen) + 1)) + 1 for w in loose}
    got = {r.doc_id: r for r in licenses.scanned(frame).collect()}
    for i, words in enumerate(split):
        labels, best = set(), 0.0
        for label, text, part in licenses.TEMPLATES:
            t, m = text.split(), part.split()
            first = next(k for k in range(len(t)) if t[k:k + len(m)] == m)
            for at in range(-first, len(words)):
                if words[max(at + first, 0):at + first + len(m)] == m:
                    labels.add(label)
                    here = [w for k, w in enumerate(t) if 0 <= at + k < len(words) and words[at + k] == w]
                    best = max(best, sum(idf[w] for w in here) / sum(idf[w] for w in t))
        assert set(got[i].method_labels) == labels and got[i].score == pytest.approx(best, abs=1e-6), texts[i]


def test_what_base_spans_leave_of_a_run_is_scored():
    known = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(60)]
    automata = [secret_scan.Automaton(known)]
    text = "see token=abc+" + "AKIA" + "B" * 16 + "/x and more"
    assert [s for s in secret_scan.spans_of(text, automata) if s[2] != "grammar"] == [s[:3] for s in sorted(secret_scan.base_spans(text))]
    assert list(secret_scan._uncovered([(0, 30), (40, 60)], [(5, 10, "hex"), (8, 12, "access"), (25, 45, "assign")])) == [(0, 5), (12, 25), (45, 60)]


def test_html_frame(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<p>a</p>" * 3, "x"), (1, "u", "<p>a</p>" * 3, "x")], "page_id bigint, url string, html string, text string")
    got = [tuple(r) for r in html_text.extracted(pages).collect()]
    assert sorted(got, key=str) == sorted([(None, None, "", 0), (1, "u", "a\n\na\n\na", 7), (1, "u", "a\n\na\n\na", 7)], key=str)


def test_license_places_and_labels(spark):
    texts = [None, "", "MIT License mit license", "Licensed under the Apache License, Version 2.0.", "gnu general public", "x CC BY-NC 4.0, the GNU General Public License version 3", "mit license"]
    got = {r.doc_id: r for r in licenses.scanned(docs(spark, texts)).collect()}
    assert (got[0].n_words, got[0].base_places, got[0].score) == (0, [], 0.0)
    assert (got[2].base_places, got[2].base_labels, got[2].method_labels) == ([0, 2], ["mit"], ["mit"])
    assert got[3].method_labels == ["apache-2.0"] and got[3].score == 1.0 and got[4].base_places == []
    assert got[5].base_labels == ["cc-by", "gpl"] and sorted(got[5].method_labels) == ["cc-by-nc-4.0", "gpl-3.0"]
    assert licenses.scanned(docs(spark, [])).count() == 0


def test_decontamination_finds_items_and_near_items(spark):
    item, short = prose(11, 60), "one rare phrase"
    near = item.split()
    near[30] = "other"
    texts = [None, "", prose(12, 80) + " " + item.upper() + ", " + prose(13, 50), prose(14, 30) + " " + " ".join(near), prose(15, 200), "One rare, phrase!", " ".join(item.split()[:20])]
    bench = spark.createDataFrame([(1, item, "x"), (2, short, "x"), (3, None, "x"), (4, "", "x")], "item_id bigint, text string, row string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs(spark, texts), bench).collect()}
    assert set(got) == {(2, 1), (3, 1), (5, 2)}
    assert (got[2, 1].start, got[2, 1].similarity) == (80, 1.0) and 0.8 <= got[3, 1].similarity < 1
    assert {r.doc_id for r in decontaminate.without_benchmark(docs(spark, texts), bench).collect()} == {0, 1, 4, 6}
    assert decontaminate.matches(docs(spark, texts), bench.limit(0)).count() == 0


def test_short_items_are_found_inside_longer_texts(spark):
    items = {1: "alpha", 2: "beta gamma", 3: "delta, Epsilon zeta", 4: "eta theta iota kappa", 5: "one two three four five", 6: "beta gamma", 7: "ab c"}
    texts = [None, "", "alpha", "x alpha", f"{prose(60, 40)} BETA gamma {prose(61, 30)} alpha", "delta epsilon zeta eta theta iota kappa",
             f"eta theta iota lambda {prose(62, 9)}", "alphabet gamma beta a bc", f"{prose(63, 9)} one two three four five beta gamma", "beta-gamma beta gamma"]
    words = [re.findall(r"[a-z0-9]+", (t or "").lower()) for t in texts]
    wanted = {}
    for d, w in enumerate(words):
        for i, item in items.items():
            x = re.findall(r"[a-z0-9]+", item.lower())
            at = [k for k in range(len(w) - len(x) + 1) if w[k:k + len(x)] == x]
            if at:
                wanted[d, i] = (at[0], len(x), 1.0)
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = decontaminate.matches(docs(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in got} == wanted and len(got) == len(wanted) > 10


def test_secrets(spark):
    text = 'é Password: "abc" token==hunter22x AKIA' + "B2" * 9 + " " + "0af1" * 7 + " end"
    values = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(300)]
    hexes = secret_scan.Automaton(values)
    assert sum(hexes.accepts(hashlib.sha1(f"new{i}".encode()).hexdigest()) for i in range(200)) > 120
    assert not any(hexes.accepts(w) for w in ["internationalisation2", "hello-world-this-is-1"])
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scanned(docs(spark, [None, "", text, text * 30_000]), []).collect()}
    assert got[0] == got[1] == [] and [k for k, _, _ in got[2]] == ["assign", "access", "hex"] and len(got[3]) == 90_000
    assert [text[a:b] for _, a, b in got[2]][0] == "token==hunter22x"
    clean = secret_scan.without_secrets(docs(spark, [None, text]), []).collect()
    assert clean[0].text is None and clean[1].text == 'é Password: "abc" [secret] [secret] [secret] end'
    assert secret_scan.learn(secret_scan.known(docs(spark, []))) == []


def test_classifiers_learn_and_survive_empty_tables(spark):
    data, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    for scores, column, cut in ((toxicity.score(data, toxicity.train(data, labels)), "toxic", 0.5), (quality.scored(data, labels), "quality", 0.3)):
        held = scores.filter("held_out").join(labels, "doc_id").selectExpr(f"score >= {cut} as p", f"{column} = 1 as y").collect()
        assert sum(r.p == r.y for r in held) >= 0.85 * len(held) > 0
    few = docs(spark, [None, "", "a b"])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.scored(few, none).collect()} == {0.5}
    assert all(r.score < 1e-9 for r in toxicity.score(few, toxicity.train(few, none)).collect())
    assert toxicity.without_toxic(few, none).count() == 3
