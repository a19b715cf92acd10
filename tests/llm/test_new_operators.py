"""Substring dedup, conversation repair and tokenizer alignment against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from paywarden.llm import alignment, conversations, super_kmers
from paywarden.llm.queries import op12_conversation_repair

DOCS = "doc_id bigint, text string, kept string, minimiser string, packed string, spans string"


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in pairs], DOCS)


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice(["an", "er", "th", "on", "re", "st"]) for _ in range(pick.randint(1, 3))) for _ in range(n))


# -- substring dedup ------------------------------------------------------------------------------

def left_by_brute_force(pairs, k):
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in pairs]
    least = {}
    for i, w in rows:
        for a in range(len(w) - k + 1 if i is not None else 0):
            window = tuple(w[a:a + k])
            least[window] = min(i, least.get(window, i))
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for a in range(len(w) - k + 1 if i is not None else 0):
            if least[tuple(w[a:a + k])] < i:
                gone[a:a + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def passages():
    shared, other = prose(1, 70), prose(2, 51)
    pairs = [(i, f"{prose(100 + i, 30)} {shared} {prose(300 + i, 20)}") for i in range(40)]
    pairs += [(50, shared), (51, f"{other}\n\t{other}"), (52, other.replace(" ", "\v ", 3)), (53, " ".join(other.split()[:49])), (54, other + " x"), (54, other + " y")]
    pairs += [(60, "same " * 400), (61, "same " * 90), (62, "a b " * 100), (63, "b a " * 60), (-5, shared), (70, None), (71, ""), (72, " \n "), (None, shared),
              (None, shared), (73, "é" * 30 + " " + shared), (74, "x" * 2_500_000 + " " + shared), (75, "x" * 2_500_000 + " " + other)]
    return pairs


@pytest.mark.parametrize("settings", [{}, {"least": 3}, {"chunk": 2000}, {"least": 3, "chunk": 2000}])
def test_substring_dedup_equals_brute_force(spark, settings):
    pairs = passages()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in super_kmers.without_repeats(docs(spark, pairs), **settings).collect()), key=repr)
    assert got == left_by_brute_force(pairs, 50)


def test_substring_dedup_with_other_window_lengths_and_no_rows(spark):
    pairs = [(i, prose(i % 7, 40)) for i in range(20)]
    for k in (1, 3, 6):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in super_kmers.without_repeats(docs(spark, pairs), k=k).collect()), key=repr)
        assert got == left_by_brute_force(pairs, k)
    assert super_kmers.without_repeats(docs(spark, [])).count() == 0


def test_colliding_window_hashes_are_told_apart(monkeypatch):
    texts = [prose(i % 3, 60) for i in range(6)]
    data, row, at, starts, ends = b"".join(t.encode() for t in texts), [], [], [], []
    offset = 0
    for r, t in enumerate(texts):
        begin, stop = super_kmers.word_limits(np.frombuffer(t.encode(), np.uint8))
        at += [len(starts) + i for i in range(11)]
        row += [r] * 11
        starts += (begin + offset).tolist()
        ends += (stop + offset).tolist()
        offset += len(t.encode())
    same = np.zeros(len(at), np.uint64)
    monkeypatch.setattr(super_kmers, "_window_hashes", lambda hashes, at, k: (same, same))
    found = super_kmers._covered(data, np.array(starts), np.array(ends), None, np.array(at), np.array(row), np.arange(6), 50)
    assert found.tolist() == [False] * 33 + [True] * 33


# -- conversation repair --------------------------------------------------------------------------

STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cost, audit and turns, with the whole lists kept for each state."""
    states = {"": (0, "", ())}

    def put(into, state, cost, audit, turns):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, turns)

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for state, (cost, audit, turns) in list(out.items()):
                to, role = ("a", "assistant") if state == "u" else ("u", "user")
                put(out, to, cost + 3, audit + "I", turns + (f"{role}:",))
        return out
    for (role, text), fault in zip(rows, faults(rows)):
        new = {}
        for state, (cost, audit, turns) in inserted(states).items():
            put(new, state, cost + 4, audit + "D", turns)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                to, other = ("a", "assistant") if state == "u" else ("u", "user")
                put(new, to, cost + 3 + extra, audit + "R", turns + (f"{other}:{text}",))
                if (state, role[:1]) in STEPS:
                    put(new, STEPS[state, role[:1]], cost + extra, audit + "K", turns + (f"{role}:{text}",))
        states = new
    done = inserted(states)
    return min(done[s] for s in ("", "a") if s in done)


def every_repair(rows):
    """The same by trying every list of edits with up to two inserts at a place."""
    best = None
    fault = faults(rows)
    places = ["", "I", "II"]
    for before in itertools.product(places, repeat=len(rows) + 1):
        for edits in itertools.product("KRD", repeat=len(rows)):
            audit = "".join(b + e for b, e in zip(before, edits + ("",)))
            state, cost, k = "", 0, 0
            for e in audit:
                if e == "I":
                    state, cost = ("a" if state == "u" else "u"), cost + 3
                    continue
                role, f = rows[k][0], fault[k]
                k += 1
                if e == "D":
                    cost += 4
                    continue
                if f in ("blank", "duplicate") or (e == "K" and (state, role[:1]) not in STEPS):
                    state = None
                    break
                cost += (3 if f else 0) + (3 if e == "R" else 0)
                state = STEPS[state, role[:1]] if e == "K" else "a" if state == "u" else "u"
            if state in ("", "a") and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def random_rows(pick, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", " ", ""]
    texts = ["Yes.", "No!", "and then", "", " \t", "Why? ", "More.", "x."] + [f"t{i}." for i in range(n)]
    return [(pick.choice(roles), pick.choice(texts)) for _ in range(n)]


def test_plain_repair_equals_trying_every_edit():
    pick = random.Random(5)
    for _ in range(60):
        rows = random_rows(pick, pick.randint(0, 3))
        assert plain_repair(rows)[:2] == every_repair(rows)


def streamed(rows):
    repair, seen, decided = conversations.Repair(), set(), []
    for role, text in rows:
        decided += repair.take(None, role, text, (role, text) in seen)
        seen.add((role, text))
    cost, last = repair.finish()
    decided += last
    return cost, "".join(e for e, _, _ in decided), tuple(f"{r}:{t}" for e, r, t in decided if e != "D")


@pytest.mark.parametrize("gather", [8, 64, 8192])
def test_persistent_audits_equal_whole_lists(monkeypatch, gather):
    monkeypatch.setattr(conversations, "GATHER", gather)
    pick = random.Random(gather)
    for n in [0, 1, 2, 3, 5, 8, 13, 40, 200] * 12:
        rows = random_rows(pick, n)
        assert streamed(rows) == plain_repair(rows)


def test_colliding_audit_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(conversations, "_BASE", 0)  # the hash is the last edit alone
    pick = random.Random(9)
    for n in [3, 9, 30, 90] * 10:
        rows = random_rows(pick, n)
        assert streamed(rows) == plain_repair(rows)


def test_a_long_conversation_keeps_its_undecided_part_only():
    repair, most = conversations.Repair(), 0
    for i in range(60_000):
        repair.take(i, "user" if i % 2 == 0 else "assistant", f"turn {i}.", False)
        most = max(most, len(repair.rows))
    assert repair.finish()[0] == 0 and most <= 2 * conversations.GATHER


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, audit string, place string, kind string"


def damaged_plainly(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def test_conversation_query_equals_brute_force(spark, tmp_path):
    pick = random.Random(3)
    rows = [(c, t, *r) for c in range(300) for t, r in enumerate(random_rows(pick, pick.randint(1, 9)))]
    rows += [(900, t, None if t % 3 == 0 else "user", None if t % 4 == 0 else f"x{t}.") for t in range(12)]
    rows += [(None, 1, "user", "Hi."), (None, None, "system", "Be brief."), (901, None, "user", "A."), (901, None, "user", "A."), (901, 7, "assistant", "B."), (901, 7, "assistant", "B.")]
    rows += [(902, 10 * t, "user" if t % 2 else "assistant", f"long {t} " + "y" * 1000 + ".") for t in range(3000)]
    spark.createDataFrame([(*r, "x", "x", "x") for r in rows], CONVERSATIONS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert len(got) == len({r[0] for r in rows})
    after = {}
    for r in sorted(damaged_plainly(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        after.setdefault(r[0], []).append(r)
    for conv in {r[0] for r in rows}:
        mine = after.get(conv, [])
        turns = {r[1] for r in mine if r[1] is not None}
        said = [r[2:] for r in mine]
        initials = [r[0][:1] for r in said]
        cost, audit, left = plain_repair(said)
        n = faults(said)
        want = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n.count("blank"), n.count("duplicate"), n.count("truncated"),
                sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), cost, audit,
                hashlib.sha256("\n".join(left).encode()).hexdigest())
        assert tuple(got[conv])[1:] == want, conv
    turns = conversations.repaired(conversations.damaged(spark.read.parquet(str(tmp_path / "conversations.parquet"))))
    text = [f"{r.role}:{r.text}" for r in turns.filter("conv_id = 902").orderBy("place").collect()]
    assert hashlib.sha256("\n".join(text).encode()).hexdigest() == got[902].repaired_sha256
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert conversations.summaries(empty).count() == 0 and conversations.repaired(empty).count() == 0


# -- tokenizer alignment --------------------------------------------------------------------------

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(open(A, "rb").read(), open(B, "rb").read())


def aligned_plainly(pair, text):
    """Ids, groups as text, and linked id pairs with their numbers, place by place."""
    a = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
    b = pair.b.encode(text) if text else []
    spelled = [b"".join(t[i] for i in ids) for t, ids in ((pair.bytes_a, a), (pair.bytes_b, b))]
    if not text or spelled != [(" " + text).encode()] * 2:
        return [], [], "", {}
    spans = []
    for table, ids in ((pair.bytes_a, a), (pair.bytes_b, b)):
        at, mine = 0, []
        for i in ids:
            mine.append((at, at + len(table[i]), i))
            at += len(table[i])
        spans.append(mine)
    cuts, low, groups = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]}), 0, []
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for _, e, i in side if low < e <= cut) for side in spans))
        low = cut
    links = {}
    for s, e, i in spans[0]:
        for t, f, j in spans[1]:
            if max(s, t) < min(e, f):
                links[i, j] = links.get((i, j), 0) + 1
    return a, b, ";".join(groups), links


TEXTS = [None, "", " ", "the the", "naïve 漢字 🙂 don't <|endoftext|> <s> <0x41>", "a" * 700, "ab " * 300, "▁ marked", "tab\tand\r\nnew  lines ", "\x00\x01", "ﬁne Ａ",
         "é ​ 　x", "\U00031350\U00016FF0 ౝ", " " * 900, "x", "1234567890 ½", "the the", prose(4, 300), prose(5, 300), "Hello, world! Hello, world."]


def test_alignment_equals_brute_force(spark, pair):
    data = spark.createDataFrame([(i if i != 4 else None, t, "x", "x") for i, t in enumerate(TEXTS + TEXTS[:6])], "doc_id bigint, text string, pairs string, n_a string")
    found = alignment.aligned(data, A, B)
    want = [aligned_plainly(pair, t) for t in TEXTS + TEXTS[:6]]
    total, top = {}, {}
    for _, _, _, links in want:
        for p, n in links.items():
            total[p] = total.get(p, 0) + n
    for (_, j), n in total.items():
        top[j] = max(n, top.get(j, 0))
    rows = [(i if i != 4 else None, len(a), len(b), g.count(";") + 1 if g else 0, sum(links.values()), g,
             sum(n for p, n in links.items() if total[p] == top[p[1]]), sum(n * total[p] for p, n in links.items()))
            for i, (a, b, g, links) in enumerate(want)]
    got = alignment.with_counts(found)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, rows))
    none = alignment.with_counts(alignment.aligned(data.limit(0), A, B))
    assert none.count() == 0 and none.columns == got.columns


def test_rare_pairs_come_by_the_shuffle(spark, monkeypatch):
    data = spark.createDataFrame([(i, prose(i % 9, 200)) for i in range(30)], "doc_id bigint, text string")
    found = alignment.aligned(data, A, B)
    usual = sorted(map(repr, alignment.with_counts(found).drop("groups").collect()))
    monkeypatch.setattr(alignment, "FREQUENT", 50)
    assert sorted(map(repr, alignment.with_counts(found).drop("groups").collect())) == usual


def test_groups_of_made_up_ends():
    pick = random.Random(8)
    for _ in range(400):
        n = pick.randint(1, 60)
        a = sorted({*pick.sample(range(1, n + 1), pick.randint(0, n)), n})
        b = sorted({*pick.sample(range(1, n + 1), pick.randint(0, n)), n})
        a = b if pick.random() < 0.2 else a
        cuts = sorted(set(a) & set(b))
        assert alignment.group_ends(a, b) == ([sum(x <= c for x in a) for c in cuts], [sum(x <= c for x in b) for c in cuts])


def test_a_long_one_to_one_stretch_is_one_entry_until_groups_are_numbered():
    a = list(range(1, 10_001))
    b = [*range(1, 5_001), 5_003, *range(5_004, 10_001)]
    assert alignment.stretches(a, b) == ([5_000, 5_003, 10_000], [5_000, 5_001, 9_998], [5_000, 1, 4_997])
    assert alignment.group_ends(a, b) == ([*range(1, 5_001), *range(5_003, 10_001)], [*range(1, 9_999)])
    assert alignment.group_ends([], []) == ([], [])


def test_the_fast_library_gives_the_ids_of_the_file(pair):
    assert pair.fast is not None
    texts = [" " + t for t in TEXTS if t] + [" " + prose(s, 200) for s in range(20)]
    assert pair._ids_a(texts) == [pair.a.encode(t, add_special_tokens=False).ids for t in texts]
