"""Passages that several documents hold, found window by window with super-k-mers.

Words are runs of anything but ASCII white space. The minimiser of a window of ``k`` words is the smallest hash of its runs of five
words. Consecutive windows of a text that share a minimiser travel as one string, their words joined by single spaces, to the
bucket of that minimiser: equal windows have equal minimisers, so they meet there. In the bucket the windows are sorted by two 64-bit hashes, then
document; a window whose words also start in a document with a smaller id is covered. Stretches that count as equal are compared
byte by byte; should hashes ever collide, the bucket's windows are counted by their texts instead.

Hot minimisers: those of a thousandth of all strings or more (at most 1,000 can exist; each unit of the input names those of a
thousandth of its own strings, which misses none of two thousandths) are dealt by document too, and a bucket larger than ``chunk`` bytes
is judged in parts. In a part only the windows of its smallest document stay open. Their 128-bit digests meet in a second, small round, so no bucket is
held whole and no task gets all of one.

Cases: null and empty texts have no words and lose none; a text of fewer than ``k`` words has no window. Ids are compared as numbers:
a null id is not smaller than any other and no other is smaller than it, so such rows lose nothing and take nothing. Rows that
repeat an id are rows of their own that leave each other alone. Empty in, empty out; extra columns are not looked at. Very
long texts are hashed in pieces and leave in batches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.llm import words as W
from paywarden.llm.shared import stored, travels

travels(__name__)

U = np.uint64
M = 5
SHARE = 1000
#: A text is hashed in pieces of so many bytes.
PIECE = 1 << 20
#: Strings leave in batches of about so many bytes, and shares are counted over units of so many strings.
BATCH, UNIT = 2 << 20, 4_000_000

RUNS = "minimiser bigint, salt int, doc_id bigint, text_key bigint, start bigint, packed binary"
SPANS = "doc_id bigint, text_key bigint, `from` bigint, upto bigint, print binary"
KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base squared and so on, modulo 2**64; kept while no longer than a piece or a chunk of words."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, PIECE + 1), base & (2**64 - 1), U)
        known[0] = 1
        np.cumprod(known, dtype=U, out=known)
        if len(known) <= 4 * PIECE:
            _powers[base] = known
    return known[:n]


def joined(raw: np.ndarray) -> np.ndarray:
    """The text's words joined by single spaces, as bytes."""
    if not len(raw):
        return raw
    keep = ~W.WHITE[raw]
    keep[1:] |= keep[:-1].copy()
    out = raw[keep]
    out[W.WHITE[out]] = 32
    return out[:-1] if len(out) and out[-1] == 32 else out


def word_limits(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of joined words."""
    if not len(text):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(text == 32)
    return np.append(0, gaps + 1), np.append(gaps, len(text))


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from pieces of the text; a word longer than a piece is digested."""
    out = np.empty(len(starts), U)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = int(np.searchsorted(ends, base + PIECE, "right"))
        if last == first:
            out[first] = int.from_bytes(hashlib.blake2b(text[base:ends[first]].tobytes(), digest_size=8).digest(), "little")
            first += 1
            continue
        part = text[base:ends[last - 1]]
        total = np.zeros(len(part) + 1, U)
        np.cumsum(W.BYTE[part] * _power(W.BASE, len(part)), out=total[1:], dtype=U)
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = W.mix((total[e] - total[s]) * _power(W.BASE_INVERSE, len(part) + 1)[s] + (e - s).astype(U))
        first = last
    return out


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    size, best = 1, values
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    return np.minimum(best[:len(values) - width + 1], best[width - size:]) if size < width else best


def minimisers(hashes: np.ndarray, k: int) -> np.ndarray:
    """The minimiser of each window of ``k`` words, as signed numbers."""
    m = min(M, k)
    return lowest(W.shingles(hashes, m), k - m + 1).view(np.int64)


def _cut(raw: np.ndarray, k: int):
    """A text as joined words, with for each super-k-mer its minimiser, first word, first byte and end; None without a window."""
    text = joined(raw)
    starts, ends = word_limits(text)
    if len(starts) < k:
        return None
    found = minimisers(word_hashes(text, starts, ends), k)
    change = np.flatnonzero(found[1:] != found[:-1]) + 1
    first, stop = np.append(0, change), np.append(change, len(found))
    return text, found[first], first, starts[first], ends[stop + k - 2]


def _shares(k: int):
    """Counts of the minimisers that make up a share of a unit, and the unit's strings under a null key."""
    def count(batches):
        held, rows = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            high = n * SHARE >= rows
            return pa.RecordBatch.from_arrays(
                [pa.array([None, *keys[high].tolist()], pa.int64()), pa.array([rows, *n[high].tolist()], pa.int64())], names=["minimiser", "n"])
        for batch in batches:
            data, limits = W.buffers(batch.column(0))
            for i in range(batch.num_rows):
                cut = _cut(data[limits[i]:limits[i + 1]], k)
                if cut is not None:
                    held.append(cut[1])
                    rows += len(cut[1])
            if rows >= UNIT:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()
    return count


def _hot(docs: DataFrame, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent minimisers, sorted, and over how many tasks each is dealt; at most ``SHARE`` of them."""
    counted = docs.select("text").mapInArrow(_shares(k), "minimiser bigint, n bigint").groupBy("minimiser").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), F.col("minimiser").asc_nulls_first()).limit(SHARE + 1).collect()
    part = max(least, sum(r.n for r in top if r.minimiser is None) / SHARE)
    hot = sorted((r.minimiser, -int(-r.n // part)) for r in top if r.minimiser is not None and r.n > part)
    return np.array([h[0] for h in hot], np.int64), np.array([h[1] for h in hot], np.int64)


def _runs(k: int, hot: np.ndarray, parts: np.ndarray):
    """Super-k-mers of each text; those of hot minimisers get a number that deals them by document."""
    def emit(rows):
        columns = list(zip(*rows))
        arrays = [pa.array(np.concatenate(c)) for c in columns[:5]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([x for c in columns[5] for x in c], pa.binary())],
                                          names=["minimiser", "salt", "doc_id", "text_key", "start", "packed"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            data, limits = W.buffers(batch.column(2))
            for i in range(batch.num_rows):
                cut = _cut(data[limits[i]:limits[i + 1]], k)
                if cut is None:
                    continue
                text, found, first, lo, hi = cut
                salt = np.zeros(len(found), np.int32)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
                    spread = int(W.mix(np.array([keys[i] ^ ids[i]], np.int64).view(U))[0] >> U(1))
                    salt = np.where(hot[at] == found, spread % parts[at], 0).astype(np.int32)
                for a in range(0, len(found), 4096):
                    part = slice(a, a + 4096)
                    strings = [text[x:y].tobytes() for x, y in zip(lo[part].tolist(), hi[part].tolist())]
                    n = len(strings)
                    rows.append((found[part], salt[part], np.full(n, ids[i], np.int64), np.full(n, keys[i], np.int64), first[part].astype(np.int64), strings))
                    size += int((hi[part] - lo[part]).sum())
                    if size >= BATCH:
                        yield emit(rows)
                        rows, size = [], 0
        if rows:
            yield emit(rows)
    return run


def _window_hashes(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``k`` words from each place on."""
    out, up, down = [], _power(W.BASE, len(hashes)), _power(W.BASE_INVERSE, len(hashes) + 1)
    for seed in (0, 0x5851F42D4C957F2D):
        total = np.zeros(len(hashes) + 1, U)
        np.cumsum(W.mix(hashes ^ U(seed)) * up, out=total[1:], dtype=U)
        out.append((total[at + k] - total[at]) * down[at])
    return out[0], out[1]


def _stretches(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each stretch, from the flag of its first place."""
    begin = np.flatnonzero(first)
    return begin, np.append(begin[1:], len(first))


def _covered(data: bytes, starts, ends, hashes, at, row, doc, k: int) -> np.ndarray:
    """Which windows have an equal one in a smaller document of the same bucket."""
    one, two = _window_hashes(hashes, at, k)
    owner = doc[row]
    order = np.lexsort((at, owner, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    heads = order[np.flatnonzero(new)]
    like = np.empty(len(order), np.int64)
    like[order] = heads[np.cumsum(new) - 1]
    covered = owner > owner[like]
    # Stretches of one string that equal a stretch of one other string are compared as a whole.
    mine = np.flatnonzero(covered)
    if len(mine):
        other = like[mine]
        breaks = np.ones(len(mine), bool)
        breaks[1:] = (np.diff(mine) != 1) | (np.diff(other) != 1) | (np.diff(row[mine]) != 0) | (np.diff(row[other]) != 0)
        begin, stop = _stretches(breaks)
        a, b = at[mine[begin]], at[other[begin]]
        more = stop - begin + k - 2
        spans = zip(starts[a].tolist(), ends[a + more].tolist(), starts[b].tolist(), ends[b + more].tolist())
        if not all(data[p:q] == data[r:s] for p, q, r, s in spans):
            texts = [data[x:y] for x, y in zip(starts[at].tolist(), ends[at + k - 1].tolist())]
            least: dict[bytes, int] = {}
            for text, d in zip(texts, owner.tolist()):
                least[text] = min(d, least.get(text, d))
            covered = np.fromiter((d > least[t] for t, d in zip(texts, owner.tolist())), bool, len(texts))
    return covered


def _judge(rows: pa.Table, hot: np.ndarray, broken, k: int):
    """Covered spans of whole buckets; for buckets that lie in several places also the windows that stay open, with their digests."""
    key, doc = (rows.column(c).to_numpy() for c in ("minimiser", "doc_id"))
    begin, stop = _stretches(np.append(True, key[1:] != key[:-1]))
    split = np.isin(key, hot) | (key == broken if broken is not None else False)
    several = np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)
    wanted = np.repeat(several, stop - begin) | split
    if not wanted.any():
        return None
    rows, split = rows.filter(pa.array(wanted)).combine_chunks(), split[wanted]
    doc, text_key, start = (rows.column(c).to_numpy() for c in ("doc_id", "text_key", "start"))
    packed = pa.concat_arrays(rows.column("packed").chunks).cast(pa.large_binary())
    _, offsets, buffer = packed.buffers()
    limits = np.frombuffer(offsets, np.int64)[packed.offset:packed.offset + len(packed) + 1]
    data = memoryview(buffer)[limits[0]:limits[-1]].tobytes()
    limits = limits - limits[0]
    text = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(text == 32)
    starts, ends = np.sort(np.concatenate([limits[:-1], gaps + 1])), np.sort(np.concatenate([gaps, limits[1:]]))
    hashes = word_hashes(text, starts, ends)
    first = np.searchsorted(starts, limits)
    row = np.repeat(np.arange(len(doc)), np.diff(first))
    at = np.flatnonzero(np.arange(len(starts)) + k <= first[1:][row])
    row = row[at]
    covered = _covered(data, starts, ends, hashes, at, row, doc, k)
    place = start[row] + at - first[row]
    mine = np.flatnonzero(covered)
    breaks = np.ones(len(mine), bool)
    breaks[1:] = (np.diff(mine) != 1) | (np.diff(row[mine]) != 0)
    begin, stop = _stretches(breaks) if len(mine) else (mine, mine)
    a, z = mine[begin], mine[stop - 1]
    open_ = np.flatnonzero(~covered & split[row])
    prints = [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(starts[at[open_]].tolist(), ends[at[open_] + k - 1].tolist())]
    which = np.concatenate([a, open_])
    if not len(which):
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[row[which]]), pa.array(text_key[row[which]]), pa.array(place[which]),
         pa.array(np.concatenate([place[z], place[open_]]) + k), pa.array([None] * len(a) + prints, pa.binary())],
        names=["doc_id", "text_key", "from", "upto", "print"])


def _buckets(k: int, hot: np.ndarray, chunk: int):
    """Judge rows that come sorted by minimiser; of a bucket larger than a chunk, part after part."""
    def run(batches):
        held, size, broken = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < chunk:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("minimiser").to_numpy()
            upto = int(np.searchsorted(key, key[-1]))
            if upto == 0:
                broken, upto = key[-1], len(key)
            out = _judge(rows.slice(0, upto), hot, broken, k)
            held = rows.slice(upto).to_batches()
            size = sum(b.nbytes for b in held)
            if out is not None:
                yield out
        if held:
            out = _judge(pa.Table.from_batches(held), hot, broken, k)
            if out is not None:
                yield out
    return run


def _left(text: np.ndarray, spans) -> tuple[int, int, bytes]:
    """Words of a text, how many of them the spans cover, and the others joined by one space."""
    text = joined(text)
    starts, ends = word_limits(text)
    if not spans:
        return len(starts), 0, text.tobytes()
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, [s["from"] for s in spans], 1)
    np.add.at(depth, [s["upto"] for s in spans], -1)
    gone = np.cumsum(depth)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    kept = b" ".join(text[starts[a]:ends[b - 1]].tobytes() for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))
    return len(starts), int(gone.sum()), kept


def _without(batches):
    """What is left of each text; rows leave as soon as they make up a batch."""
    def emit(rows):
        ids, words, removed, kept = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"])

    rows, size = [], 0
    for batch in batches:
        data, limits = W.buffers(batch.column(1))
        for i in range(batch.num_rows):
            rows.append((batch.column(0)[i].as_py(), *_left(data[limits[i]:limits[i + 1]], batch.column(2)[i].as_py())))
            size += len(rows[-1][3])
            if size >= BATCH or len(rows) >= 5000:
                yield emit(rows)
                rows, size = [], 0
    if rows:
        yield emit(rows)


def spans(docs: DataFrame, k: int = 50, least: int = 1000, chunk: int = 8 << 20) -> DataFrame:
    """doc_id, text_key (hash of the text), from, upto: stretches of words covered by windows that start in a smaller document too."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    hot, parts = _hot(rows, k, least)
    strings = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_runs(k, hot, parts), RUNS)
    dealt = strings.repartition("minimiser", "salt").sortWithinPartitions("minimiser")
    judged = stored(dealt.mapInArrow(_buckets(k, hot, chunk), SPANS), "spans")
    left = judged.filter(F.col("print").isNotNull())
    first = left.groupBy("print").agg(F.min("doc_id").alias("least"))
    late = left.join(first, "print").filter(F.col("doc_id") > F.col("least"))
    columns = ["doc_id", "text_key", "from", "upto"]
    return judged.filter(F.col("print").isNull()).select(*columns).unionByName(late.select(*columns))


def without_repeats(docs: DataFrame, k: int = 50, **settings) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, for every row."""
    by_text = spans(docs, k, **settings).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("from", "upto")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text"))
    return rows.join(by_text, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans").mapInArrow(_without, KEPT)
