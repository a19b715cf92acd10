"""Near-duplicate vectors by a pivot-permutation index.

Several tables are kept beside each other. A table cuts the components into two halves and has reference points for each, drawn from a
bounded sample; their number grows with the root of the number of vectors, so that a list stays as long. A vector is described by the
pairs (nearest point of the first half, nearest point of the second) in order, and lies in the lists of its first three pairs. Two vectors
that share a list are compared, each pair in the first list that it shares; the exact cosine decides. Tables are added until pairs
at the threshold, tried on the sample, meet.

A list is read by one task; longer ones are cut into parts of bounded size and every two parts meet. Tables are worked off one
after the other, large ones a third of the lists at a time, so that about one copy of the vectors is on the way at once. The tasks return the number of links of
each vector and a spanning forest of them, so a large group never becomes rows of pairs.

Large groups have a centre. Vectors within half the angle of a centre are linked with each other without a look: only their
number is summed. They lie in no list; vectors that are near enough to be linked with one of them visit the centre instead.

Cases: a vector that is null, zero, or holds a null or a non-finite component links with nothing. Vectors of each length have
reference points and lists of their own, so only vectors of one length meet. Equal vectors are one class with a size; repeated ids are rows of their own; a null id is counted
as a link but names no component. Empty in, empty out; extra columns are ignored. The input is read more than once and must be the same each time.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.llm.components import components
from paywarden.llm.shared import in_hand, stored, travels

travels(__name__)

#: Reference points of a half, at most so many; rows of a part, at least so many; vectors of a list; lists of a vector in each table.
PIVOTS, BLOCK, LISTED, PROBES = 1024, 512, 512, 3
#: Pairs at the threshold that may meet in no table; tables, at most so many.
MISSED, TABLES = 0.005, 32
#: Vectors in the sample, at most so many and so many bytes; vectors of the sample that make a centre.
SAMPLE, SAMPLE_BYTES, HEAVY = 8192, 32 << 20, 6
#: Bytes of vectors that are on the way at once without a further cut; numbers of a product held at once.
AT_ONCE, CELLS = 128 << 20, 1 << 21
#: What the angles of large groups are short of, for rounding.
SLACK = 1e-7


def directions(values: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; scaled first, so that very large and very small components survive."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; zeros stay."""
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def spread_points(sample: np.ndarray, count: int, apart: float) -> np.ndarray:
    """The first rows of a sample that aren't as close as ``apart`` to one before them, at most ``count``: as dense as the sample, without copies."""
    picked = np.empty((0, sample.shape[1]))
    for at in range(0, len(sample), 256):
        rows = sample[at:at + 256]
        rows = rows[(rows @ picked.T < apart).all(axis=1)]
        near = np.tril(rows @ rows.T >= apart, -1)
        free = np.ones(len(rows), bool)
        for k in range(len(rows)):
            free[k] = not (near[k] & free).any()
        picked = np.concatenate([picked, rows[free]])[:count]
        if len(picked) == count:
            break
    return picked


@dataclass
class Index:
    """What the vectors of one length are described by."""

    #: Of each table: the components in order, how many are of the first half, and the points of both halves.
    tables: list = field(default_factory=list)
    #: Numbers of lists of a table; centres; the cosines of half and of one and a half times the angle.
    stride: int = 1
    centres: np.ndarray | None = None
    core: float = 1.0
    near: float = 1.0
    #: The number of the first centre.
    first: int = 0

    def lists(self, unit: np.ndarray) -> np.ndarray:
        """The lists of each vector, PROBES for each table; -1 where there is none."""
        unit, found = unit.astype(np.float32), []
        for number, (order, half, a, b) in enumerate(self.tables):
            mine, (p, q) = unit[:, order], (min(PROBES, len(a)), min(PROBES, len(b)))
            (i, x), (j, y) = _highest(mine[:, :half] @ a.T, p), _highest(mine[:, half:] @ b.T, q)
            both = (x[:, :, None] + y[:, None, :]).reshape(len(mine), p * q)
            k, _ = _highest(both, min(PROBES, p * q))
            ids = number * self.stride + np.take_along_axis(i, k // q, 1) * len(b) + np.take_along_axis(j, k % q, 1)
            found.append(np.pad(ids, ((0, 0), (0, PROBES - ids.shape[1])), constant_values=-1))
        return np.concatenate(found, axis=1).astype(np.int32)

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centre or -1, and which other centres it is near to."""
        cosine = unit @ self.centres.T
        if not len(self.centres):
            return np.full(len(unit), -1, np.int32), cosine > 2
        home = cosine.argmax(axis=1)
        core = cosine[np.arange(len(unit)), home] >= self.core
        near = cosine >= self.near
        near[np.flatnonzero(core), home[core]] = False
        return np.where(core, home + self.first, -1).astype(np.int32), near


def _highest(scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the highest scores of each row, in order, and the scores; ``scores`` are used up."""
    rows, at, best = np.arange(len(scores)), np.empty((len(scores), count), np.int64), np.empty((len(scores), count), scores.dtype)
    for k in range(count):
        at[:, k] = scores.argmax(axis=1)
        best[:, k] = scores[rows, at[:, k]]
        scores[rows, at[:, k]] = -np.inf
    return at, best


def _centres(sample: np.ndarray, threshold: float, core: float, near: float) -> np.ndarray:
    """Means of the large groups of a sample; a group with more than twice as many vectors around it as in it has none."""
    few, count = sample.astype(np.float32), np.empty(len(sample), np.int64)
    for k in range(0, len(few), 512):
        count[k:k + 512] = (few[k:k + 512] @ few.T >= threshold).sum(axis=1)
    open_, found = count >= HEAVY, []
    for k in np.argsort(-count, kind="stable").tolist():
        if count[k] < HEAVY:
            break
        if not open_[k]:
            continue
        centre = _scaled(sample[few @ few[k] >= threshold].mean(axis=0, keepdims=True))
        cosine = sample @ centre[0]
        inside = cosine >= core
        open_ &= ~inside
        open_[k] = False
        if inside.sum() >= HEAVY and (cosine >= near).sum() <= 3 * inside.sum():
            found.append(centre)
    return np.concatenate(found) if found else np.empty((0, sample.shape[1]))


def _twins(sample: np.ndarray, threshold: float, draw: np.random.Generator) -> np.ndarray:
    """For each vector another whose cosine with it is the threshold, in any direction."""
    aside = draw.normal(size=sample.shape)
    aside = _scaled(aside - (aside * sample).sum(axis=1, keepdims=True) * sample)
    return _scaled(threshold * sample + np.sqrt(max(0.0, 1 - threshold * threshold)) * aside)


def index_of(sample: np.ndarray, count: int, threshold: float, pivots: int = PIVOTS) -> Index:
    """The index for ``count`` vectors of which ``sample`` are some, as directions."""
    draw, length, angle = np.random.default_rng(sample.shape[1]), sample.shape[1], np.arccos(threshold)
    index = Index(core=float(np.cos(angle / 2)) + SLACK, near=float(np.cos(min(np.pi, 1.5 * angle))) - SLACK)
    index.centres = _centres(sample, threshold, index.core, index.near)
    points = max(1, min(pivots, round((PROBES * count / LISTED) ** 0.5)))
    index.stride = points * points
    some = sample[draw.permutation(len(sample))[:2048]]
    twins, apart = _twins(some, threshold, draw), np.ones(len(some), bool)
    while len(index.tables) < (TABLES if points > 1 else 1) and apart.mean() > MISSED or not index.tables:
        order, half = draw.permutation(length), (length + 1) // 2
        a, b = (spread_points(_scaled(sample[draw.permutation(len(sample))][:, part]), points, threshold) for part in (order[:half], order[half:]))
        table = Index([(order, half, a.astype(np.float32), b.astype(np.float32))])
        index.tables += table.tables
        x, y = table.lists(some), table.lists(twins)
        apart &= ~_meet(x, y)
    return index


def _meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).any(axis=(1, 2))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """The vectors of a column of bytes without nulls, all of one length."""
    if not len(column):
        return np.empty((0, 0), kind)
    limits = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2][int(limits[0]):int(limits[-1])], kind).reshape(len(column), -1)


def _single(values: np.ndarray) -> np.ndarray:
    """Rows at length one, about, in single precision."""
    few = (values / np.maximum(values.max(axis=1), -values.min(axis=1))[:, None]).astype(np.float32, copy=False)
    few /= np.sqrt(np.einsum("ij,ij->i", few, few))[:, None]
    return few


def _packer(kind: str):
    """(vec_id, embedding) to vec_id, length, 128 bits of hash, and the vector's bytes; nulls for a vector without a direction."""
    size = np.dtype(kind).itemsize

    def run(batches):
        for batch in in_hand(batches):
            column = batch.column(1)
            limits = column.offsets.to_numpy().astype(np.int64)
            values = column.values.slice(limits[0], limits[-1] - limits[0]).to_numpy(zero_copy_only=False).astype(kind) + np.array(0, kind)
            limits -= limits[0]
            sums = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[limits])
            good = (sums(~np.isfinite(values)) == 0) & (sums(values != 0) > 0) & column.is_valid().to_numpy(zero_copy_only=False)
            whole, at = values.tobytes(), (limits * size).tolist()
            texts = [whole[at[k]:at[k + 1]] if ok else None for k, ok in enumerate(good.tolist())]
            digests = np.frombuffer(b"".join(hashlib.blake2b(t or b"", digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)
            none = ~good
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(limits).astype(np.int32), mask=none), pa.array(np.ascontiguousarray(digests[:, 0]), mask=none),
                 pa.array(np.ascontiguousarray(digests[:, 1]), mask=none), pa.array(texts, pa.binary())], names=["vec_id", "length", "x", "y", "vec"])
    return run


def _listed(places: np.ndarray, rows: int, values: np.ndarray) -> pa.Array:
    """An array for each row; ``places`` are the rows of ``values``, in order."""
    limits = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(limits), pa.array(values.astype(np.int32)))


def _describer(indexes: dict[int, Index], kind: str):
    """Adds home (a centre or -1), near (centres to visit) and lists (none for a vector with a home) to the classes."""
    def run(batches):
        for batch in in_hand(batches):
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths).tolist():
                rows = batch.take(pa.array(np.flatnonzero(lengths == length)))
                index, unit = indexes[length], directions(_matrix(rows.column("vec"), kind))
                home, near = index.visits(unit)
                free = home < 0
                lists = index.lists(unit[free])
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(home), _listed(*(lambda i, j: (i, len(unit), j + index.first))(*np.nonzero(near))),
                     _listed(np.repeat(np.flatnonzero(free), lists.shape[1]), len(unit), lists.ravel())], names=[*rows.schema.names, "home", "near", "lists"])
    return run


def _joined(tree: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots after the links (i, j), and the places of links that join two trees not joined before."""
    kept, at = [], np.arange(len(i))
    while True:
        a, b = tree[i[at]], tree[j[at]]
        apart = a != b
        if not apart.any():
            return tree, np.concatenate(kept) if kept else np.empty(0, np.int64)
        at, high, low = at[apart], np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        roots, first = np.unique(high, return_index=True)
        kept.append(at[first])
        tree = tree.copy()
        tree[roots] = low[first]
        while not np.array_equal(further := tree[tree], tree):
            tree = further


def _close(values: np.ndarray, few: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, same: bool):
    """The pairs (i, j) of rows whose cosine reaches the threshold, a part at a time; within one side each pair once.

    ``few`` are the rows' directions in single precision; where these can't decide, it is done in double precision.
    """
    a, b, margin = few[left], few[right], max(1e-5, 4e-7 * few.shape[1])
    step = max(1, min(256, CELLS // max(1, len(b))))
    for k in range(0, len(a), step):
        from_ = k if same else 0
        cosine = a[k:k + step] @ b[from_:].T
        i, j = np.divmod(np.flatnonzero(cosine >= threshold - margin), cosine.shape[1])
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        sure = cosine[i, j] >= threshold + margin
        i, j = left[i + k], right[j + from_]
        open_ = np.flatnonzero(~sure)
        for m in range(0, len(open_), 16384):
            at = open_[m:m + 16384]
            sure[at] = np.einsum("ij,ij->i", directions(values[i[at]]), directions(values[j[at]])) >= threshold
        yield i[sure], j[sure]


def _first_met(x: np.ndarray, y: np.ndarray, here: int, stride: int) -> np.ndarray:
    """Whether the rows' lists share none before the list ``here``."""
    alive = np.arange(len(x))
    for table in range(here // stride + 1):
        own = slice(table * PROBES, (table + 1) * PROBES)
        p, q = x[alive, own][:, :, None], y[alive, own][:, None, :]
        alive = alive[~((p == q) & (p >= 0) & (p < here)).any(axis=(1, 2))]
    out = np.zeros(len(x), bool)
    out[alive] = True
    return out


#: A unit: the list with the length of its vectors above 32 bits, and two parts of it.
UNIT = ["list", "low", "high"]


def _linker(threshold: float, kind: str, strides: dict[int, int] | None):
    """For each unit: the number of links of each vector, and a forest of them (n is 0).

    Rows of side 0 meet those of side 1, and their own side where ``own`` says so. With ``strides`` a unit is part of a list, and a
    pair counts in the first list that it shares; without, side 0 has vectors of one centre and side 1 its visitors,
    and a pair of two centres counts at the lower one.
    """
    def met(columns: dict, list_: int, rows: slice, out: list) -> None:
        node, size, side, own, home, lists, values, few = (columns[c][rows] for c in ("node", "size", "side", "own", "home", "lists", "values", "few"))
        places = [np.flatnonzero(side == s) for s in (0, 1)]
        links, tree = np.zeros(len(node), np.int64), np.arange(len(node))
        meets = [(s, s) for s in (0, 1) if len(places[s]) > 1 and own[places[s][0]]] + [(0, 1)] * (len(places[0]) > 0 < len(places[1]))
        for s, t in meets:
            for i, j in _close(values, few, places[s], places[t], threshold, s == t):
                counts = np.empty(len(i), bool)
                for k in range(0, len(i), 65536):
                    p, q = i[k:k + 65536], j[k:k + 65536]
                    counts[k:k + 65536] = _first_met(lists[p], lists[q], list_ & 0xFFFFFFFF, strides[list_ >> 32]) if strides else (home[q] < 0) | (home[p] < home[q])
                i, j = i[counts], j[counts]
                links += np.bincount(i, size[j], len(links)).astype(np.int64) + np.bincount(j, size[i], len(links)).astype(np.int64)
                tree, kept = _joined(tree, i, j)
                out.append((node[i[kept]], node[j[kept]], np.zeros(len(kept), np.int64)))
        some = np.flatnonzero(links)
        out.append((node[some], node[some], links[some]))

    def of(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        """The links of all units of a table, but of the last one only if no rows follow; what is left."""
        keys = [table[c].to_numpy() for c in UNIT]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        cuts = [0, *cuts.tolist(), *[table.num_rows] * last]
        lengths, out = keys[0] >> 32, []
        turns = [0, *(np.flatnonzero(np.diff(lengths[:cuts[-1]])) + 1).tolist(), cuts[-1]]
        for from_, to in zip(turns, turns[1:]):
            if from_ < to:
                some = table.slice(from_, to - from_)
                columns = {c: some[c].to_numpy() for c in ("node", "size", "side", "own", "home")}
                columns["values"] = _matrix(some["vec"].chunk(0), kind)
                columns["few"] = _single(columns["values"])
                columns["lists"] = some["lists"].chunk(0).flatten().to_numpy().reshape(len(some), -1) if strides else columns["home"]
                for a, b in zip(cuts, cuts[1:]):
                    if from_ <= a and b <= to and b - a > 1:
                        met(columns, int(keys[0][a]), slice(a - from_, b - from_), out)
        a, b, n = (np.concatenate([np.empty(0, np.int64), *(o[k] for o in out)]) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"]), table.slice(cuts[-1])

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [tuple(batch.column(c)[k].as_py() for c in UNIT) for k in (0, batch.num_rows - 1)]
            held.append(batch)
            if ends[0] == ends[1] == key or key is None and ends[0] == ends[1]:
                key = ends[1]
                continue
            key = ends[1]
            found, rest = of(pa.Table.from_batches(held).combine_chunks(), False)
            held = rest.to_batches()
            yield found
        if held:
            yield of(pa.Table.from_batches(held).combine_chunks(), True)[0]
    return run


LINKS = "a bigint, b bigint, n bigint"

#: Whether the files of a query's shuffles are removed when it ends.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _linked(rows: DataFrame, link) -> DataFrame:
    return stored(rows.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(link, LINKS), "links")


def _drawn(vectors: DataFrame, count: int, most: int) -> pa.Array:
    """The embeddings with the ``most`` smallest hashes, each once; those that can't be among them are dropped before any sort."""
    order = F.xxhash64("embedding")
    if count > 16 * most:
        # The share of hashes below the limit is 8 times what is needed; fewer than needed practically can't be.
        limit = -(1 << 63) + int((1 << 64) * (8 * most / count))
        below = vectors.filter(order < F.lit(limit)).select("embedding").distinct().orderBy(order, "embedding").limit(most).toArrow()
        if below.num_rows == most:
            return below["embedding"].combine_chunks()
    return vectors.select("embedding").distinct().orderBy(order, "embedding").limit(most).toArrow()["embedding"].combine_chunks()


@contextmanager
def _shuffles_end(spark: SparkSession):
    """What a query inside has shuffled is removed from the disk as soon as it ends, not when the driver's memory happens to be cleaned."""
    was = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_KEY) if was is None else spark.conf.set(CLEANUP_KEY, was)


def _in_lists(described: DataFrame, indexes: dict[int, Index], threshold: float, kind: str, block: int, nbytes: int) -> list[DataFrame]:
    """The links of pairs that share a list."""
    key = F.shiftleft(F.col("length").cast("bigint"), 32)
    free = described.filter(F.size("lists") > 0)
    each = lambda lists: free.select("*", F.explode(lists).alias("at")).filter("at >= 0").withColumn("list", key + F.col("at"))
    long = stored(each(F.col("lists")).groupBy("list").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 2 * block).select(
        "list", F.ceil(F.col("rows") / block).cast("int").alias("parts")), "long")
    cut = not long.isEmpty()
    # One table at a time and of a large one a share of the lists; or several tables of a small one.
    shares = _shares(nbytes)
    together = max(1, AT_ONCE // (PROBES * nbytes))
    tables, out = max(len(i.tables) for i in indexes.values()), []
    link = _linker(threshold, kind, {length: i.stride for length, i in indexes.items()})
    for first in range(0, tables, together):
        for share in range(shares):
            rows = each(F.slice("lists", first * PROBES + 1, together * PROBES)).filter(F.pmod("at", F.lit(shares)) == share)
            rows = rows.select("list", "node", "size", "home", "vec", F.slice("lists", 1, (first + together) * PROBES).alias("lists"))
            if cut:
                part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
                rows = rows.join(F.broadcast(long), "list", "left").withColumn("part", F.coalesce(part, F.lit(0))).withColumn("other", F.explode(
                    F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part")))))
                # The pairs inside a part are met where it meets the next one.
                rows = rows.withColumns({
                    "low": F.least("part", "other"), "high": F.greatest("part", "other"), "side": (F.col("part") > F.col("other")).cast("int"),
                    "own": F.coalesce(F.col("other") == F.pmod(F.col("part") + 1, F.col("parts")), F.lit(True))}).drop("part", "other", "parts")
            else:
                rows = rows.withColumns({"low": F.lit(0), "high": F.lit(0), "side": F.lit(0), "own": F.lit(True)})
            out.append(_linked(rows, link))
    return out


def _shares(nbytes: int) -> int:
    """In how many shares the lists are worked off, for so many bytes of vectors."""
    return 1 if PROBES * nbytes <= AT_ONCE else PROBES


def _at_centres(described: DataFrame, threshold: float, kind: str, block: int, nbytes: int) -> list[DataFrame]:
    """The links of vectors that have a centre: with each other by number alone, and with those that visit it."""
    core = described.filter("home >= 0")
    groups = stored(core.groupBy("home").agg(F.min("node").alias("least"), F.sum("size").alias("total"), F.count(F.lit(1)).alias("rows")), "centres")
    members = core.select("home", "node", "size").join(F.broadcast(groups), "home")
    out = [stored(members.select(F.explode(F.array(
        F.struct(F.col("node").alias("a"), F.col("node").alias("b"), (F.col("total") - F.col("size")).alias("n")),
        F.struct(F.col("node").alias("a"), F.col("least").alias("b"), F.lit(0).cast("bigint").alias("n")))).alias("l")).select("l.*"), "links")]
    visitors = described.select("length", "node", "size", "home", "vec", F.explode("near").alias("centre"))
    visited = stored(visitors.groupBy("centre").agg(F.count(F.lit(1)).alias("visits")).join(groups, F.col("centre") == F.col("home")).select(
        "centre", F.ceil(F.col("rows") / block).cast("int").alias("parts"), F.ceil(F.col("visits") / block).cast("int").alias("visits")), "visited")
    if visited.isEmpty():
        return out
    key, shares = F.shiftleft(F.col("length").cast("bigint"), 32) + F.col("centre"), _shares(nbytes)

    def met(rows: DataFrame, side: int, share: int) -> DataFrame:
        own, others = ("parts", "visits") if side == 0 else ("visits", "parts")
        rows = rows.filter(F.pmod("centre", F.lit(shares)) == share).join(F.broadcast(visited), "centre").withColumn("part", F.pmod(F.xxhash64("node"), F.col(own)).cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        low, high = ("part", "other") if side == 0 else ("other", "part")
        return rows.select(key.alias("list"), "node", "size", "home", "vec", F.col(low).alias("low"), F.col(high).alias("high"),
                           F.lit(side).alias("side"), F.lit(False).alias("own"))
    cores = core.select("length", "node", "size", "home", "vec", F.col("home").alias("centre"))
    return out + [_linked(met(cores, 0, k).union(met(visitors, 1, k)), _linker(threshold, kind, None)) for k in range(shares)]


def near_vectors(vectors: DataFrame, threshold: float = 0.9, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding)."""
    with _shuffles_end(vectors.sparkSession):
        return _near_vectors(vectors, threshold, pivots, block)


def _near_vectors(vectors: DataFrame, threshold: float, pivots: int, block: int) -> DataFrame:
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    # Equal vectors are one class; the key is 128 bits of hash, so the vector itself is not grouped by.
    packed = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>" if single else "array<double>")).mapInArrow(
        _packer(kind), "vec_id bigint, length int, x bigint, y bigint, vec binary")
    keyed = stored(packed.select("vec_id", "length", "x", "y"), "vectors")
    usable = packed.filter(F.col("x").isNotNull())
    count = {r.length: r["count"] for r in keyed.filter(F.col("x").isNotNull()).select("length", "x", "y").distinct().groupBy("length").count().collect()}
    if not count:
        return keyed.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
                            F.col("vec_id").isNotNull().alias("kept"))
    indexes, first = {}, 0
    for length in sorted(count):  # lengths are few: each is a table's or model's width
        most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * length)))
        drawn = _drawn(usable.filter(F.col("length") == length).select(F.col("vec").alias("embedding")), count[length], most)
        indexes[length] = index_of(directions(_matrix(drawn, kind)), count[length], threshold, pivots)
        indexes[length].first = first
        first += len(indexes[length].centres)
    classes = usable.groupBy("x", "y").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("size"), F.first("length").alias("length"), F.first("vec").alias("vec"))
    described = classes.mapInArrow(_describer(indexes, kind), "x bigint, y bigint, vec_id bigint, size bigint, length int, vec binary, home int, near array<int>, lists array<int>")
    described = stored(described.withColumn("node", F.monotonically_increasing_id()), "described")
    block = max(block, min(16384, sum(count.values()) // 64))
    nbytes = sum(length * n for length, n in count.items()) * np.dtype(kind).itemsize
    links = _in_lists(described, indexes, threshold, kind, block, nbytes)
    if first:
        links += _at_centres(described, threshold, kind, block, nbytes)
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    counts = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.filter("n = 0").select("a", "b"))
    named = described.select("x", "y", "node", "vec_id", "size").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    answer = named.join(lowest, "root").select("x", "y", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "x", "y").join(answer, ["x", "y"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("x").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
