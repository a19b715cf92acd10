"""Near-duplicate documents by b-bit MinHash.

Each text becomes its set of word shingles and 1,024 minima of seeded hashes. Bands of six minima give candidates, the four
low bits of every minimum are packed into 64 longs, and the share of equal groups of bits, corrected for chance collisions,
estimates the similarity. What passes is confirmed on the full sets.

Two texts with similarity s share one of 42 bands with probability 1 - (1 - s**6)**42: 0.999997 at 0.8.

Cases: null or empty text, or one without words, has an empty set and is linked with nothing. A text with fewer words than
a shingle is one shingle. Equal sets are one class, whatever their number. Rows that repeat an id are rows of their own.
A null id never names a component; a class with null ids only has a null component and is not kept. Empty in, empty out.
Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.llm import words as W
from paywarden.llm.components import components
from paywarden.llm.shared import in_hand, stored, travels

travels(__name__)

MINIMA, BANDS, ROWS, BITS = 1024, 42, 6, 4
PACKED = 64 // BITS
_seeds = np.random.default_rng(77)
XOR = _seeds.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
TIMES = (_seeds.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * 2 + 1)
#: An estimate may fall so many of its standard deviations below the threshold.
DEVIATIONS = 5
#: Sets and shingles of one part of a bucket or family; a task holds two parts.
UNIT, UNIT_SHINGLES = 1024, 2_000_000
#: Longs of the coarse estimate that is taken before the one from all of them.
COARSE = 8

KEY = "_set_key"
SIGNED = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, low_bits array<bigint>"


def _sets(column: pa.Array, n: int):
    """Row number and sorted distinct shingle hashes of each text."""
    for first, hashes, limits in W.word_groups(column, W.WHITE):
        for i in range(len(limits) - 1):
            yield first + i, np.unique(W.shingles(hashes[limits[i]:limits[i + 1]], n))


def _key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest value of each seeded hash over one set; 512 shingles at a time."""
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    high = (found >> W.U(32)).astype(np.uint32)
    for k in range(0, len(high), 512):
        np.minimum(out, ((high[k:k + 512, None] ^ XOR) * TIMES).min(axis=0), out=out)
    return out


def low_bits(lowest: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, 16 of them in each long."""
    kept = W.mix(lowest.astype(W.U)) & W.U((1 << BITS) - 1)
    return (kept.reshape(-1, PACKED) << (W.U(BITS) * np.arange(PACKED, dtype=W.U))).sum(axis=1, dtype=W.U).view(np.int64)


def band_keys(lowest: np.ndarray) -> np.ndarray:
    rows = lowest[:BANDS * ROWS].reshape(BANDS, ROWS).astype(W.U)
    return W.mix((rows * W.PLACE[None, :ROWS]).sum(axis=1, dtype=W.U) + np.arange(BANDS, dtype=W.U) * W.PLACE[9]).view(np.int64)


def _signer(n: int):
    def sign(batches):
        for batch in in_hand(batches):
            rows = {}
            for i, found in _sets(batch.column(1), n):
                if len(found):
                    lowest = minima(found)
                    rows[i] = len(found), _key(found), band_keys(lowest).tolist(), low_bits(lowest).tolist()
            ordered = [rows.get(i, (0, None, None, None)) for i in range(batch.num_rows)]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in ordered], pa.int64()), pa.array([r[1] for r in ordered], pa.binary()),
                 pa.array([r[2] for r in ordered], longs), pa.array([r[3] for r in ordered], longs)],
                names=["doc_id", "n_shingles", "set_key", "bands", "low_bits"])
    return sign


def _set_writer(n: int):
    def write(batches):
        for batch in in_hand(batches):
            keys, sets = [], []
            for _, found in _sets(batch.column(0), n):
                if len(found):
                    keys.append(_key(found))
                    sets.append(found.view(np.int64))
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["set_key", "members"])
    return write


def signatures(docs: DataFrame, n: int = 5) -> DataFrame:
    """One row per document: set size, digest of the set, band keys and packed low bits (null for an empty set)."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_signer(n), SIGNED)


def _unequal(x: Column, y: Column) -> Column:
    """How many of the minima packed in two longs differ in their low bits."""
    differ = x.bitwiseXOR(y)
    for shift in (1 << k for k in range(BITS.bit_length() - 1)):
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, shift))
    return F.bit_count(differ.bitwiseAND(F.lit(int(("0" * (BITS - 1) + "1") * PACKED, 2))))


def _similarity(unequal: Column, longs: int) -> Column:
    """Unequal minima agree in their low bits by chance once in 2**BITS; this corrects for it."""
    return 1 - unequal / F.lit(longs * PACKED * (1 - 0.5 ** BITS))


def coarse_estimate(a: Column, b: Column) -> Column:
    """Similarity from the first longs only, as plain arithmetic that Spark compiles."""
    return _similarity(sum((_unequal(a[i], b[i]) for i in range(COARSE)), F.lit(0)), COARSE)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from all packed low bits."""
    unequal = F.aggregate(F.zip_with(a, b, _unequal), F.lit(0), lambda total, x: total + x.cast("int"))
    return _similarity(unequal, MINIMA // PACKED)


def lowest_estimate(threshold: int, minima_used: int) -> float:
    """The estimate that a pair of just this similarity falls below once in some million cases."""
    chance = 0.5 ** BITS
    equal = chance + (1 - chance) * threshold / 100
    return threshold / 100 - DEVIATIONS * (equal * (1 - equal) / minima_used) ** 0.5 / (1 - chance)


def similar(l: str, r: str, threshold: int) -> Column:
    """Whether two rows with n_shingles and low_bits may be as similar as asked: by set sizes, then by both estimates."""
    bits, sizes = (F.col(f"{l}.low_bits"), F.col(f"{r}.low_bits")), (F.col(f"{l}.n_shingles"), F.col(f"{r}.n_shingles"))
    return ((F.least(*sizes) * 100 >= F.greatest(*sizes) * threshold)
            & (coarse_estimate(*bits) >= lowest_estimate(threshold, COARSE * PACKED))
            & (estimate(*bits) >= lowest_estimate(threshold, MINIMA)))


def full_sets(docs: DataFrame, signed: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """set_key and members of the sets in ``needed`` (set_key, distinct); only texts that have one are read again."""
    ids = signed.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("doc_id")).join(needed, "set_key").select("doc_id").distinct()
    read = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    layout = "set_key binary, members array<bigint>"
    sets = read.join(ids, "doc_id", "left_semi").select("text").mapInArrow(_set_writer(n), layout)
    if not signed.filter(F.col("doc_id").isNull() & F.col("set_key").isNotNull()).isEmpty():
        # No id leads to a set whose ids are all null; the set itself does.
        nameless = read.filter(F.col("doc_id").isNull()).select("text").mapInArrow(_set_writer(n), layout).dropDuplicates(["set_key"])
        sets = sets.union(nameless.join(needed, "set_key", "left_semi").select("set_key", "members"))
    return stored(sets, "sets").dropDuplicates(["set_key"])


def confirmed(docs: DataFrame, signed: DataFrame, pairs: DataFrame, n: int, threshold: int) -> DataFrame:
    """The pairs of set digests (a, b) whose full sets are as similar as asked."""
    sets = full_sets(docs, signed, pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct(), n)
    a = sets.select(F.col("set_key").alias("a"), F.col("members").alias("members_a"))
    b = sets.select(F.col("set_key").alias("b"), F.col("members").alias("members_b"))
    shared = F.size(F.array_intersect("members_a", "members_b"))
    return pairs.join(a, "a").join(b, "b").filter(
        shared * 100 >= (F.size("members_a") + F.size("members_b") - shared) * threshold).select("a", "b")


def in_units(rows: DataFrame, group: str, most: int, most_shingles: int) -> DataFrame:
    """``rows`` with the units (group, low, high) in which they meet all others of their group; a unit's rows arrive together.

    A group is cut by a hash into parts of about ``most`` rows and ``most_shingles``, and every two parts are a unit, so that no
    task holds more than two parts. ``part`` tells them apart.
    """
    parts = rows.groupBy(group).agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("n_shingles") / most_shingles)).cast("int").alias("parts"))
    cut = rows.join(parts, group).withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int"))
    meets = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    unit = [F.col(group).alias("group"), F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")]
    return meets.select(*unit, "part", *[c for c in rows.columns if c != group])


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high")


def _units(batches):
    """The rows of each (group, low, high) as one table; they arrive sorted by it."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_pylist() for c in range(3)]
        places = list(zip(*keys))
        cuts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1]), len(places)]
        for first, last in zip(cuts, cuts[1:]):
            if held and places[first] != at:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = places[first]
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _maybe(i: int, later: np.ndarray, bits: np.ndarray, sizes: np.ndarray, threshold: int) -> np.ndarray:
    """Those of ``later`` that may be as similar to row ``i`` as asked: by set sizes, then by both estimates."""
    least, greatest = np.minimum(sizes[later], sizes[i]), np.maximum(sizes[later], sizes[i])
    later = later[least * 100 >= greatest * threshold]
    ones = W.U(int(("0" * (BITS - 1) + "1") * PACKED, 2))
    for longs in (COARSE, MINIMA // PACKED):
        differ = bits[later, :longs] ^ bits[i, :longs]
        for shift in (1 << k for k in range(BITS.bit_length() - 1)):
            differ |= differ >> W.U(shift)
        unequal = np.bitwise_count(differ & ones).sum(axis=1, dtype=np.int64)
        later = later[1 - unequal / (longs * PACKED * (1 - 0.5 ** BITS)) >= lowest_estimate(threshold, longs * PACKED)]
    return later


def _forest(tree: np.ndarray, linked) -> list[tuple[int, int]]:
    """Links (i, j) that join two trees not joined before; ``linked(i, later)`` picks i's links among open places."""
    tree, kept = tree.copy(), []
    for i in range(len(tree) - 1):
        open_ = i + 1 + np.flatnonzero(tree[i + 1:] != tree[i])
        for j in linked(i, open_).tolist() if len(open_) else ():
            if tree[i] != tree[j]:
                tree[tree == tree[j]] = tree[i]
                kept.append((i, j))
    return kept


def _pairs(unit: pa.Table, kept) -> pa.RecordBatch:
    keys = unit["set_key"].combine_chunks()
    return pa.RecordBatch.from_arrays([keys.take(pa.array([k[e] for k in kept], pa.int64())) for e in (0, 1)], names=["a", "b"])


def _sketched(threshold: int):
    """For the units of one band: a forest of the pairs that may be links and share this band first.

    The forest joins texts, not components: of two components each pair that may be a link has both texts in one family.
    """
    def run(batches):
        for unit in _units(batches):
            roots = unit["root"].combine_chunks().dictionary_encode()
            if unit.num_rows < 2 or len(roots.dictionary) < 2:
                continue
            root, part, sizes = roots.indices.to_numpy(), unit["part"].to_numpy(), unit["n_shingles"].to_numpy()
            bits, bands, band = _longs(unit["low_bits"]).view(W.U), _longs(unit["bands"]), unit["group"][0].as_py()
            within = part.min() == part.max()

            def linked(i, later):
                later = later[root[later] != root[i]]
                if not within:
                    later = later[part[later] != part[i]]
                if not len(later):
                    return later
                later = later[bands[i][(bands[later] == bands[i]).argmax(axis=1)] == band]
                return _maybe(i, later, bits, sizes, threshold)
            yield _pairs(unit, _forest(np.arange(unit.num_rows), linked))
    return run


def _exact(threshold: int):
    """For the units of one family: a forest of the links, decided on full sets."""
    def run(batches):
        for unit in _units(batches):
            roots = unit["root"].combine_chunks().dictionary_encode()
            if unit.num_rows < 2 or len(roots.dictionary) < 2:
                continue
            tree, part, sizes = roots.indices.to_numpy(), unit["part"].to_numpy(), unit["n_shingles"].to_numpy()
            bits, members = _longs(unit["low_bits"]).view(W.U), unit["members"].combine_chunks()
            limits = members.offsets.to_numpy().astype(np.int64)
            limits -= limits[0]
            values, numbers = np.unique(members.flatten().to_numpy(), return_inverse=True)
            mark = np.zeros(len(values), bool)
            within = part.min() == part.max()

            def linked(i, later):
                if not within:
                    later = later[part[later] != part[i]]
                later = _maybe(i, later, bits, sizes, threshold)
                if not len(later):
                    return later
                own = numbers[limits[i]:limits[i + 1]]
                mark[own] = True
                shared = np.array([np.count_nonzero(mark[numbers[limits[j]:limits[j + 1]]]) for j in later])
                mark[own] = False
                return later[shared * 100 >= (sizes[later] + sizes[i] - shared) * threshold]
            yield _pairs(unit, _forest(tree, linked))
    return run


def _rooted(docs: DataFrame, n: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of ``docs``, and set_key, doc_id (the smallest) and root of every distinct set.

    Links join texts with 100 * intersection >= threshold * union. Each text is compared with the smallest leader of its
    buckets first, which makes most of a large group one component; then with the leaders of other components only; then
    members of one bucket that are still in different components with each other, each pair in the first band it shares.
    Neither copies nor texts that are near the threshold without being linked are expanded into rows of pairs.
    """
    signed = stored(signatures(docs, n), "signatures")
    classes = stored(signed.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        F.first("low_bits").alias("low_bits")), "classes")
    members = classes.select("set_key", F.explode("bands").alias("band"))
    leaders = members.groupBy("band").agg(F.min("set_key").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = stored(members.join(leaders, "band"), "buckets")
    sketches = stored(classes.join(buckets.select("set_key").distinct(), "set_key", "left_semi").select(
        "set_key", "n_shingles", "bands", "low_bits"), "sketches")

    def estimated(pairs: DataFrame) -> DataFrame:
        left, right = sketches.alias("l"), sketches.alias("r")
        return (pairs.join(left, F.col("a") == F.col("l.set_key")).join(right, F.col("b") == F.col("r.set_key"))
                .filter(similar("l", "r", threshold)).select("a", "b"))

    def confirm(pairs: DataFrame) -> DataFrame:
        return stored(confirmed(docs, signed, stored(pairs, "pairs"), n, threshold), "confirmed")

    def extended(roots: DataFrame, more: DataFrame) -> DataFrame:
        """The components with further links; a node's root stands for all links that it had before."""
        return stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "roots")

    def still_open(roots: DataFrame) -> DataFrame:
        """Members, with their own and their leader's root, of the buckets that hold several components."""
        now = buckets.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select(
            "band", "set_key", "leader", "size", F.coalesce("root", "set_key").alias("root"))
        several = now.groupBy("band").agg(
            F.min("root").alias("low"), F.max("root").alias("high"),
            F.max(F.when(F.col("set_key") == F.col("leader"), F.col("root"))).alias("leader_root")).filter("low != high")
        return now.join(several.select("band", "leader_root"), "band")

    first = buckets.filter(F.col("set_key") != F.col("leader")).groupBy(F.col("set_key").alias("b")).agg(F.min("leader").alias("a")).select("a", "b")
    roots = stored(components(confirm(estimated(first))), "roots")
    star = still_open(roots).filter("root != leader_root").select(F.col("leader").alias("a"), F.col("set_key").alias("b")).distinct()
    roots = extended(roots, confirm(estimated(star)))
    # Who is left in a bucket of several components has been compared with its leader, but not with the others there. Pairs
    # never become rows: buckets give forests of what the estimate can't tell from links, and the families that these
    # make are met once more in units, with their full sets.
    link = "a binary, b binary"
    rest = still_open(roots).filter("size > 2 and set_key != leader").select("band", "set_key", "root").join(sketches, "set_key")
    unsure = _together(in_units(rest, "band", UNIT, UNIT_SHINGLES)).mapInArrow(_sketched(threshold), link)
    families = stored(components(unsure).withColumnRenamed("node", "set_key").withColumnRenamed("root", "family"), "families")
    if not families.isEmpty():
        sets = full_sets(docs, signed, families.select("set_key"), n)
        members = families.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key")).join(
            sketches.select("set_key", "n_shingles", "low_bits"), "set_key").join(sets, "set_key")
        links = _together(in_units(members, "family", UNIT, UNIT_SHINGLES)).mapInArrow(_exact(threshold), link)
        roots = extended(roots, stored(links, "confirmed"))
    rooted = classes.select("set_key", "doc_id").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select(
        "set_key", "doc_id", F.coalesce("root", "set_key").alias("root"))
    return signed, rooted


def near_duplicates(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, set_key, component_id and kept for every row of ``docs`` (doc_id, text)."""
    signed, rooted = _rooted(docs, n, threshold)
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("set_key", "component_id")
    return signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "set_key",
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _keyed(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with the digest of each row's set (null for an empty set) as the last column, ``KEY``."""
    at, names = docs.columns.index("text"), [*docs.columns, KEY]

    def run(batches):
        for batch in in_hand(batches):
            keys = [None] * batch.num_rows
            for i, found in _sets(batch.column(at), n):
                if len(found):
                    keys[i] = _key(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=names)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(KEY, T.BinaryType())]))


def without_copies(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row left of every group, and all rows without words.

    The row left has the smallest id of its group, a null id only where the group has no other, then the smallest set
    digest. Rows are told apart by id and set, so an id that comes with several texts loses only those that are copies;
    of rows alike in both, the one with the smallest text and other plain columns is left.
    """
    signed, rooted = _rooted(docs, n, threshold)
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "set_key")
    survivors = rooted.groupBy("root").agg(F.min(rank).alias("s")).select("s.doc_id", "s.set_key")
    rows = signed.filter(F.col("set_key").isNotNull()).groupBy("doc_id", "set_key").agg(F.count(F.lit(1)).alias("n"))
    r, s = rows.alias("r"), survivors.withColumn("survives", F.lit(True)).alias("s")
    same = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.set_key") == F.col("s.set_key"))
    judged = stored(r.join(s, same, "left").filter("survives is null or n > 1").select("r.*", "survives"), "judged")

    def among(frame: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        d, k = frame.alias("d"), keys.alias("k")
        return d.join(k, F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{KEY}") == F.col("k.set_key")), how)
    left = among(_keyed(docs, n), judged.filter("survives is null"), "left_anti")
    twice = judged.filter("survives")
    if twice.isEmpty():
        return left.select(docs.columns)
    single = among(left, twice, "left_anti").select(docs.columns)
    plain = [c.name for c in docs.schema.fields if isinstance(c.dataType, T.AtomicType) and c.name != "text"]
    one = among(left, twice, "left_semi").groupBy(KEY).agg(F.min_by(F.struct(*docs.columns), F.struct("text", *plain)).alias("row"))
    return single.union(one.select("row.*"))
