"""Benchmark items inside documents, by SimHash windows and exact weighted-shingle similarity; DataFrame functions only.

Words are runs of letters and digits, case ignored. A document window has as many words as the item it may hold. A window as
similar as asked shares five-word shingles with the item, so windows are laid where a shingle of the benchmark stands, aligned with
the item's words and up to two words to either side. Each window gets a 64-bit SimHash of its words and word
pairs. Fingerprints of items and windows meet through eight blocks of eight bits, each with up to one bit flipped on
the item's side: of two fingerprints within radius 15 one block differs in at most one bit, so none is missed.
Candidates are then compared by the weighted similarity of their shingles: sum of the smaller counts over sum of the larger.

Cases: null and empty texts, and items without words, match nothing. An item or a window of fewer than five words is one
shingle; such items are looked for by runs of their own length, in documents of any length. Repeated items match each on their own, repeated rows of documents are separate, null ids stay null. Empty
tables give no matches. Extra columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.llm.licenses import words_of
from paywarden.llm.shared import bounded, stored

SHINGLE, RADIUS, SHIFT = 5, 15, 2
#: Benchmark shingles up to this number are broadcast; more are joined by a shuffle.
BROADCAST_SHINGLES = 500_000
#: Texts with windows up to this number meet the documents by a broadcast of their places; more by a shuffle.
BROADCAST_TEXTS = 100_000


def _shingles(words: Column, n: int = SHINGLE) -> Column:
    """Hash of the ``n`` words from each place on; a shorter text is one shingle."""
    whole = F.array(F.xxhash64(F.lit(n), F.array_join(words, " ")))
    runs = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(0))),
                       lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)]))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < n, whole).otherwise(runs)


def _short_runs(words: Column, size: int) -> Column:
    """The one shingle of each run of ``size`` words, fewer than a shingle has."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(0))), lambda w, i: F.xxhash64(
        F.lit(SHINGLE), F.array_join(F.array(w, *[F.get(words, i + k) for k in range(1, size)]), " ")))


def _placed(words: Column, short: list[int]) -> list[Column]:
    """at and shingle of the text's shingles, and of its runs as long as one of the short items."""
    if not short:
        return [F.posexplode(_shingles(words)).alias("at", "shingle")]
    lists = [_shingles(words), *[_short_runs(words, size) for size in short]]
    return [F.inline(F.concat(*[F.transform(x, lambda h, i: F.struct(i.alias("at"), h.alias("shingle"))) for x in lists])).alias("at", "shingle")]


def _counted(words: Column, per_long: int) -> Column:
    """SimHash from sums of the 64 bits, ``per_long`` counters to a long."""
    width = 64 // per_long
    lanes = F.lit(sum(1 << (width * lane) for lane in range(per_long)))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"c{k}") for k in range(width)])
    features = F.concat(F.transform(words, lambda w: F.xxhash64(w)),
                        F.transform(words, lambda w, i: F.xxhash64(w, F.coalesce(F.get(words, i + 1), F.lit("")))))
    sums = F.aggregate(features, zero, lambda acc, h: F.struct(*[
        (acc[f"c{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(lanes)).alias(f"c{k}") for k in range(width)]))
    half = F.size(words)  # two features a word: a bit is set by more than half of them

    def bits(sums: Column) -> Column:
        total = F.lit(0).cast("bigint")
        for k in range(width):
            for lane in range(per_long):
                counter = F.shiftrightunsigned(sums[f"c{k}"], width * lane).bitwiseAND(F.lit((1 << width) - 1))
                total = total.bitwiseOR(F.when(counter > half, F.shiftleft(F.lit(1).cast("bigint"), k + width * lane)).otherwise(F.lit(0).cast("bigint")))
        return total
    return F.transform(F.array(sums), bits)[0]  # the sums are taken once


def _fingerprint(words: Column) -> Column:
    """SimHash of the words and word pairs: bit by bit, whether more of their hashes have it set than not.

    Counters of 16 bits hold windows of up to 32,767 words, those of 32 bits all others.
    """
    return F.when(F.size(words) <= 32_767, _counted(words, 4)).otherwise(_counted(words, 2))


def _blocks(print_: Column, flips: bool) -> Column:
    """(block, bits) keys of a fingerprint as numbers; on one side also each with one bit flipped."""
    out = []
    for b in range(8):
        value = F.shiftrightunsigned(print_, 8 * b).bitwiseAND(F.lit(255)).cast("int")
        out += [F.lit(b * 256) + value]
        out += [F.lit(b * 256) + value.bitwiseXOR(F.lit(1 << k)) for k in range(8)] if flips else []
    return F.array(*out)


def similarity(a: Column, b: Column) -> Column:
    """Weighted similarity of two shingle lists: each distinct shingle weighs as often as it occurs."""
    count = lambda all_, x: F.size(F.filter(all_, lambda y: y == x))
    low = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return low / (F.size(a) + F.size(b) - low)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, row, item_id, start (word), n_words and similarity: the best window of every document and item that match."""
    return _matched(docs, benchmark, threshold).drop("text_key")


def _matched(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """The matches with a hash of the text that they are in."""
    items = stored(benchmark.select(F.col("item_id").cast("bigint"), words_of(F.col("text").cast("string")).alias("item_words")).filter(F.size("item_words") > 0)
                   .withColumn("item", F.monotonically_increasing_id()).withColumn("item_shingles", _shingles(F.col("item_words"))), "items")
    text = F.col("text").cast("string")
    read = docs.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key")).alias("doc"), words_of(text).alias("words"))
    seeds = items.select(F.size("item_words").alias("size"), F.posexplode("item_shingles").alias("item_at", "shingle")).distinct()
    # Where a shingle of the benchmark stands; items shorter than a shingle stand where a run of their length does.
    short = sorted(r[0] for r in items.filter(F.size("item_words") < SHINGLE).select(F.size("item_words")).distinct().collect())
    standing = read.select("doc", F.size("words").alias("n"), *_placed(F.col("words"), short))
    places = standing.join(bounded(seeds, BROADCAST_SHINGLES), "shingle")
    around = F.when(F.col("size") < SHINGLE, F.lit(0)).otherwise(F.lit(SHIFT))  # a short item has its words or does not match
    shifted = places.withColumn("shift", F.explode(F.sequence(-around, around)))
    # No word travels up to here; the windows are cut where the text is read again.
    start = F.greatest(F.least(F.col("at") - F.col("item_at") + F.col("shift"), F.col("n") - F.col("size")), F.lit(0))
    laid = shifted.select("doc.doc_id", "doc.text_key", start.alias("start"), "size").distinct()
    by_text = stored(laid.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "size")).alias("laid")), "laid")
    t, texts = bounded(by_text, BROADCAST_TEXTS).alias("t"), docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.text_key") == F.col("t.text_key"))
    met = texts.join(t, same).withColumn("row", F.monotonically_increasing_id())
    cut = met.select("row", F.struct("d.doc_id", "d.text_key").alias("doc"), words_of(F.col("text")).alias("words"), F.explode("laid").alias("w"))
    windows = cut.select("row", "doc", "w.start", "w.size", F.slice("words", F.col("w.start") + 1, F.col("w.size")).alias("window"))
    printed = stored(windows.withColumn("print", _fingerprint(F.col("window"))).withColumn("shingles", _shingles(F.col("window"))).drop("window"), "windows")
    indexed = items.select("item", "item_id", "item_shingles", F.size("item_words").alias("size"), _fingerprint(F.col("item_words")).alias("item_print")).withColumn(
        "block", F.explode(F.array_distinct(_blocks(F.col("item_print"), True))))
    probes = printed.withColumn("block", F.explode(_blocks(F.col("print"), False)))
    near = F.bit_count(F.col("p.print").bitwiseXOR(F.col("i.item_print"))) <= RADIUS
    met = probes.alias("p").join(bounded(indexed, BROADCAST_SHINGLES).alias("i"),
                                 (F.col("p.block") == F.col("i.block")) & (F.col("p.size") == F.col("i.size")) & near)
    judged = met.select("row", "doc", "start", F.col("p.size").alias("n_words"), "item", "item_id",
                        similarity(F.col("shingles"), F.col("item_shingles")).alias("similarity")).filter(F.col("similarity") >= threshold)
    best = judged.groupBy("row", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "doc", "item_id", "n_words")).alias("m"))
    return best.select("m.doc.doc_id", "m.doc.text_key", "row", "m.item_id", (-F.col("m.s")).alias("start"), "m.n_words", "m.similarity")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; the text decides, so rows that share an id, null included, are judged each on their own."""
    found = stored(_matched(docs, benchmark, 0.8).select("doc_id", "text_key").distinct(), "contaminated").alias("f")
    d = docs.alias("d")
    return d.join(found, F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("f.doc_id"))
                  & (F.xxhash64(F.col("d.text").cast("string")) == F.col("f.text_key")), "left_anti")
