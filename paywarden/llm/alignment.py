"""Tokens of two tokenizers side by side: groups cut where both end, and how often two ids overlap.

Both token lists of a text spell the same bytes. Where a token of each list ends at the same byte, a group ends. Groups are found by
skipping runs along the diagonal: at the present shift between the two lists, stretches of doubling length are compared as a
whole, and the end of a one-to-one stretch is then found by halving. Past it stands an irregular group, which is resolved token by token
up to the next common end; the shift is then the difference of the two places.

Two tokens are linked if their bytes overlap. How often an id pair is linked is counted over all texts. Counts
come back to the texts in two parts: pairs that make up a hundred-thousandth of all links or more (at most 100,000 can exist) are
broadcast, all others are joined by a shuffle in which no key is frequent. The highest count of an id of the second list is broadcast too;
there are no more of them than that vocabulary has entries.

Cases: a null or empty text, or one whose bytes either tokenizer does not give back, has no tokens: zeros and an empty
list of groups. Strings of special tokens inside a text are plain text. Rows that repeat an id are rows of their own and count each, null
ids stay null. Empty in, empty out; extra columns are not looked at. A long text is encoded whole, by itself.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.llm.shared import stored, travels

travels(__name__)

#: Texts are encoded together up to so many characters.
TOGETHER = 200_000
#: Pairs with one in so many links are broadcast; no more than this number can have that share.
FREQUENT = 100_000
#: Longer words are left to the library of the file.
LONG_WORD = 500
#: So many tokens of a stretch are compared one by one.
NEAR = 16
#: Output leaves in batches of about so many tokens.
TOKENS = 500_000

ALIGNED = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
           "pairs array<struct<a: int, b: int, n: bigint>>")


def byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


#: How byte-level vocabularies split text; fixed by that format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _settled() -> np.ndarray:
    """Which of the first 65,536 characters are of the same class since Unicode 3.2, so that all libraries split them alike."""
    old, now = unicodedata.ucd_3_2_0.category, unicodedata.category
    return np.array([old(c) == now(c) != "Cn" for c in map(chr, range(1 << 16))])


class Pair:
    """Both tokenizers, built in a worker from the bytes of their files.

    Where ids follow the order of merges and the split is the usual one, merging by id gives the same tokens. A faster
    library does that for texts of settled characters without very long words; all others are encoded by the library of the file.
    """

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        said = json.loads(a)
        letters, extra = byte_letters(), {x["id"] for x in said.get("added_tokens", [])}
        vocab = said["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if i not in extra:
                self.bytes_a[i] = bytes(letters[c] for c in token)
        merged = [vocab["".join(x) if isinstance(x, list) else x.replace(" ", "")] for x in said["model"]["merges"]]
        usual = not said.get("normalizer") and SPLITTER.items() <= (said.get("pre_tokenizer") or {}).items() and not said["model"].get("ignore_merges")
        self.fast = None
        if usual and all(x < y for x, y in zip(merged, merged[1:])) and len(merged) + 256 == len(set(vocab.values()) - extra):
            ranks = {self.bytes_a[i]: i for i in vocab.values() if i not in extra}
            self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.settled = _settled()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_b = [bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode()
                        for i in range(self.b.get_piece_size()) for piece in [self.b.id_to_piece(i)]]
        self.spelled = [Spelled(table) for table in (self.bytes_a, self.bytes_b)]
        names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.names = {end: np.array([x + end for x in names], object) for end in ",|;"}

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.fast.encode_ordinary(t) if self._usual(t) else self.a.encode(t, add_special_tokens=False).ids for t in texts]

    def _usual(self, text: str) -> bool:
        """Settled characters only, no two spaces more than a long word apart, not many spaces side by side."""
        chars = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
        gaps = np.diff(np.flatnonzero(chars == 32), prepend=0, append=len(chars))
        return bool(gaps.max() <= LONG_WORD and (gaps == 1).sum() <= LONG_WORD and self.settled[chars].all())

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none where the bytes differ from a space and the text."""
        spaced = [" " + t for t in texts]
        both = [[np.array(ids, np.int64) for ids in side] for side in (self._ids_a(spaced), self.b.encode(texts, num_threads=1))]
        want = [s.encode() for s in spaced]
        same = [bool(t) for t in texts]
        for side, spelled in zip(both, self.spelled):
            same = [ok and fits for ok, fits in zip(same, spelled.gives(side, want))]
        none = np.empty(0, np.int64)
        return [(a, b) if ok else (none, none) for a, b, ok in zip(*both, same)]


class Spelled:
    """The bytes of a vocabulary's entries, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.length = np.array([len(x) for x in entries], np.int64)
        self.start = np.append(0, np.cumsum(self.length)[:-1])
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + size, size)]

    def gives(self, lists: list[np.ndarray], want: list[bytes]) -> list[bool]:
        """Whether each list of ids spells the bytes asked for."""
        fits = [int(self.length[ids].sum()) == len(w) for ids, w in zip(lists, want)]
        ids = [x for x, ok in zip(lists, fits) if ok]
        if not ids:
            return fits
        got, target = self.joined(np.concatenate(ids)), np.frombuffer(b"".join(w for w, ok in zip(want, fits) if ok), np.uint8)
        if np.array_equal(got, target):
            return fits
        return [ok and np.array_equal(self.joined(x), np.frombuffer(w, np.uint8)) for x, w, ok in zip(lists, want, fits)]


def stretches(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """How many tokens of each list stand up to the end of each stretch, and its number of groups: all one to one, or a single irregular one.

    ``a`` and ``b`` are the byte ends of tokens.
    """
    out_a: list[int] = []
    out_b: list[int] = []
    groups: list[int] = []
    i = j = 0
    n, m = len(a), len(b)
    while i < n:
        x, y = a[i], b[j]
        if x == y:  # one to one at this shift: after a few tokens, double the stretch while it is equal, then halve
            run, near = 1, min(NEAR, n - i, m - j)
            while run < near and a[i + run] == b[j + run]:
                run += 1
            step = run
            while run >= NEAR and (size := min(step, n - i - run, m - j - run)) > 0:
                p, q = i + run, j + run
                if a[p:p + size] == b[q:q + size]:
                    run += size
                    step *= 2
                    continue
                same, differs = 0, size
                while differs - same > 1:
                    middle = (same + differs) // 2
                    if a[p + same:p + middle] == b[q + same:q + middle]:
                        same = middle
                    else:
                        differs = middle
                run += same
                break
            i += run
            j += run
            out_a.append(i)
            out_b.append(j)
            groups.append(run)
            if i == n:
                break
            x, y = a[i], b[j]
        while x != y:  # an irregular group, up to the next common end
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        j += 1
        out_a.append(i)
        out_b.append(j)
        groups.append(1)
    return out_a, out_b, groups


def upto(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each list stand up to the end of each group, from their byte ends."""
    *lasts, groups = (np.array(x, np.int64) for x in stretches(a, b))
    place = np.cumsum(groups)
    one = np.arange(1, place[-1] + 1 if len(place) else 1)
    return tuple(np.repeat(last - place, groups) + one for last in lasts)


def group_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """``upto`` as lists."""
    ends_a, ends_b = upto(a, b)
    return ends_a.tolist(), ends_b.tolist()


def written(a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray, names: dict[str, np.ndarray]) -> str:
    """The groups as ``a1,a2|b1;a3|b2,b3``."""
    out = np.empty(len(a) + len(b), object)
    last_a, last_b = upto_a - 1, upto_b - 1
    words_a, words_b = names[","][a], names[","][b]
    words_a[last_a], words_b[last_b] = names["|"][a[last_a]], names[";"][b[last_b]]
    # A token stands behind those of its own list and the other list's: of earlier groups for a, of its group too for b.
    out[np.arange(len(a)) + np.repeat(np.append(0, upto_b[:-1]), np.diff(upto_a, prepend=0))] = words_a
    out[np.arange(len(b)) + np.repeat(upto_a, np.diff(upto_b, prepend=0))] = words_b
    return "".join(out.tolist())[:-1]


def linked(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked id pairs as one number each, and how often.

    Between two neighbouring ends of either list lies just one token of each, and two tokens overlap in one such stretch.
    """
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])]
    pairs = a[np.searchsorted(ends_a, ends)] << 32 | b[np.searchsorted(ends_b, ends)]
    return np.unique(pairs, return_counts=True)


def _aligner(shared):
    def run(batches):
        mine = sys.modules.setdefault("_paywarden_alignment", {})  # a worker serves many tasks
        files = shared.value
        name = hash(files)
        if name not in mine:
            mine[name] = Pair(*files)
        pair = mine[name]
        rows, size = [], 0

        def one(doc_id, ids):
            a, b = ids
            if not len(a):
                return doc_id, 0, 0, 0, 0, "", a, a
            ends_a, ends_b = (np.cumsum(x.length[i]) for x, i in zip(pair.spelled, ids))
            upto_a, upto_b = upto(ends_a.tolist(), ends_b.tolist())
            pairs, n = linked(a, b, ends_a, ends_b)
            return doc_id, len(a), len(b), len(upto_a), int(n.sum()), written(a, b, upto_a, upto_b, pair.names), pairs, n

        def emit():
            ids, *numbers, texts, pairs, n = zip(*rows)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in pairs])]).astype(np.int32)
            pairs, n = np.concatenate(pairs), np.concatenate(n).astype(np.int64)
            entry = pa.StructArray.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in numbers), pa.array(texts, pa.string()),
                 pa.ListArray.from_arrays(pa.array(offsets), entry)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

        for batch in batches:
            ids, texts = batch.columns
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            first = 0
            while first < batch.num_rows:
                last, total = first + 1, lengths[first]
                while last < batch.num_rows and total + lengths[last] <= TOGETHER:
                    total += lengths[last]
                    last += 1
                part = [t or "" for t in texts.slice(first, last - first).to_pylist()]
                for doc_id, found in zip(ids.slice(first, last - first).to_pylist(), pair.encode(part)):
                    rows.append(one(doc_id, found))
                    size += rows[-1][1] + 50
                    if size >= TOKENS:
                        yield emit()
                        rows, size = [], 0
                first = last
        if rows:
            yield emit()
    return run


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups and the linked id pairs with their numbers, for every row.

    The files are a byte-level BPE vocabulary and a piece model; they are read once and broadcast, a few megabytes whatever the input.
    """
    files = []
    for path in (path_a, path_b):
        with open(path, "rb") as f:
            files.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(files))
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_aligner(shared), ALIGNED)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count over all rows, and whether it is the highest of its b."""
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # one row for each entry of a vocabulary
    return counts.join(F.broadcast(highest), "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def _sums(rows: DataFrame) -> list[Column]:
    return [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]


def with_counts(found: DataFrame) -> DataFrame:
    """``found`` (of ``aligned``) without its pairs, with n_best and count_sum: links whose count is the highest of their b, and the counts of all links."""
    found = stored(found.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    pairs = found.select("_row", F.inline("pairs"))
    counts = stored(pair_counts(pairs), "pair-best")
    links = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first().n
    often = F.col("count") * FREQUENT >= links
    met = pairs.join(F.broadcast(counts.filter(often)), ["a", "b"], "left")
    near = met.filter(F.col("count").isNotNull()).groupBy("_row").agg(*_sums(met))
    rest = met.filter(F.col("count").isNull()).select("_row", "a", "b", "n").join(counts.filter(~often).hint("merge"), ["a", "b"])
    far = rest.groupBy("_row").agg(*_sums(rest))
    by_row = near.unionByName(far).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    return found.drop("pairs").join(by_row, "_row", "left").select(*[c for c in found.columns if c not in ("pairs", "_row")], *zero)
