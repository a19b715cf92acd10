"""Byte-level BPE over a rank file, in linear time, without merging pair by pair.

Bytes stand as Latin-1 characters in the trie of an Aho-Corasick automaton of all tokens. Encoding takes the longest token at each
place; if it can't follow its predecessor, a shorter one, and if none can, it steps back. Whether two tokens may stand side by
side (their joint bytes merge to just these two) is worked out once per pair, by taking back the merges that made them, and kept.
A token sequence in which all neighbours may is the one that merging by rank gives.

Cases: null and empty texts have no tokens. Repeated rows and ids are rows of their own, null ids stay null, extra
columns are not looked at; empty in, empty out. Very long texts and words take time in proportion to their length.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cached_property
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.llm.shared import travels

travels(__name__)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """Merge the neighbours of lowest rank until none is left, or ``least`` parts are."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > least:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of the parts that merging leaves: the definition, used for short strings only."""
    return [ranks[p] for p in merged(piece, ranks)]


class _Kept(dict):
    """Makes what it does not hold."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        return self.make(key)


class Codec:
    """Encoder and decoder for one vocabulary; the kept pieces and pairs are bounded."""

    KEPT_PIECES, KEPT_PAIRS = 300_000, 1_000_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.pieces: dict[str, tuple[int, ...]] = _Kept(self._new)
        self.pairs: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern}

    def __setstate__(self, state):
        self.__init__(**state)

    @cached_property
    def split(self):
        return regex.compile(self.pattern).findall

    @cached_property
    def token(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self.ranks.items()}

    @cached_property
    def decimal(self) -> dict[int, str]:
        return {rank: str(rank) for rank in self.ranks.values()}

    @cached_property
    def automaton(self):
        """Tokens that merging itself can make; any other token only stands for a whole piece."""
        found = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if len(token) == 1 or (merge_by_rank(token, self.ranks) == [rank] if self.halves is None else self.halves[0][rank] != rank):
                found.add_word(token.decode("latin-1"), rank)
        return found

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ranks), default=0)

    def token_at(self, text: str, at: int) -> int:
        """The longest token at this place, or -1: the trie tells how far it could reach."""
        size = self.automaton.longest_prefix(text[at:at + self.longest])
        while size:
            rank = self.automaton.get(text[at:at + size], -1)
            if rank >= 0:
                return rank
            size -= 1
        return -1

    @cached_property
    def halves(self) -> tuple[dict[int, int], dict[int, int], dict[int, int]] | None:
        """Left and right token of the last merge of each token (itself if merging can't make it), and the token of two halves.

        None where a token comes from one of higher rank: merges do not go by rising rank then.
        """
        first, last, joint = {}, {}, {}
        for token, rank in self.ranks.items():
            first[rank] = last[rank] = rank
            parts = merged(token, self.ranks, 2) if len(token) > 1 else []
            if len(parts) == 2:
                left, right = (self.ranks.get(p, -1) for p in parts)
                if left < 0 or right < 0 or any(len(p) > 1 and self.ranks[p] >= rank for p in parts):
                    return None
                first[rank], last[rank], joint[left << 32 | right] = left, right, rank
        return first, last, joint

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the joint bytes of two tokens merge to just these two."""
        if len(self.pairs) >= self.KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        """Takes merges back, the latest first: no two tokens that met at the border may have merged before one of them grew."""
        if self.halves is None:
            return merge_by_rank(self.token[left] + self.token[right], self.ranks) == [left, right]
        first, last, joint = self.halves
        before = 1 << 60
        while True:
            if joint.get(left << 32 | right, before) < before:
                return False
            a, b = last[left], first[right]
            if a == left and b == right:
                return True
            if b == right or a != left and left > right:
                left, before = a, left
            else:
                right, before = b, right + 1

    def next_shorter(self, rank: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        known = self.shorter.get(rank)
        if known is None:
            token = self.token[rank]
            known = -1
            for size in range(len(token) - 1, 0, -1):
                text = token[:size].decode("latin-1")
                if self.automaton.exists(text):
                    known = self.automaton.get(text)
                    break
            self.shorter[rank] = known
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        text, token_at = piece.decode("latin-1"), self.token_at
        out: list[int] = []
        token, known, may_follow, next_shorter = self.token, self.pairs.get, self.may_follow, self.next_shorter
        dead: set[int] = set()
        at, rank, last = 0, token_at(text, 0) if piece else -1, len(piece)
        end = len(token[rank]) if rank >= 0 else 0
        while True:
            while rank >= 0:
                if end not in dead:
                    if not out:
                        break
                    fits = known(out[-1] << 32 | rank)
                    if fits is None:
                        fits = may_follow(out[-1], rank)
                    if fits:
                        break
                rank = next_shorter(rank)
                end = at + len(token[rank]) if rank >= 0 else at
            if rank >= 0:
                out.append(rank)
                if end == last:
                    return tuple(out)
                at, rank = end, token_at(text, end)
                if rank >= 0:
                    end += len(token[rank])
            else:
                if not out:
                    return tuple(merge_by_rank(piece, self.ranks))  # a vocabulary without all bytes
                dead.add(at)
                rank = out.pop()
                at -= len(token[rank])
                rank = next_shorter(rank)
                end = at + len(token[rank]) if rank >= 0 else at

    def _new(self, piece: str) -> tuple[int, ...]:
        ids = self.encode_piece(piece.encode())
        if len(piece) <= 64:
            if len(self.pieces) >= self.KEPT_PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def written(self, ids) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


TOKENS = "doc_id bigint, ids array<int>, decoded binary"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _per_row(rows, codec, schema, one):
    """Run ``one`` over each text; the codec is built once a process and rows leave in small batches."""
    def run(batches):
        import sys
        mine = sys.modules.setdefault("_paywarden_codecs", {})  # a worker serves many tasks
        own = mine.get(codec.id) or mine.setdefault(codec.id, codec.made())
        for batch in batches:
            ids, texts = batch.columns
            for k in range(0, len(texts), 64):
                part = [one(own, t or "") for t in texts.slice(k, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(k, 64), *(pa.array(c, t) for c, t in zip(zip(*part), schema))], names=rows)
    return run


def _codec(docs: DataFrame, path: str, pattern: str):
    """The vocabulary, broadcast: its size is that of the rank file and does not grow with the documents."""
    return _Shared(f"{path}|{pattern}", docs.sparkSession.sparkContext.broadcast(read_ranks(path)), pattern)


class _Shared:
    """Plain ranks travel; the codec is made from them where it is used, so that workers need no copy of this package."""

    def __init__(self, name, ranks, pattern):
        self.id, self.ranks, self.pattern = name, ranks, pattern

    def made(self) -> Codec:
        return Codec(self.ranks.value, self.pattern)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, token ids and the bytes decoded from them, for every row."""
    def one(codec, text):
        ids = codec.encode(text)
        return ids, codec.decode(ids)
    return _texts(docs).mapInArrow(
        _per_row(["doc_id", "ids", "decoded"], _codec(docs, path, pattern), [pa.list_(pa.int32()), pa.binary()], one), TOKENS)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, number of tokens, digest of the ids and digest of the bytes decoded from them, for every row."""
    def one(codec, text):
        ids = codec.encode(text)
        return (len(ids), hashlib.sha256(codec.written(ids).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())
    return _texts(docs).mapInArrow(
        _per_row(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], _codec(docs, path, pattern),
                 [pa.int64(), pa.string(), pa.string()], one), DIGESTS)
