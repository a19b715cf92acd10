"""Secrets by three base patterns and by automata inferred from credentials that are known.

Known credentials (kind, value) become a prefix tree of character classes with counts. States whose outgoing shares
agree within a Hoeffding bound, all the way down, are merged; what remains is a small probabilistic automaton per kind. A
part of a run of token characters that no base span covers is scored by its mean log-likelihood per character under each automaton and
becomes a span of kind ``grammar`` if it is as likely as the credentials learned from.

Cases: null and empty texts have no spans. Repeated rows are scanned one by one, null ids stay null, texts of any length are
read whole. Known credentials that are null or empty are left out; without any there is no automaton and only base spans.
Extra columns are ignored; empty in, empty out. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.llm import words as W
from paywarden.llm.shared import in_hand, stored, travels

travels(__name__)

KINDS = ["assign", "access", "hex", "grammar"]
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
#: A run that may be a credential: this long at least, with a digit.
RUN, LEAST_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}"), 16
LEARNED_VALUES = 400
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
_HEX, _RUN, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_HEX[list(b"0123456789abcdef")] = _DIGIT[48:58] = True
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_CLASS = {**{c: "0" for c in "0123456789"}, **{c: "a" for c in "abcdef"}, **{c: "z" for c in "ghijklmnopqrstuvwxyz"},
          **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}}
_SIZE = {"0": 10, "a": 6, "z": 20, "A": 26}


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base patterns, each kind from left to right without overlaps."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def _runs(mark: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(mark.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def worth_reading(column: pa.Array) -> np.ndarray:
    """Rows that can hold a span at all, found on the bytes: a keyword, ``AKIA``, a long hex run or a long run with a digit.

    Runs are looked for over 256 KB at a time; one that touches the cut marks the row, so none is lost.
    """
    data, limits = W.buffers(column)
    out = np.zeros(len(column), bool)
    overlap = 64
    for at in range(int(limits[0]), int(limits[-1]), W.PIECE):
        raw = data[at:min(at + W.PIECE + overlap, int(limits[-1]))]
        digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
        for mark, least, needs_digit in ((_HEX[raw], 24, False), (_RUN[raw], LEAST_RUN, True)):
            start, end = _runs(mark, least)
            if needs_digit:
                keep = (digits[end] > digits[start]) | (end == len(raw))
                start, end = start[keep], end[keep]
            for place in (start, end - 1):
                out[np.clip(np.searchsorted(limits, at + place, "right") - 1, 0, len(out) - 1)] = True
            for a, b in zip(start, end):  # a run over several rows belongs to all of them
                lo, hi = (int(np.searchsorted(limits, at + p, "right")) - 1 for p in (a, b - 1))
                if hi > lo:
                    out[max(lo, 0):hi + 1] = True
    for i, text in enumerate(bytes(data[a:b]) for a, b in zip(limits[:-1], limits[1:])):
        if not out[i]:
            lower = text.lower()
            out[i] = b"AKIA" in text or any(k.encode() in lower for k in KEYWORDS)
    return out & column.is_valid().to_numpy(zero_copy_only=False)  # a null between two parts of a run has no text


class Automaton:
    """States as (ends, {class: (next state, count)}); classes of characters are the alphabet."""

    def __init__(self, values: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for value in values:
            at = 0
            for c in map(lambda x: _CLASS.get(x, x), value):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                self.count[at][c] += 1
                at = self.next[at][c]
            self.count[at][""] += 1
        self.alpha = alpha
        self._merge()
        scores = [self.likelihood(v) for v in values]
        self.threshold = min(scores) - 1e-9 if scores else math.inf

    def _differ(self, f1, n1, f2, n2) -> bool:
        return n1 and n2 and abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.count[a].total(), self.count[b].total()
            for c in set(self.count[a]) | set(self.count[b]):
                if self._differ(self.count[a][c], n1, self.count[b][c], n2):
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[b] if c in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge(self) -> None:
        """Red states stay; each blue child of one is merged into the first red state it agrees with, or turns red."""
        red, blue = [0], deque((0, c) for c in sorted(self.next[0]))
        while blue:
            parent, c = blue.popleft()
            state = self.next[parent][c]
            if state in red:
                continue
            for other in red:
                if self._compatible(other, state):
                    self.next[parent][c] = other
                    self._fold(other, state)
                    blue.extend((r, k) for r in red for k in sorted(self.next[r]) if self.next[r][k] not in red)
                    break
            else:
                red.append(state)
                blue.extend((state, k) for k in sorted(self.next[state]))

    def likelihood(self, value: str) -> float:
        """Mean log-probability per character, the end included; minus infinity for what the automaton can't make."""
        at, total = 0, 0.0
        for x in value:
            c = _CLASS.get(x, x)
            n = self.count[at][c]
            if not n or c not in self.next[at]:
                return -math.inf
            total += math.log(n / self.count[at].total() / _SIZE.get(c, 1))
            at = self.next[at][c]
        n = self.count[at][""]
        return (total + math.log(n / self.count[at].total())) / (len(value) + 1) if n else -math.inf

    def accepts(self, value: str) -> bool:
        return self.likelihood(value) >= self.threshold


def known(docs: DataFrame) -> DataFrame:
    """(kind, value) of every base span of every text: the labelled credentials to learn from."""
    def run(batches):
        for batch in in_hand(batches):
            kinds, values = [], []
            rows = np.flatnonzero(worth_reading(batch.column(0)))
            for text in batch.column(0).take(pa.array(rows)).to_pylist():
                for _, _, kind, value in base_spans(text):
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])
    return docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, value string")


def learn(credentials: DataFrame, values: int = LEARNED_VALUES) -> list[Automaton]:
    """One automaton per kind from at most ``values`` distinct credentials each, picked by their hash."""
    rows = stored(credentials.filter(F.length("value") > 0).select("kind", "value").distinct(), "credentials")  # read once for all kinds
    picked = rows.filter(F.lit(False))
    for kind in KINDS[:3]:
        picked = picked.union(rows.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(values))
    by_kind: dict[str, list[str]] = {}
    for row in picked.collect():
        by_kind.setdefault(row.kind, []).append(row.value)
    return [Automaton(sorted(by_kind[k])) for k in sorted(by_kind)]


def _uncovered(runs, spans):
    """The parts of ``runs`` outside ``spans``; both by start."""
    at = 0
    for a, b in runs:
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        for start, end, _ in spans[at:]:
            if start >= b:
                break
            if start > a:
                yield a, start
            a = max(a, end)
        if a < b:
            yield a, b


def spans_of(text: str, automata: list[Automaton]) -> list[tuple[int, int, str]]:
    """All spans of one text as (start, end, kind), by start and then kind as listed."""
    base = [s[:3] for s in base_spans(text)]
    found = list(base)
    if automata:
        for a, b in _uncovered([m.span() for m in RUN.finditer(text)], sorted(base)):
            if b - a >= LEAST_RUN and re.search("[0-9]", text[a:b]) and any(x.accepts(text[a:b]) for x in automata):
                found.append((a, b, "grammar"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scanned(docs: DataFrame, automata: list[Automaton]) -> DataFrame:
    """doc_id and the list of spans (kind, from, upto) of every row."""
    def run(batches):
        for batch in in_hand(batches):
            out = [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(worth_reading(batch.column(1))):
                out[i] = [{"kind": k, "from": a, "upto": b} for a, b, k in spans_of(batch.column(1)[int(i)].as_py(), automata)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("from", pa.int64()), ("upto", pa.int64())]))
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, spans array<struct<kind:string,from:bigint,upto:bigint>>")


def without_secrets(docs: DataFrame, automata: list[Automaton], mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every span replaced by ``mark``; overlapping spans are one. Lengths follow the text."""
    schema, names = docs.schema, docs.columns
    at, sizes = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(text):
        parts, done = [], 0
        for a, b, _ in spans_of(text, automata):
            if a >= done:
                parts += [text[done:a], mark]
            done = max(done, b)
        return "".join(parts) + text[done:]

    def run(batches):
        for batch in in_hand(batches):
            rows = np.flatnonzero(worth_reading(batch.column(at)))
            columns = list(batch.columns)
            if len(rows):
                texts = dict(zip(rows.tolist(), map(clean, batch.column(at).take(pa.array(rows)).to_pylist())))
                columns[at] = pa.array([texts.get(i, v) for i, v in enumerate(columns[at].to_pylist())], columns[at].type)
                if sizes is not None:
                    columns[sizes] = pa.array([len(texts[i]) if i in texts else v for i, v in enumerate(columns[sizes].to_pylist())], columns[sizes].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return docs.mapInArrow(run, schema)


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
