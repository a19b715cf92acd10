"""Repair of conversation structure by cheapest edits, with the list of edits as an audit.

A conversation's rows are read in the order of their turns. A row is blank, a duplicate of an earlier one, truncated, or sound. Edits keep a
row, give it another role, delete it, or insert an empty turn, so that the initials of the roles read ``(s?(ua)+)?``. Four states know how far
that pattern has come, and each has its cheapest edits so far; of equally cheap ones the audit that sorts first wins.

The audits are persistent: a node holds one edit, its predecessor, the rolling hash of all edits up to it and its ancestors at distances of powers of
two. Two audits are compared by the last ancestors that have equal hashes, sought by binary lifting, and the edits behind these.
Equal hashes are verified edit by edit, once for each pair of nodes. Two equally cheap audits over the same rows cannot be beginnings of
one another, since inserts cost, so the smaller one stays smaller whatever follows.

What all four audits begin with is decided. It leaves the memory as soon as enough nodes have gathered, so a conversation is a stream of
rows: of a very long one only the undecided part, its audit and the digest of its repaired text are held. Its rows pass
through one task, since that digest has no parts; they are sorted by Spark, which can spill.

Cases: a null role or text counts as one space; a null turn comes first and no turn of the span; null conversation ids form a conversation of
their own. Rows with equal turns follow by role and text, so repeated rows stand side by side and the later ones are duplicates. Empty texts are
blank. Empty in, empty out; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paywarden.llm.shared import travels

travels(__name__)

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Nodes between two looks at what is decided.
GATHER = 8192
NEVER = 1 << 60
_MASK = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E68B & _MASK
_SEEN = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")

#: State after a role initial: 0 nothing yet, 1 a system turn, 2 ends in a user turn, 3 ends in an assistant turn.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {2: "user", 3: "assistant"}
NEXT = (2, 2, 3, 2)  # where a user or assistant turn leads that fits

SUMMARY = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
TURNS = "conv_id bigint, place bigint, edit string, role string, text string"

#: What it costs at most to go on from one state as from another: insert the turn that leads there, delete a kept system turn.
INSTEAD = {(3, 0): DELETE, (3, 1): 0, (3, 2): INSERT, (2, 3): INSERT, (2, 0): INSERT + DELETE, (2, 1): INSERT}


class Audit:
    """The last edit of a list that shares its beginning with others."""

    __slots__ = ("edit", "depth", "hash", "up", "same")

    def __init__(self, before: Audit | None, edit: str):
        self.edit, self.same = edit, None
        if before is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * _BASE + ord(edit)) % _MASK
        up, k = [before], 0
        while k < len(up[k].up):  # the ancestor at distance 2**k has one at the same distance
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)

    def ancestor(self, depth: int) -> Audit:
        node = self
        while node.depth > depth:
            node = node.up[(node.depth - depth).bit_length() - 1]
        return node

    def first(self) -> Audit:
        """The node that stands for all that were verified to hold the same edits."""
        node = self
        while node.same is not None:
            if node.same.same is not None:
                node.same = node.same.same
            node = node.same
        return node

    def text(self, after: int = 0) -> str:
        out, node = [], self
        while node.depth > after:
            out.append(node.edit)
            node = node.up[0]
        return "".join(reversed(out))


def verified(x: Audit, y: Audit) -> bool:
    """Whether two nodes of one depth and hash hold the same edits; what was compared once is joined."""
    met = []
    while x.depth and x.first() is not y.first():
        if x.edit != y.edit:
            return False
        met.append((x, y))
        x, y = x.up[0], y.up[0]
    for p, q in met:
        p, q = p.first(), q.first()
        if p is not q:
            q.same = p
    return True


def common(x: Audit, y: Audit) -> int:
    """Length of the longest common beginning of two audits."""
    depth = min(x.depth, y.depth)
    p, q = a, b = x.ancestor(depth), y.ancestor(depth)
    if p.hash != q.hash:
        for k in range(len(p.up) - 1, -1, -1):
            if k < len(p.up) and p.up[k].hash != q.up[k].hash:
                p, q = p.up[k], q.up[k]
        p, q = p.up[0], q.up[0]
    if verified(p, q):
        return p.depth
    one, two = a.text(), b.text()  # hashes collided
    return next((i for i, (c, d) in enumerate(zip(one, two)) if c != d), depth)


def less(x: Audit, y: Audit) -> bool:
    """Whether the audit of ``x`` sorts before that of ``y``."""
    if x is y:
        return False
    n = common(x, y)
    if n == x.depth or n == y.depth:
        return x.depth < y.depth
    return x.ancestor(n + 1).edit < y.ancestor(n + 1).edit


def best(options):
    """(cost, audit) of the cheapest of (cost, audit before, edit); the audit that sorts first among equals."""
    cost = min((o[0] for o in options), default=NEVER)
    if cost >= NEVER:
        return NEVER, None
    found = None
    for c, before, edit in options:
        if c == cost:
            node = Audit(before, edit) if edit else before
            if found is None or less(node, found):
                found = node
    return cost, found


class Repair:
    """One conversation, row after row; ``take`` and ``finish`` return the edits decided since the last call."""

    def __init__(self):
        self.states = [(0, Audit(None, "")), (NEVER, None), (NEVER, None), (NEVER, None)]
        self.rows: list[tuple[str, str]] = []  # those whose edits are not decided
        self.state, self.rows_since = 0, 0
        self.n = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.low = self.high = self.turn = self.initial = None

    def _inserted(self, states):
        """With turns inserted at this place where that is cheaper or sorts first: one, or a user and an assistant turn."""
        two = best([(states[2][0], states[2][1], "")] + [(c + INSERT, a, "I") for c, a in (states[0], states[1], states[3])])
        three = best([(states[3][0], states[3][1], ""), (two[0] + INSERT, two[1], "I")])
        return [states[0], states[1], two, three]

    def take(self, turn, role: str, text: str, duplicate: bool):
        blank = _SEEN.search(text) is None
        cut = not blank and not duplicate and _LAST.search(text)[1] not in ".!?"
        duplicate = not blank and duplicate
        n = self.n
        n["blank"] += blank
        n["duplicate"] += duplicate
        n["truncated"] += cut
        if turn is not None:
            n["turns"] += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        initial = role[:1]
        n["illegal"] += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial

        at = self._inserted(self.states)
        options = [[(c + DELETE, a, "D")] for c, a in at]
        if not (blank or duplicate):
            extra = TRUNCATED if cut else 0
            for s, (c, a) in enumerate(at):
                if c < NEVER:
                    options[NEXT[s]].append((c + REROLE + extra, a, "R"))
                    kept = STEP.get((s, initial))
                    if kept is not None:
                        options[kept].append((c + extra, a, "K"))
        states = [best([o for o in all_ if o[0] < NEVER]) for all_ in options]
        for (s, instead_of), more in INSTEAD.items():  # dearer whatever follows
            if states[s][0] + more < states[instead_of][0]:
                states[instead_of] = (NEVER, None)
        self.states = states
        self.rows.append((role, text))
        self.rows_since += 1
        return self._decided() if self.rows_since * 8 >= GATHER else []

    def _walk(self, edits: str):
        """The turns that edits make, from the state and the rows at hand."""
        out, k = [], 0
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.rows[k]
            k += edit != "I"
            if edit == "K":
                self.state = STEP[self.state, role[:1]]
            elif edit in "IR":
                self.state = NEXT[self.state]
                role = ROLE[self.state]
            out.append((edit, role, text))
        del self.rows[:k]
        return out

    def _decided(self):
        live = [a for c, a in self.states if c < NEVER]
        n = min((common(live[0], a) for a in live[1:]), default=live[0].depth)
        self.rows_since = 0
        if n == 0:
            self.rows_since = -len(self.rows)  # look again when twice as much has gathered
            return []
        edits = live[0].ancestor(n).text()
        rests = [(c, a.text(n) if a is not None else None) for c, a in self.states]
        root, made, ends = Audit(None, ""), {}, []
        for _, rest in rests:
            node = root
            for edit in rest or "":
                if (node, edit) not in made:
                    made[node, edit] = Audit(node, edit)
                node = made[node, edit]
            ends.append(node if rest is not None else None)
        self.states = [(c, end) for (c, _), end in zip(rests, ends)]
        return self._walk(edits)

    def finish(self):
        """(cost, the last edits)."""
        at = self._inserted(self.states)
        cost, audit = best([(*at[0], ""), (*at[3], "")])
        return cost, self._walk(audit.text())

    def gaps(self) -> int:
        return 0 if self.low is None else int(self.high) - int(self.low) + 1 - self.n["turns"]


def _streamed(batches):
    """(conversation, what it decided, its cost or None) over rows that come sorted by conversation and turn."""
    current, repair = object(), None
    for batch in batches:
        for conv_id, turn, role, text, place in zip(*(c.to_pylist() for c in batch.columns)):
            if repair is None or conv_id != current:
                if repair is not None:
                    cost, last = repair.finish()
                    yield current, repair, last, cost
                current, repair = conv_id, Repair()
            decided = repair.take(turn, role, text, place > 1)
            if decided:
                yield current, repair, decided, None
    if repair is not None:
        cost, last = repair.finish()
        yield current, repair, last, cost


def _summaries(batches):
    rows, audit, digest, first = [], [], hashlib.sha256(), True

    def emit(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if k < 7 else pa.string()) for k, c in enumerate(zip(*rows))],
            names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])
    for conv_id, repair, decided, cost in _streamed(batches):
        audit.append("".join(edit for edit, _, _ in decided))
        for edit, role, text in decided:
            if edit != "D":
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if cost is not None:
            n = repair.n
            rows.append((conv_id, repair.gaps(), n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, "".join(audit), digest.hexdigest()))
            audit, digest, first = [], hashlib.sha256(), True
            if len(rows) >= 1000:
                yield emit(rows)
                rows = []
    if rows:
        yield emit(rows)


def _turns(batches):
    rows, size, place = [], 0, 0

    def emit(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "place", "edit", "role", "text"])
    for conv_id, _, decided, cost in _streamed(batches):
        for edit, role, text in decided:
            if edit != "D":
                rows.append((conv_id, place, edit, role, text))
                size += len(text) + 50
                place += 1
            if size >= 1 << 20:
                yield emit(rows)
                rows, size = [], 0
        place = 0 if cost is not None else place
    if rows:
        yield emit(rows)


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows by conversation and turn, each with its number among equal ones of its conversation."""
    space = F.lit(" ")
    typed = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
                        F.coalesce(F.col("text").cast("string"), space).alias("text"))
    # Equal role and text, by a digest of their own lengths and characters, so that no text is compared whole.
    same = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    equals = Window.partitionBy("conv_id", same).orderBy(F.col("turn").asc_nulls_first())
    numbered = typed.withColumn("place", F.row_number().over(equals))
    return numbered.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "place")


def summaries(rows: DataFrame) -> DataFrame:
    """Of every conversation: turns missing from its span, faults, the least cost, the audit, and the SHA-256 of the repaired ``role:text`` lines."""
    return _ordered(rows).mapInArrow(_summaries, SUMMARY)


def repaired(rows: DataFrame) -> DataFrame:
    """The turns that are left, with their place, the edit that made them, role and text."""
    return _ordered(rows).mapInArrow(_turns, TURNS)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by a rule on their conversation and turn: dropped, emptied, cut, repeated or given to the user; others as they are."""
    space = F.lit(" ")

    def said(name):
        return F.coalesce(F.col(name).cast("string"), space)
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    told = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    return told.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
