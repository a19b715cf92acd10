"""What Python workers hold and do: few rows of a batch in hand, merges taken back instead of made again, short stretches without slices."""

import itertools
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from paywarden.llm import alignment, bpe, minhash, secret_scan
from paywarden.llm.shared import in_hand


class Docs:
    """Stands for a frame of doc_id and text: gives the function that a worker would run."""

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    columns = schema.names

    def mapInArrow(self, run, schema):
        return run


@pytest.fixture(scope="module")
def batch():
    text = "some plain words of a document " * 100
    texts = [None if k % 11 == 0 else f"{text}{k}" + " password=hunter2secret" * (k % 3 == 0) for k in range(6_000)]
    return pa.RecordBatch.from_arrays([pa.array(range(6_000)), pa.array(texts), pa.array([len(t or "") for t in texts])], names=Docs.columns)


@pytest.mark.parametrize("job", [
    lambda: secret_scan.without_secrets(Docs(), []), lambda: minhash._keyed(Docs(), 5)])
def test_a_worker_has_few_rows_of_a_batch_in_hand(batch, job):
    run, rows, first = job(), 0, batch.slice(0, 1)
    tracemalloc.start()
    for part in run([first, batch.slice(0, 0), batch]):
        assert part.nbytes < 6 << 20
        rows += part.num_rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 6_001 and most < 60e6


def test_slices_hold_every_row_once_in_order(batch):
    assert pa.Table.from_batches(list(in_hand([batch]))).equals(pa.Table.from_batches([batch]))
    long = pa.RecordBatch.from_arrays([pa.array(["x" * (9 << 20), None, "", "y"])], names=["text"])
    assert [t for part in in_hand([long]) for t in part.column(0).to_pylist()] == ["x" * (9 << 20), None, "", "y"]


def test_pairs_are_judged_by_taking_merges_back(monkeypatch):
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    pick = random.Random(4)
    words = ["".join(pick.choices(["an", "ert", "h", "ion", "é", "st", "de", "1", "ü", "la"], k=pick.randint(1, 8))) for _ in range(3_000)]
    assert codec.automaton and codec.halves
    monkeypatch.setattr(bpe, "merge_by_rank", None)  # no pair is merged again from its bytes
    codec.encode(" ".join(words))
    monkeypatch.undo()
    assert len(codec.pairs) > 1_000
    for pair, fits in codec.pairs.items():
        left, right = pair >> 32, pair & 0xFFFFFFFF
        assert fits == (bpe.merge_by_rank(codec.token[left] + codec.token[right], codec.ranks) == [left, right])


@pytest.mark.parametrize("seed", range(6))
def test_every_pair_of_a_small_vocabulary(seed):
    """Vocabularies learned from random text, and ones with ranks in any order, where merges do not rise."""
    pick = random.Random(seed)
    text, ranks = [bytes([c]) for c in pick.choices(b"ab" if seed % 2 else b"abc", k=600)], {bytes([c]): c for c in b"abc"}
    for rank in range(1_000, 1_040):
        found = {}
        for x, y in itertools.pairwise(text):
            if x + y not in ranks:
                found[x + y] = found.get(x + y, 0) + 1
        if not found:
            break
        best = max(sorted(found), key=found.get)
        ranks[best], k = rank, 0
        while k < len(text) - 1:
            if text[k] + text[k + 1] == best:
                text[k:k + 2] = [best]
            k += 1
    if seed > 3:
        ranks = dict(zip(ranks, pick.sample(range(5_000), len(ranks))))
    codec = bpe.Codec(ranks, r"[\s\S]+")
    made = [rank for token, rank in ranks.items() if bpe.merge_by_rank(token, ranks) == [rank]]
    for left, right in itertools.product(made, made):
        assert codec.may_follow(left, right) == (bpe.merge_by_rank(codec.token[left] + codec.token[right], ranks) == [left, right])
    if seed < 4:
        for _ in range(300):
            word = bytes(pick.choices(b"ab" if seed % 2 else b"abc", k=pick.randint(1, 40)))
            assert codec.encode(word.decode()) == ([ranks[word]] if word in ranks else bpe.merge_by_rank(word, ranks))


class Counted(list):
    slices = 0

    def __getitem__(self, at):
        Counted.slices += isinstance(at, slice)
        return super().__getitem__(at)


def test_short_stretches_are_compared_without_slices():
    a, b = Counted(range(1, 6_001)), Counted(x for x in range(1, 6_001) if x % 6)
    b.append(6_000) if b[-1] != 6_000 else None
    alignment.stretches(a, b)
    assert Counted.slices == 0
    pick = random.Random(8)
    for n in (1, 15, 16, 17, 18, 33, 40, 300):
        ends = np.cumsum(np.ones(3 * n, int)).tolist()
        gone = set(pick.sample(ends[:-1], min(len(ends) - 1, 2)))
        a, b = ends, [x for x in ends if x not in gone]
        cuts = [x for x in a if x in set(b)]
        assert alignment.group_ends(a, b) == ([sum(x <= c for x in a) for c in cuts], [sum(x <= c for x in b) for c in cuts])
