"""Pieces of any length against the tiktoken library, within a stated time, and rows without a usable id."""

import gc
import random
import time
import tracemalloc

import pyarrow as pa
import pytest

from tracequarry.llm import byte_bpe

from . import brute
from .test_operators import tokenizer  # noqa: F401

UNITS = ["a", "=", "*", "_", "0", "é", "ab", "!?", "*-", "abc", "=-_*", "thaen", "abcdef", "abcdefg"]


@pytest.mark.parametrize("n", [999, 1250, 5001, 100_000, 1_000_000])
def test_periodic_pieces(tokenizer, n):  # noqa: F811
    ranks, pattern, ours = tokenizer
    b = byte_bpe.Bpe(ranks, pattern)
    for u in UNITS:
        text = (u * n)[:n]
        began = time.process_time()
        ids = b.encode(text)
        assert time.process_time() - began < 10, u  # half a second on the machine this was written on
        assert ids == ours.encode_ordinary(text), u
        assert b.decode(ids) == text.encode(), u


def test_irregular_pieces(tokenizer):  # noqa: F811
    ranks, pattern, ours = tokenizer
    b = byte_bpe.Bpe(ranks, pattern)
    r = random.Random(6)
    for letters in ("thenriago", "ab", "=-_*~!", "éàñ", "aaab"):
        for n in (*range(1, 60), 333, 20_000):
            text = "".join(r.choice(letters) for _ in range(n))
            assert b.encode(text) == ours.encode_ordinary(text)


def test_any_halves(tokenizer):  # noqa: F811
    """Joining is associative: any cut of a piece gives the same tokens, and a heap merges as the plain way does."""
    ranks, pattern, _ = tokenizer
    b = byte_bpe.Bpe(ranks, pattern)
    r = random.Random(8)
    for raw in (b"a" * 77, b"abab" * 20, b"internationalisation", bytes(r.choice(b"aeinrst") for _ in range(150))):
        whole = b.tree(raw, False)
        assert b._merged_short(raw) == b._merged_long(raw) == list(whole)
        for cut in range(1, len(raw)):
            assert b.join(b.tree(raw[:cut], False), b.tree(raw[cut:], False)) == whole


def test_every_token_stands_for_itself(tokenizer):  # noqa: F811
    ranks, pattern, _ = tokenizer
    b = byte_bpe.Bpe(ranks, pattern)
    assert all(b.tree(t) == (t,) for t in list(ranks)[::97])


def test_rows(spark, tokenizer):  # noqa: F811
    """Null ids, repeated rows, null, empty and long texts, and columns named as the results are."""
    ranks, pattern, ours = tokenizer
    texts = [(None, "one word"), (None, "another"), (3, None), (3, ""), (4, "same"), (4, "same"), (5, "=" * 70_000 + " end"), (6, "naïve été " * 4000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, n_tokens int, ids string").repartition(3)
    got = sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded_sha256) for r in byte_bpe.encoded(df, ranks, pattern).collect()), key=repr)
    want = sorted(((d, len(x), x, brute.sha(brute.raw(t))) for d, t in texts for x in [ours.encode_ordinary(t or "")]), key=repr)
    assert got == want


def test_no_encoder_outlives_its_task(spark, tokenizer):  # noqa: F811
    """Workers that wait for other tasks hold no pieces of this one."""
    ranks, pattern, _ = tokenizer

    class Table:
        sparkSession = spark  # noqa: N815

        def select(self, *_):
            return self

        def mapInArrow(self, f, schema):  # noqa: N802
            return f

    alive = lambda: sum(isinstance(x, byte_bpe.Bpe) for x in gc.get_objects())
    gc.collect()
    before = alive()
    task = byte_bpe.encoded(Table(), ranks, pattern)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", None])], ["doc_id", "text"])
    assert [x.column(1).to_pylist() for x in task(iter([batch]))] == [[2, 0]]
    gc.collect()
    assert alive() == before


def test_results_of_few_rows_are_held(spark, tokenizer):  # noqa: F811
    """Results of a batch go on a hundred rows at a time, with ids as 4 bytes each, so that a task holds little of them."""
    ranks, pattern, ours = tokenizer

    class Table:
        sparkSession = spark  # noqa: N815

        def select(self, *_):
            return self

        def mapInArrow(self, f, schema):  # noqa: N802
            return f

    texts = [None, "", *(f"row {i} " + " internationalisation thermodynamic" * 300 for i in range(997)), "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["doc_id", "text"])
    task = byte_bpe.encoded(Table(), ranks, pattern)
    next(task(iter([batch.slice(0, 1)])))
    rows, most = [], 0
    tracemalloc.start()
    for x in task(iter([batch])):
        most = max(most, tracemalloc.get_traced_memory()[1])
        rows += zip(x.column(0).to_pylist(), x.column(1).to_pylist(), [hash(tuple(v)) for v in x.column(2).to_pylist()], strict=True)
        tracemalloc.reset_peak()
    tracemalloc.stop()
    assert rows == [(i, len(v), hash(tuple(v))) for i, v in enumerate(ours.encode_ordinary(t or "") for t in texts)]
    assert most < 40e6


def test_remembered_tokens_are_the_tables(tokenizer):  # noqa: F811
    """What a task remembers refers to the table's tokens and holds no copies of them."""
    ranks, pattern, _ = tokenizer
    b = byte_bpe.Bpe(ranks, pattern)
    r = random.Random(9)
    b.encode(" ".join("".join(r.choice("thenriago") for _ in range(r.randrange(4, 20))) for _ in range(2000)))
    table = {id(t) for t in ranks}
    assert b.windows
    assert all(id(t) in table for found in b.windows.values() for t in found)
