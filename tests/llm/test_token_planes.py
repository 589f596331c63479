"""Files of token planes: ids against the library, starts, damaged and empty files, odd rows."""

import glob
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracequarry.llm import token_planes
from tracequarry.llm.queries import TOKENIZER, op11_token_planes

PATH = public_tokenizers.path(TOKENIZER)
ODD = [
    "", " ", "  ", "\n", "a  b", " a b ", "it's Bob's ISN'T we'll", "x \n y", "tab\tand fixed wide", "a᠎b c", "Éé çà ñ ß ø", "中文 字符", "emoji 😀😀 x", "<|endoftext|> <|endoftext|>", "12 34 ½ ²", "a...b --- ''' 's",
    "\x1c \x1d x", "word " * 3000, "a" * 5000, "​ zero ​", "x\r\ny \r z", "don't’s ' s", "é" * 300 + " " + "Ж" * 100, "end ",
]


LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("planes", ["bit", "byte"])
@pytest.mark.parametrize("dtype", [np.uint32, np.uint64])
def test_planes(planes, dtype):
    rng = np.random.default_rng(5)
    for n, most in ((0, 1), (1, 1), (7, 50257), (65536, 50257), (100, 2**31), (9, 2**63 if dtype is np.uint64 else 2**32)):
        x = rng.integers(0, most, n, dtype=np.uint64).astype(dtype)
        assert (token_planes.from_planes(token_planes.to_planes(x, planes), n, dtype, planes) == x).all()


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_files(spark, planes):
    docs = [(i * 7 % 50, t) for i, t in enumerate(ODD)] + [(None, "null id"), (None, None), (3, "same"), (3, "same"), (3, "other")]
    docs += [(100 + i, "the cat sat on mat number %d" % i) for i in range(300)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, start int, ids string").repartition(5)
    path = tempfile.mkdtemp(prefix="spark-") + "/tokens"
    token_planes.written(df, PATH, path, planes=planes)
    rows = sorted(token_planes.documents(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    key = lambda d: (d is not None, d or 0)
    assert [key(r.doc_id) for r in rows] == sorted(key(d) for d, _ in docs)
    assert sorted((key(r.doc_id), tuple(r.ids)) for r in rows) == sorted((key(d), tuple(ids_of(t))) for d, t in docs)
    index = token_planes.chunk_index(spark, path).collect()
    assert sum(r.n_ids for r in index) == at


def test_blocks_over_documents(spark, monkeypatch):
    monkeypatch.setattr(token_planes, "BLOCK", 64)
    out = token_planes._File(0, "bit")
    rng = np.random.default_rng(1)
    size = rng.integers(1, 200, 150)
    ids = rng.integers(0, 50257, int(size.sum())).astype(np.uint32)
    records = []
    for lo in range(0, 150, 20):
        part = size[lo : lo + 20]
        records += out.add(np.arange(lo, lo + len(part)), part, ids[size[:lo].sum() : size[: lo + 20].sum()])
    records += out.end()
    path = tempfile.mkdtemp(prefix="spark-")
    with open(f"{path}/part-0", "wb") as f:
        f.write(b"".join(r + b"\n" for r in records))
    rows = token_planes.documents(spark, path, with_ids=True).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == size.tolist() and [i for r in rows for i in r.ids] == ids.tolist()
    with open(f"{path}/part-0", "ab") as f:
        f.write(b"more")
    with pytest.raises(Exception, match="whole file"):
        token_planes.documents(spark, path).collect()


def test_empty_and_query(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_planes.stored(none, PATH)[0].collect() == []
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op11_token_planes(spark, sf).collect()}
    at, want = 0, {}
    for r in docs:
        ids = ids_of(r.text)
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want


def test_other_tokenizers(spark):
    """A tokenizer that lower-cases and drops white space is applied to whole texts."""
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    docs = [(i, x) for i, x in enumerate(ODD[:12])]
    place = tempfile.mkdtemp(prefix="spark-") + "/tokens"
    token_planes.written(spark.createDataFrame(docs, "doc_id long, text string"), path, place, end_id=49407)
    got = {r.doc_id: r.ids for r in token_planes.documents(spark, place, with_ids=True).collect()}
    assert got == {d: t.encode(x, add_special_tokens=False).ids + [49407] for d, x in docs}
    assert glob.glob(place + "/part-*")
