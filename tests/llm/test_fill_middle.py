"""Fill-in-the-middle against a plain restatement: units by a regular expression, cuts by counting."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tracequarry.llm import fill_middle
from tracequarry.llm.queries import op12_fill_in_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc, text, percent=50, spm=80, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def made(rng):
    words = ["a", "bb", "é", "中文", "😀x", "<", "<P", "S>", "long" * 20]
    blanks = [" ", "  ", "\n", "\t \r", "\x0b\x0c", " ", ""]
    return "".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.choice((0, 1, 2, 30, 900)))) * rng.choice((1, 1, 3))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\té中<PSM>", max_size=300), st.integers(1, 6))
def test_units(text, copies):
    text = text * copies
    units = UNIT.findall(text)
    found = fill_middle.Units(text.encode(), fill_middle.Memo())
    assert found.n == len(units)
    for k in range(len(units) + 1):
        part = "".join(units[:k])
        assert found.end(k) == (len(part.encode()), len(part))


def test_chunks_follow_content():
    rng = random.Random(3)
    shared = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))
    parts = []
    for lead in (b"", b"something else before it " * 40):
        raw = lead + shared
        ends = fill_middle.chunk_ends(fill_middle.np.frombuffer(raw, "u1"))
        assert ends[-1] == len(raw) and all(fill_middle.LEAST <= b - a <= fill_middle.MOST for a, b in zip([0, *ends][:-2], ends[:-1], strict=False))
        parts.append({raw[a:b] for a, b in zip([0, *ends], ends, strict=False)})
    assert len(parts[0] & parts[1]) > 0.9 * len(parts[0])


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(fill_middle, "REMEMBERED_BYTES", 2000)
    memo = fill_middle.Memo()
    for i in range(200):
        memo.of(b"%d words and more words" % i)
        assert memo.held <= 2100


def test_rows(spark):
    rng = random.Random(8)
    docs = [(i, made(rng)) for i in range(150)] + [(None, "a b c d"), (None, None), (5, "same text here"), (5, "same text here"), (6, ""), (-7, " \n"), (8, "has <M> in it"), (9, "x" * 300_000), (10, " " * 70_000), (11, "w é " * 60_000)]
    df = spark.createDataFrame([(d, t, "f", 3) for d, t in docs], "doc_id long, text string, form string, n int").repartition(3)
    for percent in (50, 100):
        out = fill_middle.fill_in_middle(df, percent=percent)
        back = fill_middle.restored(out.output, out.form).alias("back")
        got = sorted((r[:6], r.back) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back).collect() if r.doc_id is not None)
        want = sorted(((d, *plain(d, t, percent)), t or "") for d, t in docs if d is not None)
        assert got == want
        none = out.where("doc_id IS NULL").collect()
        assert sorted(r.output for r in none) == sorted(plain(None, t, percent)[4] for t in ("a b c d", None))
    assert fill_middle.fill_in_middle(df.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        *head, out = plain(r.doc_id, r.text)
        want[r.doc_id] = (*head, sha(out), sha(r.text or ""))
    assert {r[0]: tuple(r[1:]) for r in op12_fill_in_middle(spark, sf).collect()} == want
