"""Line dedup, media columns and url filters on null and repeated ids, repeated rows, long texts and clashing names."""

import zlib
from collections import Counter

from tracequarry.llm import line_dedup, media_ts, url_filter
from tracequarry.llm.queries import RULES

from . import brute

LINE = "This line is shared by many documents, word for word."


def test_lines(spark):
    docs = [(None, LINE), (None, f"{LINE}\nown"), (3, LINE), (3, LINE), (3, f"x\n{LINE}"), (4, f"{LINE}\n{LINE}"), (4, None), (None, None), (5, "word " * 50_000 + "\n" + LINE.upper()), (5, ""), (5, LINE)]
    df = spark.createDataFrame([(d, t, 1, "k", b"m") for d, t in docs], "doc_id long, text string, n_lines int, kept_text string, marks binary").repartition(3)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.shared_lines_removed(df).collect())
    want = Counter()
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip().lower() != LINE.lower() or d == 5]
        want[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert got == want
    whole = line_dedup.shared_lines_removed(df, carry=True)
    assert whole.select("row.*").exceptAll(df).count() == 0 and whole.count() == len(docs)


def test_media(spark):
    docs = [(None, "a"), (None, "b"), (1, "a"), (1, "a"), (2, None), (2, ""), (3, "long " * 60_000)]
    df = spark.createDataFrame([(d, t, b"x", 1) for d, t in docs], "doc_id long, text string, media binary, n_bytes int").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in media_ts.parsed(media_ts.stored(df)).collect())
    want = Counter()
    for d, t in docs:
        raw = brute.raw(t)
        pad = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[d, len(raw), brute.sha(pad), zlib.crc32(pad[-64:])] += 1
    assert got == want


def test_urls(spark):
    urls = [(None, "http://a.com/en/x"), (None, "http://b.org/"), (1, "http://a.com/en/x"), (1, "http://a.com/en/x"), (2, None), (3, "http://" + "x." * 200 + "net/de/" + "y" * 5000)]
    pages = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in urls], "page_id long, url string, host string, path string, rule string").repartition(2)
    got = Counter((r.page_id, r.rule, r.verdict) for r in url_filter.judged(pages, url_filter.rule_table(spark, RULES)).collect())
    assert got == Counter({(None, "com/en/", "block"): 1, (None, None, "allow"): 1, (1, "com/en/", "block"): 2, (2, None, "allow"): 1, (3, "net/de/", "block"): 1})
