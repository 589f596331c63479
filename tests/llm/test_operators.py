"""Each operator against a brute-force version on a small corpus with nulls, empty and long texts, ties and repeated
rows, empty tables and columns whose names clash."""

import base64
import hashlib
import math
import random
import zlib

import pyspark.sql.functions as F
import pytest

from tracequarry.llm import byte_bpe, decontaminate, line_dedup, lm_score, media_ts, near_dedup, quality, substring_dedup, toxicity, url_filter

from . import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, bucket int, word string, n int, sig string"
SHARED = "This line is shared by many documents, word for word."


def corpus():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "naïve", "The"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = say(40)
    out = {1: None, 2: "", 3: " \t\n", 4: "one", 5: say(19), 6: say(20), 7: passage, 8: f"{say(30)} {passage} {say(30)}", 9: f"{passage} {passage}"}
    for i in range(10, 18):
        out[i] = f"{say(25)}\n  {SHARED.upper() if i % 2 else SHARED}\t\n{say(5)}"
    base = say(200).split()
    for i in range(20, 60):  # near copies, some too far from each other
        w = list(base)
        for _ in range(i % 7):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out[i] = " ".join(w)
    out[60] = out[20]
    out[61] = say(3000)
    out[62] = " ".join(reversed(out[61].split()[:100])) + " " + " ".join(out[61].split()[500:600])
    out[63] = "naïve " * 300
    return sorted(out.items())


def frame(spark, docs, repeat=False):
    rows = [(d, t, "en", "s", len(t or ""), "x", 1, 2, "y", 3, "z") for d, t in docs]
    rows += rows[5:8] if repeat else []
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def rows(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.selectExpr("doc_id", *columns).collect()}


DIGEST = "sha2(kept_text, 256)"


def test_substring_dedup(spark, docs, empty):
    out = substring_dedup.removed_passages(docs)
    assert rows(out, "n_words", "n_removed", DIGEST) == brute.substring_dedup(corpus())
    assert substring_dedup.removed_passages(empty).count() == 0
    full = substring_dedup.removed_passages(docs, filter_bits=64)  # a filter that lets all through changes nothing
    assert rows(full, "n_removed") == {d: (v[1],) for d, v in brute.substring_dedup(corpus()).items()}
    twice = substring_dedup.removed_passages(frame(spark, corpus(), repeat=True))
    assert twice.count() == len(corpus()) + 3 and rows(twice, "n_removed") == rows(out, "n_removed")
    nulls = spark.createDataFrame([(None, " ".join(map(str, range(30)))), (5, " ".join(map(str, range(30))))], "doc_id long, text string")
    assert rows(substring_dedup.removed_passages(nulls), "n_removed") == {None: (0,), 5: (30,)}


def test_line_dedup(spark, docs, empty):
    want = brute.line_dedup(corpus())
    assert rows(line_dedup.shared_lines_removed(docs), "n_lines", "n_dropped", DIGEST) == want
    full = line_dedup.shared_lines_removed(docs, max_bits=1 << 10)  # filters that let all through change nothing
    assert rows(full, "n_lines", "n_dropped", DIGEST) == want
    assert line_dedup.shared_lines_removed(empty).count() == 0
    assert line_dedup.shared_lines_removed(docs, carry=True).select("row.*").columns == docs.columns
    nulls = spark.createDataFrame([(i if i else None, SHARED) for i in range(6)], "doc_id long, text string")
    assert rows(line_dedup.shared_lines_removed(nulls), "n_dropped") == {None: (1,), 1: (1,), 2: (1,), 3: (1,), 4: (1,), 5: (0,)}


def test_near_dedup(spark, docs, empty):
    assert rows(near_dedup.near_duplicates(docs), "n_shingles", "component_id", "kept") == brute.near_dedup(corpus())
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_large_group(spark):
    """More near copies than a short list holds, most of them too far from the centre or from each other."""
    r = random.Random(5)
    base = [f"v{r.randrange(10**5)}" for _ in range(120)]
    made = []
    for i in range(90):
        w = list(base)
        for _ in range(i % 9):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        made.append((i, " ".join(w)))
    made += [(100 + i, made[80 + i % 9][1] + " tail") for i in range(18)]  # linked with far copies alone
    assert rows(near_dedup.near_duplicates(frame(spark, made)), "n_shingles", "component_id", "kept") == brute.near_dedup(made)


def test_lm_score(spark, docs, empty):
    out = rows(lm_score.scored(docs, head_words=20, fit_tokens=3000), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = brute.base_scores(corpus())
    assert {d: v[:4] for d, v in out.items()} == {d: v[:4] for d, v in want.items()}
    assert all(math.isclose(out[d][4], want[d][4], rel_tol=1e-9) for d in want)
    assert sum(v[5] for v in out.values()) > sum(v[4] for v in out.values())
    assert lm_score.scored(empty).count() == 0


def test_media(spark, docs, empty):
    out = rows(media_ts.parsed(media_ts.stored(docs)), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "continuity_errors")
    for d, t in corpus():
        raw = brute.raw(t)
        pad = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert out[d] == (len(raw), len(pad), brute.sha(pad), zlib.crc32(pad[-64:]), 0)
    assert media_ts.parsed(media_ts.stored(empty)).count() == 0


@pytest.mark.parametrize("n", [64, 128, 170, 176, 184, 8128, 8192, 8256, 100_032])
def test_media_round_trip(n):
    payload = random.Random(n).randbytes(n)
    stream = media_ts.write_stream(payload)
    r = media_ts.read_stream(stream)
    assert r.payload == payload and len(stream) % 188 == 0 and not (r.continuity_errors or r.table_errors or r.sync_errors or r.broken_packets)
    blocks = -(-n // media_ts.BLOCK)
    assert r.timestamps == [k * media_ts.STEP for k in range(blocks)] and r.random_access == r.timestamps[:: media_ts.RANDOM_ACCESS] == r.clocks


def test_media_damage():
    stream = bytearray(media_ts.write_stream(bytes(20_000)))
    lost = media_ts.read_stream(bytes(stream[: 188 * 10] + stream[188 * 11 :]))
    assert lost.continuity_errors == 1 and lost.broken_packets == 1
    stream[188 * 5] = 0
    assert media_ts.read_stream(bytes(stream)).sync_errors == 1
    stream[10] ^= 1
    assert media_ts.read_stream(bytes(stream)).table_errors == 1
    assert media_ts.read_stream(b"").packets == 0


def test_decontaminate(spark, docs, empty):
    text = dict(corpus())
    words = text[61].split()
    changed = words[100:130]
    changed[5], changed[6], changed[20] = "other", "other", "other"
    items = [(1, " ".join(changed)), (2, " ".join(words[700:705])), (3, "not in there at all"), (4, None), (5, ""), (6, text[6])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(docs, bench)
    got = {tuple(r) for r in found.select("doc_id", "position", "item_id", "item_position", "n_words", "n_equal").collect()}
    assert got == brute.overlaps(corpus(), items)
    out = rows(decontaminate.contaminated(docs, bench), "contaminated", "item_ids")
    assert out[61] == (True, [1, 2]) and out[6] == (True, [6]) and out[1] == (False, []) and len(out) == len(corpus())
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contaminated(docs, bench.where("item_id > 9")).collect())


def labelled(spark, n=240):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("aeiourstlnm") for _ in range(r.randint(2, 7))) for _ in range(120)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(60)]
        toxic, good = i % 4 == 0, i % 3 > 0
        if toxic:
            for bad in r.sample(["zapgrok", "blixvod", "zap-grok", "b.lixvod"] if i % 8 else ["zapgrok", "blixvod"], 2):
                w[r.randrange(60)] = bad
        if not good:
            w = [x + r.choice(["!!", "$$$", "###"]) for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    docs += [(900, None), (901, ""), (902, "zapgrok zxapgrok blixvod")]
    return docs, frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, empty):
    docs, df, labels = labelled(spark)
    out = rows(toxicity.scored(df, labels), "held_out", "score", "predicted")
    assert len(out) == len(docs) and all(0 <= s <= 1 for _, s, _ in out.values())
    held = [d for d in range(240) if out[d][0]]
    assert held and all(out[d][0] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in out)
    assert sum(out[d][2] == (d % 4 == 0) for d in held) >= 0.9 * len(held)
    assert out[902][2] == 1 and out[900][1] == out[901][1] < 0.7
    assert toxicity.scored(empty, labels).count() == 0
    assert all(v[2] == 0 for v in rows(toxicity.scored(df, labels.where("toxic = 0")), "held_out", "score", "predicted").values())


def test_quality(spark, empty):
    docs, df, labels = labelled(spark)
    out = rows(quality.scored(df, labels), "held_out", "score", "predicted")
    assert len(out) == len(docs) and all(0 <= s <= 1 for _, s, _ in out.values())
    held = [d for d in range(240) if out[d][0]]
    assert held and sum(out[d][2] == int(d % 3 > 0) for d in held) >= 0.95 * len(held)
    assert out[900][1] == out[901][1]
    assert quality.scored(empty, labels).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return byte_bpe.read_ranks(path), public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, docs, empty, tokenizer):
    ranks, pattern, ours = tokenizer
    out = rows(byte_bpe.encoded(docs, ranks, pattern), "n_tokens", "ids", "ids_sha256", "decoded_sha256", "round_trip")
    for d, t in corpus():
        ids = ours.encode_ordinary(t or "")
        assert out[d] == (len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), brute.sha(brute.raw(t)), True)
    assert byte_bpe.encoded(empty, ranks, pattern).count() == 0


def test_byte_bpe_long_pieces(tokenizer):
    ranks, pattern, ours = tokenizer
    b = byte_bpe.Bpe(ranks, pattern)
    r = random.Random(1)
    cases = ["a" * 5000, "ab" * 3000, "".join(r.choice("abcdefé") for _ in range(4000)), "!?" * 900, " " * 700, "x" * 25, "ñandúçà" * 40]
    for c in cases + ["".join(r.choice("thenriago") for _ in range(n)) for n in range(20, 120, 7)]:
        assert b.encode(c) == ours.encode_ordinary(c) and b.decode(b.encode(c)) == c.encode()
    one = b.tree(b"international", False)
    for cut in range(1, 13):  # joining is associative: any halves give the same tokens
        assert b.join(b.tree(b"international"[:cut], False), b.tree(b"international"[cut:], False)) == one


def test_url_filter(spark, empty):
    urls = ["https://a.example.com/en/71?x", "HTTP://COM/en/", "https://x.COM/en", "net/de/", None, "", "https://example.net/de/8#a", "https://org/es/x/y", "https://b.org?/es/", "ftp://u.example.com/en/6", "https://xcom/en/1", "https://example.com/en/7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    from tracequarry.llm.queries import RULES

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, url_filter.rule_table(spark, RULES)).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        end = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
        host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert got[i] == (host, path, best[1], best[2]), u
    assert url_filter.judged(pages.where("page_id < 0"), url_filter.rule_table(spark, RULES)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"))
    listed = universe.where("cast(substring(host, 2, 9) as int) % 10 = 0")
    bits = url_filter.BITS_PER_KEY
    url_filter.BITS_PER_KEY = 4  # small filters, so that several levels are needed
    try:
        c = url_filter.cascade(listed, universe)
    finally:
        url_filter.BITS_PER_KEY = bits
    assert len(c.levels) > 2
    assert universe.where(c.holds(F.col("host"), F.col("path"))).count() == 300
    assert universe.where(c.holds(F.col("host"), F.col("path"))).exceptAll(listed).count() == 0
