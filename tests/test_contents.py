"""Exact percentiles, manifests, masking, pages and the reader of loose objects on small data."""

import random
import tempfile
from pathlib import Path

import numpy as np
import pyspark.sql.functions as F
import pytest

from tracequarry.functions import loose, parsers
from tracequarry.operators import profiles, retrieval
from tracequarry.sources import trajectories


def test_percentiles(spark):
    rng = random.Random(6)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(30_000)], "ties": [float(rng.randrange(3)) for _ in range(5000)], "few": [2.0, 1.0], "one": [7.0], None: [1.0, 2.0, 4.0], "gone": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("gone", None), ("few", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"least": 0.0, "low": 0.013, "median": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.g: r for r in profiles.exact_quantiles(df, ["g"], "v", shares, accuracy=500).collect()}
    assert set(got) == {g for g, v in groups.items() if v}
    for g, r in got.items():
        assert r.n == len(groups[g]) and [r[s] for s in shares] == pytest.approx([np.percentile(groups[g], 100 * q) for q in shares.values()], rel=1e-12)
    whole = {r.g: (r.n, r.median, r.most) for r in profiles.quantiles(df, ["g"], "v").collect()}
    assert whole["gone"] == (1, None, None) and whole["few"] == (3, 1.5, 2.0)
    assert profiles.exact_quantiles(df, [], "v", {"median": 0.5}).first().median == pytest.approx(np.median([v for vs in groups.values() for v in vs]))


def test_export_and_manifest(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/out"
    turns = spark.createDataFrame([(i // 3, i, f"t{i}") for i in range(30)], "episode_id int, turn int, text string")
    splits = turns.select("episode_id").distinct().withColumn("split", F.when(F.col("episode_id") % 2 == 0, "train").otherwise("test"))
    assert {r.split: (r.episodes, r.turns) for r in trajectories.export_episodes(turns, splits, path).collect()} == {"train": (5, 15), "test": (5, 15)}
    assert {r.status for r in trajectories.verify_export(spark, path).collect()} == {"verified"}
    files = [r.path.removeprefix("file:") for r in trajectories.file_digests(spark, path).orderBy("path").collect()]
    changed = Path(files[0])
    changed.with_name(f".{changed.name}.crc").unlink()  # the local file system's own digest would notice first
    changed.write_bytes(changed.read_bytes() + b"x")
    with open(files[0] + ".new", "wb") as f:
        f.write(b"y")
    got = {(r.folder.rsplit("=")[-1], r.status): r.n for r in trajectories.verify_export(spark, path).collect()}
    assert got["test", "mismatched"] == 1 and got["test", "unlisted"] == 1
    with pytest.raises(ValueError):
        trajectories.export_episodes(turns, splits.union(splits), path + "2")


LISTING = "root@06e31eef63ee:/srv/run# ls -la /app/\ntotal 24\ndrwxr-xr-x 1 root root  4096 Oct 31  2025 .\n-rwxr-xr-x 1 root root 14520 Oct 31  2025 exploit\nlrwxrwxrwx 1 root root 9 Oct 31 12:30 link -> /app/x\nroot@06e31eef63ee:/app#"


def test_masked_listing():
    text, n = parsers.masked(LISTING, {"shown"}, {"exploit"})
    assert all(x not in text for x in ("06e31eef63ee", "exploit", "14520", "4096", "2025", "/srv/run", "link"))
    assert all(x in text for x in ("<host>:", "<name>", "<date>", "total <n>", "ls -la /app/")) and n > 8
    text, _ = parsers.masked(LISTING, {"exploit", "link"}, {"exploit"})
    assert "exploit" in text and "link -> " in text and "14520" not in text
    assert parsers.masked("notes.csv a.xyz word v1.2.3 12 123", set(), {"a.xyz", "word"}) == ("<file.csv> <file.xyz> <name> <version> 12 <n>", 5)
    assert parsers.masked("", set(), set()) == ("", 0) and parsers.masked("/usr/bin/ls ./x", {"x"}, set())[0].endswith("./x")


def test_pages(spark):
    corpus = spark.createDataFrame([("e", t, f"do{t}", "abcdefghij") for t in (1, 2, 4)], "episode string, turn int, action_type string, observation string")
    asked = spark.createDataFrame([("e", 1, -5, 4), ("e", 2, 8, 4), ("e", 4, 2, 0), ("e", 9, 0, 1)], "episode string, turn int, offset int, length int")
    got = {r.turn: (r.offset, r.text, r.next_offset, [tuple(n) for n in r.neighbours]) for r in retrieval.read_pages(asked, corpus).collect()}
    assert got == {1: (0, "abcd", 4, [(2, "do2")]), 2: (8, "ij", None, [(1, "do1")]), 4: (2, "c", 3, [])}


def test_loose_objects():
    read = lambda t: [(x.value, x.clean(x.value)) for x in loose.objects(t)]
    assert read('say {"a": [1, {"b": null},], \'c\': "}",} and {d: 2.5}') == [({"a": [1, {"b": None}], "c": "}"}, True), ({"d": 2.5}, True)]
    assert read("{a: 'text'}") == [({"a": "text"}, False)] and read('{"a": oops!, "b": 1}') == [({"a": "oops!", "b": 1}, False)]
    assert read('{ {"a": 1}') == [({"a": 1}, True)] and read("{") == read("no object") == read("{]") == []
    assert read('{"a" 1, "b": 2}')[0][0] == {"b": 2} and loose.read_object('{"a": {"b": 1', 0, open_ended=True).value == {"a": {"b": 1}}
