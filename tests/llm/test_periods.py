"""Periodic runs against a search for all periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from maskwright.llm import periods, queries


def all_runs(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                length = j - i + q
                if length >= max(least, times * q) and not any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                    out.append((i, length, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def made_up(seed, size):
    rnd, w = random.Random(seed), []
    while len(w) < size:
        k = rnd.choice([1, 2, 5, 60])
        block = [rnd.randint(0, k) for _ in range(rnd.randint(1, 30))]
        w += (block * rnd.randint(1, 8))[: rnd.randint(1, 150)]
    return w


def test_lyndon_array_by_groups():
    rnd = random.Random(1)
    for _ in range(400):
        w = [rnd.randint(0, 2) for _ in range(rnd.randint(0, 14))]
        longest = lambda i: max(n for n in range(1, len(w) - i + 1) if all(w[i : i + n] < w[i + k : i + n] for k in range(1, n)))  # noqa: E731, B023
        assert periods.lyndon(w) == [longest(i) for i in range(len(w))]


def test_runs_against_all_periods():
    for seed in range(300):
        w = made_up(seed, seed)
        want = all_runs(w)
        assert periods.runs_of(np.array(w, np.int64)) == want
        found = [(a + s, n, q) for a, b in periods._stretches(np.array(w), np.zeros(len(w), np.int64)) for s, n, q in periods.runs_of(np.array(w[a:b]))]
        assert sorted(found, key=lambda r: (r[0], r[2])) == want


def test_rows_of_any_kind(spark):
    texts = [[f"w{x}" for x in made_up(seed, seed * 3)] for seed in range(60)] + [None, [], ["a"], ["a"] * 23, ["a"] * 24, [None] * 30 + ["b"], ["x", "y"] * 30_000]
    df = spark.createDataFrame([(i % 9, t, "old") for i, t in enumerate(texts)], "id int, body array<string>, runs string").repartition(3)
    got = sorted(map(str, ((r["id"], r["body"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.with_runs(df, "body").collect())))
    want = []
    for i, t in enumerate(texts):
        runs = [(0, 60_000, 2)] if t and len(t) == 60_000 else all_runs(t or [])
        want.append(str((i % 9, t, runs, collapsed([x or "" for x in t or []], runs))))
    assert got == sorted(want)
    assert periods.with_runs(spark.createDataFrame([], "words array<string>")).collect() == []


def test_small_slices(spark, monkeypatch):
    w = [f"w{x}" for x in made_up(5, 900)]
    df = spark.createDataFrame([(w[k : k + 200],) for k in range(0, 800, 50)], "words array<string>").coalesce(1)
    want = sorted(map(str, periods.with_runs(df).collect()))
    monkeypatch.setattr(periods, "SLICE", 300)
    assert sorted(map(str, periods.with_runs(df).collect())) == want


def test_whole_query_against_plain_version(spark):
    sf, want = "/root/testdata/sf0.001", []
    for doc, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = all_runs(w)
        best = max(runs, key=lambda r: (r[1] * 10**6 // r[2], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        want.append((doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    got = [tuple(r) for r in queries.op12_periods(spark, sf).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[1] > 0 for r in got) > 10
