"""Collocations against a plain count."""

import re
from collections import Counter

import pytest

from maskwright.llm import phrases


def plain(rows, top=2000, least=30, inside=80):
    by, out = {}, []
    for lang, text in rows:
        by.setdefault(lang or "und", []).append(text or "")
    for lang, texts in by.items():
        f, n = Counter(), 0
        for t in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t)):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longer = Counter()
        for g, a in candidates.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    longer[g[i : i + m]] = max(longer[g[i : i + m]], a)
        found = []
        for g, a in candidates.items():
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            if not longer[g] or 100 * longer[g] < inside * a:
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, rank, g.decode(), -a, l, r, n, -s) for rank, (s, a, g, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text").collect()]
    rows += [(None, "A b c. " * 50), ("und", "a b\x00 É"), (None, None), ("x", ""), ("x", "Q\tq  q q\x0bq"), ("y", "hot word pair here. " * 20_000), ("y", "hot word " * 5_000)]
    return rows, spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, n int, phrase string").repartition(5).cache()


@pytest.mark.parametrize("budget, cells", [(1_000_000, 1 << 14), (20_000, 64), (3_000, 16), (50, 2)])
def test_against_plain_count(table, budget, cells):
    rows, df = table
    assert sorted(tuple(r) for r in phrases.collocations(df, budget=budget, cells=cells).collect()) == plain(rows)


def test_small_buffers_and_other_limits(table, monkeypatch):
    rows, df = table
    monkeypatch.setattr(phrases, "CHUNK", 3_000)
    monkeypatch.setattr(phrases, "FLUSH", 20_000)
    got = phrases.collocations(df, top=25, least=10, inside=50, budget=5_000, cells=64).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 25, 10, 50)


def test_groups_keep_to_the_budget(spark, table):
    _, df = table
    texts = df.na.fill("").select("lang", "text")
    levels, _ = phrases.partitioned(texts, 3_000, 64)
    sizes = Counter()
    for r in phrases._suffixes(texts, levels).collect():
        import zstandard

        sizes[r["g"]] += len(zstandard.ZstdDecompressor().decompress(r["rows"])) // 20
    assert len(levels) > 1 and max(sizes.values()) < 10_000


def test_counts_beyond_64_bits_in_the_score(spark):
    a, l, r = 9 * 10**15, 9 * 10**15 + 7, 10**16
    got = spark.sql(f"SELECT (cast({a}L AS decimal(20,0)) * 2000000) div (cast({l}L AS decimal(20,0)) + {r}L)").first()[0]
    assert got == 2000000 * a // (l + r)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
