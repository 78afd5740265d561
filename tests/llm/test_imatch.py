"""I-Match fingerprints against a plain version."""

import hashlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from maskwright.llm import imatch, queries

SHAPE = "doc_id long, text string"


def plain_terms(text):
    out = set()
    word = ""
    for c in text + " ":
        if ord(c) > 127 or c.isalnum() or c == "_":
            word += c.lower() if c.isascii() else c
        elif word:
            out.add(word)
            word = ""
    return out


def kept_by(hashed, j):
    x = (hashed + 0x9E3779B97F4A7C15 * (j + 1)) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return (x ^ (x >> 31)) < int(imatch.RATES[j // imatch.EACH] * 2**64)


def plain_print(text, band):
    own = sorted(xxhash.xxh64_intdigest(t.encode(), 7) for t in plain_terms(text))
    own = [h for h in own if h in band] or own
    marks, seen = [], 0
    for j in range(imatch.SUBSETS):
        if j % imatch.EACH == 0 and seen >= imatch.SEEN:
            break
        terms = [h for h in own if kept_by(h, j)]
        seen += bool(terms)
        marks.append(f"{xxhash.xxh32_intdigest(b''.join(h.to_bytes(8, 'little') for h in terms)) % 0xFFFF + 1:04x}" if terms else "0000")
    return "".join(marks).ljust(4 * imatch.SUBSETS, "0")


def plain_likeness(a, b):
    if a == b:
        return 1.0
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
    seen = [p for p in pairs if p != ("0000", "0000")][: imatch.SEEN]
    return sum(x == y for x, y in seen) / len(seen)


def plain_rows(rows, band):
    """The whole query, document by document."""
    texts = [t or "" for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))]
    ids = sorted((r[0] for r in rows), key=lambda i: (i is None, i or 0))
    out = []
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [plain_print(t, band) for t in (text, edited, after)]
        out.append((ids[k], len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints[:2], plain_likeness(prints[0], prints[1]), plain_likeness(prints[0], prints[2])))
    return out


def band_of(rows):
    counts = Counter(t for _, text in rows for t in plain_terms(text or ""))
    n = len(rows)
    least = max(2, int(np.ceil(imatch.RARE * n)))
    return {xxhash.xxh64_intdigest(t.encode(), 7) for t, c in counts.items() if least <= c <= max(least, imatch.COMMON * n)}


def query_rows(df, **more):
    near = lambda c: imatch.likeness(F.col("fingerprint"), F.col(c))
    rows = imatch.with_next(df, **more).select("id", "n_chars", F.sha2("edited", 256), "fingerprint", "edited_fingerprint", near("edited_fingerprint"), near("next_fingerprint"))
    return [tuple(r) for r in rows.collect()]


def as_sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *map(str, r)))


def test_whole_query_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op11_imatch(spark, sf).collect()]
    assert as_sorted(got) == as_sorted(plain_rows(rows, band_of(rows)))


def test_nulls_ties_repeats_and_ranges(spark):
    rows = [(3, "Um dois três quatro"), (3, "um DOIS três"), (None, "null id"), (None, None), (5, None), (5, ""), (7, "!!!"), (-1, "um dois"), (9, "x" * 50_000 + " dois três"), (4, "ação é ção"), (4, "ação é ção"), (4, "ação é ção")]
    rows += [(100 + i, f"text {i % 7} of {i} um dois") for i in range(60)] + [(50, "hot row one two")] * 1200
    want = as_sorted(plain_rows(rows, band_of(rows)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE + ", digest string, range int").repartition(7)
    for ranges in (1, 5, 40):
        assert as_sorted(query_rows(df, ranges=ranges)) == want


def test_one_document_and_none(spark):
    assert query_rows(spark.createDataFrame([(1, "a b c d")], SHAPE))[0][:3] == (1, 7, hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest())
    assert query_rows(spark.createDataFrame([], SHAPE)) == []


def test_lexicon_never_exceeds_its_bound(spark):
    df = spark.createDataFrame([(i, f"a{i % 50} b{i % 20} c{i % 3}") for i in range(300)], SHAPE)
    assert len(imatch.lexicon(df, common=1.0)[0]) == 73
    assert 0 < len(imatch.lexicon(df, common=1.0, most=30)[0]) <= 30


def test_fingerprints_of_any_table(spark):
    df = spark.createDataFrame([(1, "one two three", "k"), (2, None, "l"), (3, "one two three", "m")], "a int, body string, fingerprint string")
    got = {r["a"]: r["fingerprint"] for r in imatch.fingerprinted(df, "body").collect()}
    assert got[1] == got[3] != got[2] == "0" * 4 * imatch.SUBSETS


def test_edited_texts_are_nearer_than_the_next(spark):
    rows = queries.op11_imatch(spark, "/root/testdata/sf0.01").select("near_edited", "near_next").where("near_next < 1").collect()
    assert np.mean([r[0] > r[1] for r in rows]) > 0.95
