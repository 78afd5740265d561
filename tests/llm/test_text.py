"""BPE, packing, SimHash and search against the public library and brute force."""

import random
import zlib
from collections import Counter
from hashlib import sha256
from math import log1p

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import bpe, packing, search, simhash
from maskwright.llm.components import components
from maskwright.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "Hello  World's ünïcode İΣΑΣ 日本 123 <|endoftext|> a!! b-- don't <|startoftext|>x"), (5, "same text here for ties and copies"), (6, "same text here for ties and copies"),
    (7, "é composed   spaced \x1c odd ² ½ ª"), (8, "x" * 30_000), (9, "long words " * 5000), (9, "long words " * 5000), (10, "one"), (11, "one two three"), (12, "A.B,c!?<|ENDOFTEXT|>"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 1, "clash") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, length int, fp string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_equals_library(spark, odd, library):
    got = sorted(map(tuple, bpe.encode_digests(odd, vocabulary()).collect()))
    want = []
    for i, t in ODD:
        ids = ids_of(library, t)
        text = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        want.append((i, len(ids) // 4, sha256(ids).hexdigest(), sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    full = bpe.encode(odd.where("doc_id = 4"), vocabulary(), decoded=True).first()
    assert full["ids"] == library.encode(ODD[3][1], add_special_tokens=False).ids and full["decoded"].startswith("hello</w>")
    assert bpe.encode_digests(odd.limit(0), vocabulary()).count() == 0


def test_bpe_every_character(library):
    enc = bpe.TrieEncoder(vocabulary())
    texts = [f"a{c}1 {c}{c} b{c}" for c in map(chr, [*range(0x3000), *range(0x1F300, 0x1F400)]) if not 0xD800 <= ord(c) < 0xE000]
    assert [ids_of(library, t) for t in texts] == enc.encode_batch(texts)


def test_bpe_random_words(library):
    r = random.Random(3)
    texts = ["".join(r.choice("abcdeéßñİΣ漢́ \n'!?._<|>ing") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    assert [ids_of(library, t) for t in texts] == bpe.TrieEncoder(vocabulary()).encode_batch(texts)


def test_bpe_query_on_all_documents(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op3_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = ids_of(library, d["text"]), got[d["doc_id"]]
        text = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, sha256(ids).hexdigest(), sha256(text.encode()).hexdigest())


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, odd, library):
    rows = packing.pack_documents(odd, vocabulary()).collect()
    want = Counter()
    for i, t in ODD:
        ids = ids_of(library, t) + b"\0\0\0\0"
        for n, k in enumerate(range(0, len(ids), 4 * 2048)):
            want[i, n, k // 4, len(ids[k : k + 8192]) // 4, zlib.crc32(ids[k : k + 8192])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert check_packing(rows, 2048) == -(-sum(r["length"] for r in rows) // 2048)
    assert packing.pack_documents(odd.limit(0), vocabulary()).count() == 0


def test_packing_query_on_all_documents(spark, library):
    rows = QUERIES["op6_packing"](spark, SF).collect()
    want = Counter()
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = ids_of(library, d["text"]) + b"\0\0\0\0"
        for n, k in enumerate(range(0, len(ids), 4 * 2048)):
            want[d["doc_id"], n, k // 4, len(ids[k : k + 8192]) // 4, zlib.crc32(ids[k : k + 8192])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert least <= check_packing(rows, 2048) <= least * 1.01 + 1


def test_packing_of_any_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)  # many salts
    df = spark.createDataFrame([(k % 5, 7 if k % 3 else 40, "x", 1, 2) for k in range(400)], "salt int, length long, rank string, sequence_id int, part int").cache()
    rows = packing.pack(df, 100).collect()
    assert len(rows) == 400 and check_packing(rows, 100) == 84 and Counter(r["salt"] for r in rows) == Counter(k % 5 for k in range(400))
    bare = packing.pack(df.select("length"), 100).collect()
    assert len(bare) == 400 and check_packing(bare, 100) == check_packing(rows, 100)


def test_packing_is_tight(spark):
    rows = packing.pack(spark.createDataFrame([(k, 1 + (k * k) % 97) for k in range(800)], "id int, length long").cache(), 100).collect()
    assert len(rows) == 800 and check_packing(rows, 100) <= -(-sum(r["length"] for r in rows) // 100) * 1.02
    best = packing.fullest([60, 30, 7, 5], {60: 1, 30: 2, 7: 3, 5: 9}, 92)
    assert sum(k * n for k, n in best) == 92 and all(n <= {60: 1, 30: 2, 7: 3, 5: 9}[k] for k, n in best)


def brute_fingerprint(text, n=4):
    from xxhash import xxh64_intdigest

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=4):
    root = dict.fromkeys(prints)
    for a in root:
        root[a] = a
    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def test_simhash_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {d["doc_id"]: brute_fingerprint(d["text"]) for d in docs}
    got = QUERIES["op2_simhash"](spark, SF).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == classes(prints)


def test_simhash_odd_rows(spark, odd):
    rows = {r["id"]: r for r in simhash.groups(odd).collect()}
    assert all(rows[i]["fingerprint"] == f"{brute_fingerprint(t):016x}" for i, t in ODD)
    assert {rows[i]["component_id"] for i in (1, 2, 3)} == {1} and rows[6]["component_id"] == 5
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (2, 3, 6)").count() == 0
    assert simhash.groups(odd.limit(0)).count() == 0


def test_simhash_rows_without_ids(spark):
    rows = [(None, "alone and without any id here"), (None, "a group of text copies one"), (3, "a group of text copies one"), (None, "other text twice in a row"), (None, "other text twice in a row"), (7, "one"), (7, "two"), (7, "two")]
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, fp int, row int")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=str)
    assert kept == sorted([(None, rows[0][1]), (3, rows[1][1]), (None, rows[3][1]), (7, "one"), (7, "two")], key=str)
    found = sorted(((r["id"], r["component_id"]) for r in simhash.groups(df).collect()), key=str)
    assert found == sorted([(None, None), (None, 3), (3, 3), (None, None), (None, None), (7, 7), (7, 7), (7, 7)], key=str)
    assert simhash.keep_one(df.limit(0)).columns == df.columns


def test_shards_crowded_at_every_level(spark, monkeypatch):
    """All fingerprints agree but in few bits, so that blocks of the others never part them."""
    monkeypatch.setattr(simhash, "SHARD", 40)
    r = random.Random(9)
    prints = dict(enumerate(sorted({sum(1 << b for b in r.sample(range(0, 60, 5), r.randint(0, 9))) for _ in range(500)})))
    df = spark.createDataFrame(list(prints.items()), "id long, fp long")
    found = {x["node"]: x["component"] for x in components(simhash.links(df, 2), "a", "b").collect()}
    assert {i: found.get(i, i) for i in prints} == classes(prints, 2)


def test_crowded_shards_are_dealt_again(spark, monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(simhash, "SHARD", 20)
    prints, base = {}, r.getrandbits(64)
    for k in range(400):
        flips = sum(1 << b for b in r.sample(range(64), r.randint(0, 6)))
        prints[k] = (base if k % 2 else r.getrandbits(64)) ^ flips
    df = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in prints.items()], "id long, fp long").dropDuplicates(["fp"])
    own = {x["id"]: prints[x["id"]] for x in df.collect()}
    found = {x["node"]: x["component"] for x in components(simhash.links(df), "a", "b").collect()}
    assert {i: found.get(i, i) for i in own} == classes(own)


def test_a_dense_family_is_not_copied(spark):
    """20,000 fingerprints over 16 bits, alone and with three families of 3,900 that differ from each other in few bits."""
    r = random.Random(3)
    bits = r.sample(range(64), 40)
    spread = lambda x, some: sum(1 << b for k, b in enumerate(some) if x >> k & 1)
    prints = {spread(x, bits[:16]) for x in r.sample(range(1 << 16), 20_000)}
    alone = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)], "id long, fp long")
    assert simhash.shards(alone)[0].count() <= 5 * len(prints)
    far = spread((1 << 20) - 1, bits[16:36])
    families = [{far ^ spread(x, bits[:12]) ^ apart for x in r.sample(range(1 << 12), 3_900)} for apart in (0, spread(31, bits[36:40] + bits[12:13]), spread(63, bits[12:18]))]
    prints = prints.union(*families)
    signed = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(signed, "id long, fp long").repartition(8)
    dealt, known = simhash.shards(df)
    assert dealt.count() <= 25 * len(prints) and known.count() <= 16 * len(prints)
    assert dealt.groupBy("shard").count().agg(F.max("count")).first()[0] <= simhash.SHARD
    found = {x["node"]: x["component"] for x in components(simhash.links(df), "a", "b").collect()}
    of = {p: found.get(k, k) for k, p in enumerate(sorted(prints))}
    values = np.array(sorted(prints), np.uint64)
    label = np.arange(len(values))
    todo = set(range(len(values)))  # plain search, one component after the other
    while todo:
        front, seen = [todo.pop()], []
        while front:
            k = front.pop()
            seen.append(k)
            near = np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 4)
            new = [j for j in near.tolist() if j in todo]
            todo.difference_update(new)
            front += new
        label[seen] = min(seen)
    assert [of[int(v)] for v in values] == label.tolist()


def test_bk_tree():
    r = random.Random(7)
    tree, values = simhash.BKTree(), [r.getrandbits(16) for _ in range(300)]
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 3)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 3]
    assert simhash.BKTree().within(1, 4) == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 6), (9, 9), (None, 4)] + [(100 + k, 101 + k) for k in range(60)] + [(500, 600 + k) for k in range(80)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    want = {1: 1, 2: 1, 3: 1, 5: 5, 6: 5} | {100 + k: 100 for k in range(61)} | {500: 500} | {600 + k: 500 for k in range(80)}
    assert got == want
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def brute_search(rows, k=10):
    """(query row, [(score, id, row)]) of rows (id, text) whose id is divisible by 20, each row on its own."""
    tf = [Counter(search.words(t)) for _, t in rows]
    size = [c.total() for c in tf]
    n, mean, df = len(tf), sum(size) / len(tf), Counter(w for c in tf for w in c)
    holders = {}
    for i, c in enumerate(tf):
        for w in c:
            holders.setdefault(w, []).append(i)
    out = {}
    for q, (i, _) in enumerate(rows):
        if i is None or i % 20:
            continue
        scores = Counter()
        for w, m in tf[q].items():
            for d in holders[w]:
                c = tf[d][w]
                scores[d] += m * log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * size[d] / mean))
        out[q] = sorted((-s, rows[d][0] is None, rows[d][0] or 0) for d, s in scores.items())[:k]
    return out


def same_ranks(got, want):
    """Ids and scores of ranked lists, where lists of queries with one id come in any order; near-ties may swap."""
    lists = {}
    for r in got:
        lists.setdefault(r["query_id"], {}).setdefault(r["rank"], []).append((r["doc_id"], r["score"]))
    for q, best in want.items():
        for rank, (score, missing, i) in enumerate(best, 1):
            own = lists[q].get(rank, [])
            assert any(np.isclose(s, -score, rtol=1e-12) for _, s in own), (q, rank)
            alike = [x for x in best if np.isclose(x[0], score, rtol=1e-9)]
            if len(alike) == 1 or all(x[0] == score for x in alike):
                assert any(d == (None if missing else i) for d, _ in own), (q, rank)


@pytest.mark.parametrize("dense", [0.04, 0.3])
def test_search_against_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(search, "POSTINGS", 9000)  # several shards a task, several blocks of queries
    monkeypatch.setattr(search, "QUERY_POSTINGS", 1000)
    texts = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rows = QUERIES["op5_search"](spark, SF).collect()
    want = {texts[q][0]: best for q, best in brute_search(texts).items()}
    same_ranks(rows, want)
    assert len(rows) == sum(map(len, want.values())) and {r["query_id"] for r in rows} == set(want)
    assert len({(r["query_id"], r["rank"]) for r in rows}) == len(rows)


def test_search_deals_documents_once(spark, monkeypatch):
    """However many queries there are: what a task can't hold of them lies in its temporary file."""
    monkeypatch.setattr(search, "QUERY_POSTINGS", 100)
    docs = spark.createDataFrame([(i, f"alpha w{i} w{i // 2} w{i // 3}") for i in range(400)], "doc_id long, text string")
    found = search.top_k(docs, F.lit(True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1  # only the queries go to every task
    assert {r["query_id"] for r in found.where("rank = 1 and query_id = doc_id").collect()} == set(range(400))
    grown = search.Growing(np.int64, 5)
    for k in range(4):
        grown.add(np.arange(3 * k, 3 * k + 3))
    assert grown.file is not None and not grown.held and grown.whole().tolist() == list(range(12))


def test_search_repeated_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(search, "POSTINGS", 10)
    rows = [(20, "alpha beta gamma"), (20, "alpha delta"), (20, "alpha delta"), (None, "beta gamma epsilon"), (3, "delta " * 3), (None, "alpha"), (40, ""), (60, None)]
    got = search.top_k(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int"), F.col("id") % 20 == 0).collect()
    want = brute_search(rows)
    lists = Counter((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in got)
    assert lists == Counter((rows[q][0], rank, None if b[1] else b[2], round(-b[0], 9)) for q, best in want.items() for rank, b in enumerate(best, 1))


def test_search_prunes_blocks(monkeypatch):
    """With a threshold, blocks are left closed and nothing is lost."""
    rng = np.random.default_rng(5)
    docs = [Counter(rng.choice(60, 30) + (0 if k < 400 else 60)) for k in range(800)]
    flat = [np.array(sorted(c)) for c in docs]
    tf = [np.array([c[t] for t in f]) for c, f in zip(docs, flat)]
    n = len(docs)
    part = (np.arange(n), np.arange(n), np.ones(n, bool), np.full(n, 30.0), np.array(list(map(len, flat))), np.concatenate(flat), np.concatenate(tf))
    shard = search.Shard([part], 30.0)
    query = np.arange(0, 20)
    slow = {d: sum(docs[d][t] * 2.2 / (docs[d][t] + 1.2) for t in query if t in docs[d]) for d in range(n)}
    limit = sorted(slow.values())[-10]
    local = np.searchsorted(shard.names, query)
    batch = search.Batch(shard, np.zeros(20, int), local, np.ones(20), np.array([limit]))
    found = dict(batch.candidates(np.array([0]), 10))[0]
    assert {int(shard.row[d]) for d in found} == {d for d, s in slow.items() if s >= limit * (1 - 1e-9)}
    assert (~batch.live).sum() >= 2  # the blocks of the other half


def test_search_odd_rows(spark, odd):
    rows = search.top_k(odd, F.col("id").isin(1, 2, 5)).collect()
    assert {(r["query_id"], r["rank"], r["doc_id"]) for r in rows if r["rank"] <= 2} == {(5, 1, 5), (5, 2, 6)} and all(r["query_id"] == 5 for r in rows)
    assert search.top_k(odd.limit(0), F.col("id") == 1).count() == 0
