"""Collocations: phrases of two to four words that occur more often than their parts let expect, for each language.

The counting is vertical partitioning as in the ERA suffix tree. A suffix here is a place in a piece of text with the (up to)
four words that begin there.

1. ``partitioned`` scans the texts and counts the suffixes by their first word; words are hashed to cells. Cells that hold more
   than ``budget`` suffixes are split by the first two words in a further scan, and so on up to four words, where equal
   suffixes count as one leaf. Neighbouring cells are put together to groups of about ``budget`` suffixes. So each group
   fits in a task, however often a word occurs, and what all tasks know is a few numbers for each group.
2. A second kind of scan sends every suffix to its group: sorted, equal ones put together, as packed arrays.
3. ``_subtrees`` builds for each group, by itself, the suffix subtree cut off at four words: the sorted leaves with their
   totals, and a node for each prefix. A phrase's count is the sum over its node's leaves. Nodes above the point where a cell was
   split lie in several groups; their parts are added up at the end.

Then (``collocations``) each candidate meets the counts of its parts in joins, and each longer candidate hands its count to the
phrases inside it. Nothing is sampled or capped: ``top`` is the feature. Counts are longs and the score is worked out in
decimals.

Words, pieces and languages: A-Z are lower-cased, pieces end at ``.,;:!?`` and at the characters 10 to 13, words are what
spaces and tabs separate. Null or empty texts have no words; a null language counts as ``und``, together with a language of
that name. Texts of any length are read whole, repeated rows count as often as they occur, ids don't matter, an empty table
gives no rows, and columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, take

#: Words of a phrase at most, occurrences of a candidate at least, and the share (in %) of its own count from which a longer candidate
#: takes a phrase's place.
DEPTH, LEAST, INSIDE = 4, 30, 80
#: Suffixes of a group, about: some 60 bytes each in a task.
BUDGET = 1_000_000
#: Cells of the first scan; further scans take 16 for each group, at least as many as this.
CELLS = 1 << 14
#: Bytes that are split into words at once, and suffixes that a task sorts at once.
CHUNK, FLUSH = 2_000_000, 2_000_000

_BREAKS = bytes(b".,;:!?\n\v\f\r")
_TABLE = bytes(0xFF if c in _BREAKS else 0x20 if c == 9 else c for c in range(256))  # no byte of UTF-8 is 0xFF


def _chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, texts put together) in chunks of about ``CHUNK`` bytes."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in parts:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text) + 1
            if size[lang] >= CHUNK:
                yield lang, b"\xff".join(held.pop(lang))
                size.pop(lang)
    yield from ((lang, b"\xff".join(texts)) for lang, texts in held.items())


def _coded(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(language, distinct words, codes): the words of a chunk in order as places among the distinct ones, counted from 1; 0 ends a piece."""
    for lang, text in _chunks(parts):
        tokens = text.translate(_TABLE).lower().replace(b"\xff", b" \xff ").split()
        if tokens:
            coded = pa.array([b"\xff", *tokens], pa.binary()).dictionary_encode()
            yield lang, coded.dictionary, coded.indices.to_numpy()[1:]


def _windows(codes: np.ndarray) -> np.ndarray:
    """The suffixes (four rows of codes, 0 behind the end of a piece) of all places that have a word."""
    out = np.zeros((DEPTH, len(codes)), np.int64)
    out[0] = codes
    for d in range(1, DEPTH):
        out[d, :-d] = np.where(out[d - 1, :-d] > 0, codes[d:], 0)
    return out[:, codes > 0]


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _cells(hashed: np.ndarray, windows: np.ndarray, depth: int, cells: int) -> np.ndarray:
    """The cell of each suffix by its first ``depth`` words."""
    h = hashed[windows[0]]
    for d in range(1, depth):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + hashed[windows[d]]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(cells - 1)).astype(np.int64)


SPLIT = -1


def _routed(hashed: np.ndarray, windows: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(group, depth by which it was found) of each suffix; group ``SPLIT`` where a cell still has to be split."""
    group, depth = np.full(windows.shape[1], SPLIT, np.int64), np.zeros(windows.shape[1], np.int64)
    for k, level in enumerate(levels):
        open_ = np.flatnonzero(group == SPLIT)
        group[open_] = level[_cells(hashed, windows[:, open_], k + 1, len(level))]
        depth[open_] = k + 1
    return group, depth


def partitioned(texts: DataFrame, budget: int, cells: int) -> tuple[list[np.ndarray], DataFrame]:
    """The group of each cell, for one word, two words and so on, and a table (lang, n) of all words."""
    spark = texts.sparkSession
    levels: list[np.ndarray] = []
    size, groups, words = cells, 0, None
    while len(levels) < DEPTH:
        known = spark.sparkContext.broadcast(levels)

        def count(parts: Iterator[pa.RecordBatch], size: int = size) -> Iterator[pa.RecordBatch]:
            found: dict[str, np.ndarray] = {}
            for lang, distinct, codes in _coded(parts):
                hashed, rows = _hashes(lang, distinct.to_pylist()), _windows(codes)
                if known.value:
                    rows = rows[:, _routed(hashed, rows, known.value)[0] == SPLIT]
                sums = found.setdefault(lang, np.zeros(size, np.int64))
                sums += np.bincount(_cells(hashed, rows, len(known.value) + 1, size), minlength=size)
            for lang, sums in found.items():
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(sums[some])], names=["lang", "cell", "n"])

        counted = cut(texts.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")))
        if words is None:
            words = counted.groupBy("lang").agg(F.sum("n").alias("n"))
        held = np.zeros(size, np.int64)
        for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():  # as many rows as there are cells at most
            held[r.column(0).to_numpy()] = r.column(1).to_numpy()
        heavy = (held > budget) & (len(levels) + 1 < DEPTH)
        light = np.where(heavy, 0, held)
        level = groups + (np.cumsum(light) - light) // budget
        groups = int(level.max()) + 1
        levels.append(np.where(heavy, SPLIT, level))
        if not heavy.any():
            break
        size = max(cells, 1 << int(16 * held[heavy].sum() // budget).bit_length())
    return levels, words


def _packed(words: list[bytes], rows: np.ndarray) -> tuple[bytes, bytes]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    return pack(b"\xff".join(words)), pack(rows.astype(np.int32).tobytes())


def _combined(rows: np.ndarray, *first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the columns of suffixes sorted by the ``first`` keys and then by words, and where new ones start."""
    a, b = rows[0] << 32 | rows[1], rows[2] << 32 | rows[3]
    order = np.lexsort((b, a, *first[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, [k[order][1:] != k[order][:-1] for k in (*first, a, b)])
    return order, np.flatnonzero(new)


def _sent(lang: str, index: dict[bytes, int], rows: np.ndarray, levels: list[np.ndarray]) -> Iterator[tuple]:
    """(group, depth, lang, words, suffixes with counts) of the suffixes of a task."""
    words = list(index)
    hashed = _hashes(lang, words)
    group, depth = _routed(hashed, rows, levels)
    order, starts = _combined(rows, group, depth)
    counts = np.diff(np.append(starts, len(order)))
    first = order[starts]
    rows, group, depth = rows[:, first], group[first], depth[first]
    cut_at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (depth[1:] != depth[:-1])))
    mark, place = np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    for x, y in zip(cut_at, np.append(cut_at[1:], len(group))):
        part = rows[:, x:y]
        mark[part.ravel()] = True
        mark[0] = True
        used = np.flatnonzero(mark)
        place[used] = np.arange(len(used))
        mark[used] = False
        yield int(group[x]), int(depth[x]), lang, *_packed([words[k] for k in used], np.vstack([place[part], counts[x:y]]))


def _suffixes(texts: DataFrame, levels: list[np.ndarray]) -> DataFrame:
    """(g, depth, lang, words, rows): all suffixes, by group."""
    known = texts.sparkSession.sparkContext.broadcast(levels)
    names = ["g", "depth", "lang", "words", "rows"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()]

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, dict[bytes, int]] = {}
        held: dict[str, list[np.ndarray]] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held.pop(lang), axis=1)
            for r in _sent(lang, index.pop(lang), rows, known.value):
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(r, kinds)], names=names)

        for lang, distinct, codes in _coded(parts):
            own = index.setdefault(lang, {b"\xff": 0})
            place = np.fromiter((own.setdefault(w, len(own)) for w in distinct.to_pylist()), np.int64, len(distinct))
            held.setdefault(lang, []).append(place[_windows(codes)])
            if sum(x.shape[1] for x in held[lang]) >= FLUSH:
                yield from out(lang)
        for lang in list(held):
            yield from out(lang)

    return texts.mapInArrow(send, "g long, depth int, lang string, words binary, rows binary")


def _subtrees(table: pa.Table, least: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, phrases, counts) of the nodes of one group's suffix subtree: those that count ``least``, and those above a split."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    parts: dict[tuple[str, int], tuple[dict[bytes, int], list[np.ndarray]]] = {}
    for depth, lang, words, rows in zip(*(table.column(c).to_pylist() for c in ("depth", "lang", "words", "rows"))):
        index, held = parts.setdefault((lang, depth), ({b"\xff": 0}, []))
        known = unpack(words).split(b"\xff")[1:]  # the first is the mark itself, which splits into two empty words
        place = np.fromiter((index.setdefault(w, len(index)) for w in known[1:]), np.int64, len(known) - 1)
        matrix = np.frombuffer(unpack(rows), np.int32).reshape(DEPTH + 1, -1)
        held.append(np.vstack([np.append(0, place)[matrix[:DEPTH]], matrix[DEPTH:]]))
    for (lang, split), (index, held) in parts.items():
        leaves = np.concatenate(held, axis=1)
        order, starts = _combined(leaves[:DEPTH])
        totals = np.add.reduceat(leaves[DEPTH][order], starts)
        leaves = leaves[:DEPTH, order[starts]]
        words = list(index)
        new = np.zeros(leaves.shape[1], bool)
        new[0] = True
        for d in range(DEPTH):
            new[1:] |= leaves[d, 1:] != leaves[d, :-1]
            at = np.flatnonzero(new)
            count = np.add.reduceat(totals, at)
            keep = (leaves[d, at] > 0) & ((count >= least) if d + 1 >= split else True)
            named = [b" ".join([words[c] for c in leaf]) for leaf in leaves[: d + 1, at[keep]].T.tolist()]
            yield lang, d + 1, named, count[keep]


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, budget: int = BUDGET, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """Tables (lang, size, phrase, f) of all phrases of one to four words that occur ``least`` times in their language, and
    (lang, n) of all its words."""
    texts = take(docs, lang=lang_col, text=text_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    levels, words = partitioned(texts, budget, cells)

    def build(table: pa.Table) -> pa.Table:
        found = list(_subtrees(table, least))
        return pa.table({
            "lang": pa.array([lang for lang, _, named, _ in found for _ in named], pa.string()), "size": pa.array([d for _, d, named, _ in found for _ in named], pa.int32()),
            "phrase": pa.array([w for _, _, named, _ in found for w in named], pa.binary()).cast(pa.string()), "f": pa.array(np.concatenate([c for *_, c in found] or [np.zeros(0, np.int64)]), pa.int64()),
        })

    nodes = _suffixes(texts, levels).groupBy("g").applyInArrow(build, "lang string, size int, phrase string, f long")
    return stored(nodes.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases"), words


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 2000, least: int = LEAST, inside: int = INSIDE, budget: int = BUDGET, cells: int = CELLS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` candidates of each language by score, a and phrase.

    A candidate of count a is cut where its score, floor(2000000 a / (l + r)) for parts of counts l and r, is lowest (of equal
    ones at the first place). Candidates inside a longer candidate of at least ``inside`` % of their count are left out.
    """
    counts, words = phrase_counts(docs, text_col, lang_col, least, budget, cells)
    parts = counts.select("lang", "phrase", "f")
    candidates = counts.where(F.col("size") > 1)
    of = lambda first, many: F.array_join(F.slice("w", first, many), " ")
    cuts = candidates.select("lang", "phrase", "size", "f", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select("lang", "phrase", F.col("f").alias("a"), "k", of(F.lit(1), F.col("k")).alias("left"), of(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    both = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = both.withColumn("score", F.expr("(cast(a AS decimal(20,0)) * 2000000) div (cast(l AS decimal(20,0)) + r)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")
    sizes = F.explode(F.sequence(F.lit(2), F.col("size") - 1))
    within = candidates.where(F.col("size") > 2).select("lang", "size", "f", F.split("phrase", " ").alias("w"), sizes.alias("m")).select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    longer = within.select("lang", of(F.col("at"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(inside).cast("decimal(20,0)") * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    listed = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return listed.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
