"""Document fingerprints by I-Match: hashes of the sorted distinct terms of a text that lie in randomised lexicons.

``lexicon`` counts in how many documents each term occurs (over all documents) and keeps the terms of a band of inverse document
frequency: those in at most ``COMMON`` of all documents, and in at least ``RARE`` of them (and two). The lower end rises,
if need be, until a lexicon can't have more than ``LEXICON`` terms, as the terms found in c documents or more are at most the
sum of all document frequencies divided by c. So the lexicon is small enough for every task, whatever the corpus.

``SUBSETS`` lexicons are drawn from it: by a hash, each keeps a term with its level's probability, from one half down to one in
4,374, ``EACH`` lexicons a level. A fingerprint has four hexadecimal digits for each, sparsest first: a hash of the text's distinct
terms in this lexicon, in order, or zeros without any and, as nothing asks for them, behind the level that brings ``SEEN`` lexicons with
terms. A text none of whose terms is in the band uses all its terms
in its place. ``likeness`` is the share of equal hashes among the ``SEEN`` sparsest lexicons in which one of two texts has a term;
as few terms are left there, it comes near the share of terms that the texts have in common.

Terms are runs of letters, digits, underscores and characters beyond ASCII, with A-Z lower-cased. Null texts count as empty ones; a text without terms has
only zeros, and two of these are alike (1.0). Equal texts have equal fingerprints. Texts are read whole.

``with_next`` goes through the documents in order of id (null ids last, equal ids by the text's digest; equal rows follow each other) and
puts the start of the next document's text in place of the last half of each; the last document is followed by the first. It
deals documents to ranges of ids and gives each range the first document of the following one as well, so that
neighbours meet in one shuffle. Rows equal in id and text are sent once for each task that reads them. An empty table
gives no rows, and columns other than the two named ones are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, partitions, take

#: The band: terms in at most this share of all documents, and in at least that share; terms of a lexicon at most.
COMMON, RARE, LEXICON = 0.05, 0.0002, 1 << 20
#: Probabilities with which lexicons keep a term, sparsest first, and lexicons of each.
RATES = [1 / (2 * 3**k) for k in range(7, -1, -1)]
EACH = 16
SUBSETS = EACH * len(RATES)
#: Hexadecimal digits of a hash.
DIGITS = 4
#: Lexicons that ``likeness`` looks at.
SEEN = 32
#: Terms that a task counts, or keeps hashes of, before it starts anew.
HELD = 400_000
#: Rows that a task gives at once.
ROWS = 500
#: Keys from which the ranges of ``with_next`` are chosen, for each range.
KEYS = 8

_KEPT = bytes(c if c > 127 or chr(c).isalnum() or c == ord("_") else 32 for c in range(256))


def terms(text: str) -> set[bytes]:
    return set(text.encode().lower().translate(_KEPT).split())


def _hash(term: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(term, 7)


def _document_counts(texts: DataFrame) -> DataFrame:
    """(term, n): the number of documents for each hash of a term; a null term counts the documents."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        docs = 0

        def out() -> pa.RecordBatch:
            hashed = np.fromiter(map(_hash, found), np.uint64, len(found)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashed), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

        for b in parts:
            docs += len(b)
            for text in b.column(0).to_pylist():
                found.update(terms(text))
                if len(found) > HELD:
                    yield out()
                    found.clear()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([docs], pa.int64())], names=["term", "n"])

    return cut(texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")))


def _members(hashed: np.ndarray) -> np.ndarray:
    """For each hash of a term a bit for each lexicon that keeps it, in rows of 64."""
    masks = np.zeros((SUBSETS // 64, len(hashed)), np.uint64)
    for j in range(SUBSETS):
        x = hashed + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        kept = (x ^ (x >> np.uint64(31))) < np.uint64(int(RATES[j // EACH] * 2**64))
        masks[j // 64] |= kept.astype(np.uint64) << np.uint64(j % 64)
    return masks


def lexicon(docs: DataFrame, text_col: str = "text", common: float = COMMON, rare: float = RARE, most: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the terms in the band, in order; for each the lexicons that keep it): at most ``most`` of them."""
    counts = _document_counts(take(docs, text=text_col).select(F.coalesce("text", F.lit("")).alias("text")))
    sums = counts.agg(F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("docs"), F.sum(F.when(F.col("term").isNotNull(), F.col("n"))).alias("all")).first()
    least = max(2, int(np.ceil(rare * (sums["docs"] or 0))), -(-(sums["all"] or 0) // most))
    band = counts.where(F.col("term").isNotNull() & (F.col("n") >= least) & (F.col("n") <= max(least, common * (sums["docs"] or 0)))).select("term")
    hashed = np.sort(np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in band.toArrow().to_batches())]).view(np.uint64))
    return hashed, _members(hashed)


def hasher(hashed: np.ndarray, members: np.ndarray) -> Callable[[str], str]:
    """The fingerprint of a text under a lexicon."""
    import xxhash

    known: dict[bytes, int] = {}

    def fingerprint(text: str) -> str:
        if len(known) > HELD:
            known.clear()
        own = []
        for t in terms(text):
            h = known.get(t)
            if h is None:
                h = known[t] = _hash(t)
            own.append(h)
        if not own:
            return "0" * DIGITS * SUBSETS
        all_ = np.sort(np.array(own, np.uint64))
        place = np.minimum(np.searchsorted(hashed, all_), len(hashed) - 1) if len(hashed) else np.zeros(len(all_), np.int64)
        inside = hashed[place] == all_ if len(hashed) else np.zeros(len(all_), bool)
        kept, masks = (all_[inside], members[:, place[inside]]) if inside.any() else (all_, _members(all_))
        some = np.unpackbits(np.bitwise_or.reduce(masks, axis=1).view(np.uint8), bitorder="little")
        levels = int(np.searchsorted(np.cumsum(some.reshape(-1, EACH).sum(axis=1, dtype=np.int64)), SEEN)) + 1
        bits = np.unpackbits(np.ascontiguousarray(masks.T).view(np.uint8)[:, : levels * EACH // 8], axis=1, bitorder="little")
        which, lexicon_of = np.divmod(np.flatnonzero(bits), bits.shape[1])
        order = np.argsort(lexicon_of, kind="stable")
        data, ends = kept[which[order]].tobytes(), np.searchsorted(lexicon_of[order], np.arange(bits.shape[1] + 1)).tolist()
        marks = [f"{xxhash.xxh32_intdigest(data[8 * a : 8 * b]) % 0xFFFF + 1:04x}" if b > a else "0000" for a, b in zip(ends, ends[1:])]
        return "".join(marks).ljust(DIGITS * SUBSETS, "0")

    return fingerprint


def likeness(a: Column, b: Column) -> Column:
    """The share, from 0 to 1, of equal hashes among the sparsest lexicons that hold a term of either text."""
    marks = lambda x: F.regexp_extract_all(x, F.lit("." * DIGITS), F.lit(0))
    nothing = "0" * DIGITS
    same = lambda x, y: F.when((x != nothing) | (y != nothing), x == y)
    seen = F.slice(F.array_compact(F.zip_with(marks(a), marks(b), same)), 1, SEEN)
    share = lambda s: F.when(F.size(s) == 0, 1.0).otherwise(F.size(F.filter(s, lambda x: x)) / F.size(s))
    return F.when(a == b, 1.0).otherwise(F.transform(F.array(seen), share)[0])


def fingerprinted(docs: DataFrame, text_col: str = "text", into: str = "fingerprint", known: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``docs`` with the fingerprint of each text, under the lexicon of these documents or a given one."""
    rest = docs.drop(into)
    at = rest.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(known or lexicon(docs, text_col))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprint = hasher(*shared.value)
        for b in parts:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint(t or "") for t in b.column(at).to_pylist()], pa.string())], names=[*b.schema.names, into])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(into, T.StringType())]))


def _bounds(keys: DataFrame, ranges: int) -> list[tuple]:
    """The first keys of each range, in order: the lowest key, and others from a sample by hash of known size."""
    low = keys.agg(F.min(F.struct("last", "id", "digest")).alias("k"), F.count("*").alias("n")).first()
    if low["k"] is None:
        return []
    some = keys.where(F.pmod(F.xxhash64("id", "digest"), F.lit(max(1, low["n"] // (ranges * KEYS)))) == 0).distinct()
    listed = sorted({_key(*r) for r in some.collect()} - {_key(*low["k"])})
    return [_key(*low["k"]), *(listed[max(1, len(listed) // ranges) - 1 :: max(1, len(listed) // ranges)] if ranges > 1 else [])]


def _key(last: bool, id_: object, digest: str) -> tuple:
    return (last, 0 if last else id_, digest)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint): a row for each document, with its text whose last
    half is replaced by the start of the next document's, and the fingerprints of the text, of that and of the next text."""
    spark = docs.sparkSession
    rows = take(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.col("id").isNull().alias("last"), "id", F.sha2("text", 256).alias("digest"), "text")
    bounds = _bounds(rows.drop("text"), ranges or 4 * partitions(spark))
    lexical = spark.sparkContext.broadcast(lexicon(docs, text_col))
    first = spark.sparkContext.broadcast(bounds)
    kind, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    names = ["range", "extra", "last", "id", "digest", "text", "copies"]
    kinds = [pa.int32(), pa.bool_(), pa.bool_(), id_type, pa.string(), pa.string(), pa.int64()]

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = first.value
        place = {k: j for j, k in enumerate(marks)}
        more: dict[tuple, list] = {}
        for b in parts:
            index, ranges_, extra = [], [], []
            for n, key in enumerate(map(_key, *(b.column(c).to_pylist() for c in range(3)))):
                if key in more:
                    more[key][0] += 1
                    continue
                at = bisect_right(marks, key) - 1
                more[key] = [0, at]
                index.append(n)
                ranges_.append(at)
                extra.append(False)
                if key in place:  # as the last of the range before as well
                    index.append(n)
                    ranges_.append((place[key] - 1) % len(marks))
                    extra.append(True)
            yield pa.RecordBatch.from_arrays([pa.array(ranges_, pa.int32()), pa.array(extra, pa.bool_()), *b.take(pa.array(index, pa.int64())).columns, pa.array([1] * len(index), pa.int64())], names=names)
        again = [(k, v) for k, v in more.items() if v[0]]
        if again:
            columns = [[v[1] for _, v in again], [False] * len(again), [k[0] for k, _ in again], [None if k[0] else k[1] for k, _ in again], [k[2] for k, _ in again], [None] * len(again), [v[0] for _, v in again]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    dealt = rows.mapInArrow(deal, f"range int, extra boolean, last boolean, id {kind}, digest string, text string, copies long")
    order = ["range", "extra", "last", "id", "digest", F.col("text").isNull()]
    sorted_ = dealt.repartition(partitions(spark), "range").sortWithinPartitions(*order)

    given = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint"]

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprint = hasher(*lexical.value)
        done: list[tuple] = []
        held = None  # range, key, id, text, copies, fingerprint

        def give(row: list, text: str, mark: str) -> Iterator[pa.RecordBatch]:
            half = len(row[3]) // 2
            for other, its, copies in [(text, mark, 1), (row[3], row[5], row[4] - 1)]:
                edited = row[3][: len(row[3]) - half] + other[:half]
                one = (row[2], len(row[3]), edited, row[5], fingerprint(edited) if copies else "", its)
                while copies:
                    done.extend([one] * min(copies, ROWS))
                    copies -= min(copies, ROWS)
                    if len(done) >= ROWS:
                        yield out()

        def out() -> pa.RecordBatch:
            columns = zip(*done) if done else [()] * len(given)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, pa.int64(), *[pa.string()] * 4])], names=given)
            done.clear()
            return made

        for b in parts:
            for at, extra, last, id_, digest, text, copies in zip(*(c.to_pylist() for c in b.columns)):
                key = _key(last, id_, digest)
                if held and (held[0], held[1]) == (at, key) and not extra:
                    held[4] += copies
                    continue
                if held is None and extra:  # the same document as in the row before, from another task
                    continue
                mark = fingerprint(text)
                if held:
                    yield from give(held, text, mark)
                held = None if extra else [at, key, id_, text, copies, mark]
        yield out()

    return sorted_.mapInArrow(meet, f"id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, next_fingerprint string")
