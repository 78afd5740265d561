"""Best-fit packing of token sequences by minimum bin slack.

A packing only depends on how many pieces there are of each length, and lengths are at most the capacity. So the
pieces are counted by length on Spark (at most ``capacity`` rows reach the driver, whatever the input), and the
bins are planned on these counts: for each bin, the longest remaining length is set, a bitset subset-sum finds
the fullest sum of further available lengths that fits, and this pattern is removed as often as the counts allow.
Each pattern uses up a length, so the plan stays small too. Pieces then get their place: the pieces of a length
are numbered on Spark, in salted parts so that a common length is no hot group, and the number says in which
repeat of which pattern the piece lies.

Defined results: a null text counts as empty and gives one piece with the end token only; only documents longer
than the capacity are cut; equal texts are packed each on their own; an empty table gives no rows; columns of ``items``
may have any names, but ones named ``sequence_id`` and ``offset`` give way to ours.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, portions
from .common import stored, take


#: Pieces for each salt; a length that all pieces share is numbered in groups of about so many rows.
PART = 200_000


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and end token."""
    end = end_id.to_bytes(4, "little")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in parts:
            for s in portions(b, 1):
                who, rows = [], []
                for k, x in enumerate(enc.encode_batch(s.column(1).to_pylist())):
                    ids = memoryview(x + end)
                    for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        who.append(k)
                        rows.append((n, start // 4, len(part) // 4, zlib.crc32(part)))
                cols = np.array(rows, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(pa.array(who, pa.int64())), pa.array(cols[:, 0].astype(np.int32)), *[pa.array(np.ascontiguousarray(cols[:, k])) for k in (1, 2, 3)]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        enc.release()

    rows = take(df, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times): a choice of available lengths with the largest sum of at most ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        left = min(counts[length], room // length)
        times = 1
        while left > 0:
            times = min(times, left)
            new = (reach << (times * length)) & mask & ~reach
            if new:
                steps.append((length, times, new))
                reach |= new
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, times, new in reversed(steps):
        if new >> total & 1:
            chosen[length] = chosen.get(length, 0) + times
            total -= times * length
    return list(chosen.items())


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """([(length, times)], repeats): the bins that use up all counts of the histogram."""
    counts = {k: n for k, n in histogram.items() if n}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        room = capacity - first
        chosen = dict(fullest([k for k in lengths if k <= room and counts[k]], counts, room)) if room else {}
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        repeats = min(counts[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            counts[k] -= n * repeats
        out.append((sorted(chosen.items(), reverse=True), repeats))
        lengths = [k for k in lengths if counts[k]]
    return out


def pack(items: DataFrame, capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """``items`` (a stored table with a length from 1 to ``capacity`` in each row) with sequence_id and offset."""
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset")
    columns, where = items.columns, items.columns.index(length_col)
    names = [f"c{k}" for k in range(len(columns))]  # names of our own, whatever the caller's are
    plain = items.toDF(*names)
    length, keys = f"c{where}", [f"c{k}" for k in range(len(columns)) if k != where]
    salts = max(8, -(-items.count() // PART))
    dealt = plain.withColumn("salt", F.pmod(F.xxhash64(*keys) if keys else F.xxhash64(length, F.monotonically_increasing_id()), F.lit(salts)))
    if not keys:
        dealt = stored(dealt, "dealt")
    counts = stored(dealt.groupBy(F.col(length).alias("length"), F.col("salt").alias("part")).agg(F.count("*").alias("n")), "lengths")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(length, "salt").orderBy(*(keys or [length]))
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1)
    ranked = ranked.join(offsets, (F.col(length) == F.col("length")) & (F.col("salt") == F.col("part")))
    ranked = ranked.select(*names, (F.col("rank") + F.col("before")).alias("rank"))

    used: dict[int, int] = {}
    slots, first = [], 0
    for chosen, repeats in plan(histogram, capacity):
        at = 0
        for length, times in chosen:
            slots.append((length << 44 | used.get(length, 0), times, first, at, used.get(length, 0)))
            used[length] = used.get(length, 0) + times * repeats
            at += length * times
        first += repeats
    table = spark.sparkContext.broadcast(np.array(sorted(slots), np.int64).reshape(-1, 5))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in parts:
            length, rank = b.column(where).to_numpy(zero_copy_only=False).astype(np.int64), b.column(len(columns)).to_numpy(zero_copy_only=False)
            k = np.searchsorted(t[:, 0], length << 44 | rank, side="right") - 1
            own = rank - t[k, 4]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(columns)], pa.array(t[k, 2] + own // t[k, 1]), pa.array(t[k, 3] + own % t[k, 1] * length)], names=[*names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema).toDF(*columns, "sequence_id", "offset")


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return pack(stored(pieces(df, path, id_col, text_col, capacity, end_id), "pieces"), capacity)
