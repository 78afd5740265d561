"""Embedding near-duplicates: a robust-pruned flat graph over overlapping cluster shards.

1. Exact copies collapse to one node with a count.
2. Nodes with equal labels are clustered level by level until no shard is above ``SHARD`` nodes. Each level fits
   centroids on a bounded sample of each crowded shard and deals a node to its nearest centroids; over all levels and
   shards a node keeps its ``overlap`` nearest ones only, so copies do not multiply. Dense spots of the sample become
   balls: nodes so near a centre that any two of them are linked for sure (half the angle of the threshold). A ball
   goes on as one node with a radius, so a huge group of near copies is never compared with itself and its links are
   counted, not listed.
3. Every shard builds a graph by robust pruning. A search for each node starts at the shard's medoid (and at the node
   itself), walks greedily, and from the first hits on expands everything within the radius. Hits are verified by the
   exact cosine in double precision. A pair found in several shards counts in the smallest shard that both share.
4. The adjacency lists of a node's shards are united, and the range expansion goes on over edges that leave a shard:
   from a hit of a query to the hit's neighbours that share no shard with the query, until nothing new is within the
   radius. Of the lists only edges of at most twice the radius are of use here: two vectors near the same query are no
   further apart.
5. Where a ball's radius leaves open which members are linked, the members are compared exactly, in blocks.
6. The share of its links that each node of a sample has is audited by brute force, in every round, and returned. Where
   the mean is below ``RECALL`` or one node's share below ``WORST``, the overlap and its margin are doubled once; if that
   is still too little, all pairs of each label are compared, in blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a
label, link with nothing; vectors of different length never link; equal vectors link; repeated rows of a vec_id
count as one vector each; a row without a vec_id links with nothing and has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, take
from .components import components

SHARD = 512
SAMPLE = 1024
OVERLAP = 3
MARGIN = 0.15
DEGREE = 16
BEAM = 12
ALPHA = 1.2
RECALL = 0.98
WORST = 0.5
#: Levels after which nodes go to one cluster only, so that splitting ends.
DEEP = 8
AUDIT = 128


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def clusters(x: np.ndarray, k: int, half: float, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Centres of dense balls (angle ``half``) of a sample, and k centroids of the rest with these centres."""
    balls: list[np.ndarray] = []
    left = np.arange(len(x))
    while len(left):
        near = x[left] @ x[left].T >= np.cos(half)
        count = near.sum(axis=1)
        if count.max() < least:
            break
        centre = x[left][near[count.argmax()]].mean(axis=0)
        centre /= np.sqrt(centre @ centre)
        inside = x[left] @ centre >= np.cos(half)
        if inside.sum() < least:
            break
        balls.append(centre)
        left = left[~inside]
    rest = np.concatenate([x[left], *[b[None] for b in balls]])
    rng = np.random.default_rng(5)
    centres = rest[rng.choice(len(rest), min(k, len(rest)), replace=False)]
    for _ in range(8):
        own = (rest @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rest)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return np.array(balls).reshape(-1, x.shape[1]), centres


def pruned(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[set[int]]:
    """Robust pruning: of a node's candidates, nearest first, each kept one removes those it is alpha times nearer to.
    Edges go both ways."""
    n = len(x)
    far = 1 - x @ x.T
    np.fill_diagonal(far, np.inf)
    c = min(3 * degree, n - 1)
    edges: list[set[int]] = [set() for _ in range(n)]
    if c < 1:
        return edges
    cand = np.argpartition(far, c - 1, axis=1)[:, :c]
    cand = np.take_along_axis(cand, np.take_along_axis(far, cand, 1).argsort(axis=1, kind="stable"), 1)
    dist = np.take_along_axis(far, cand, 1)
    alive, rows = np.ones_like(cand, bool), np.arange(n)
    for _ in range(min(degree, c)):
        first = alive.argmax(axis=1)
        ok = alive[rows, first]
        pick = cand[rows, first]
        for a, b in zip(rows[ok].tolist(), pick[ok].tolist()):
            edges[a].add(b)
            edges[b].add(a)
        alive &= ~(alpha * far[pick[:, None], cand] <= dist)
        alive[rows, first] = False
        if not alive.any():
            break
    return edges


def searched(x: np.ndarray, edges: list[list[int]], radius: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, hit) positions whose angle is at most ``limit`` plus both radii, for every node as a query, in blocks."""
    n = len(x)
    wide = max(1, max(map(len, edges), default=1))
    table = np.full((n, wide), -1)
    for k, e in enumerate(edges):
        table[k, : len(e)] = e
    mean = x.mean(axis=0)
    medoid = int((x @ mean).argmax())
    for lo in range(0, n, 512):
        q = np.arange(lo, min(n, lo + 512))
        m = len(q)
        seen, hit, done = (np.zeros((m, n), bool) for _ in range(3))

        def look(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Unseen (row, node) of a list, with their similarity; marks them seen and those within range as hits."""
            new = (nodes >= 0) & ~seen[rows, nodes]
            flat = np.unique(rows[new] * n + nodes[new])
            rows, nodes = flat // n, flat % n
            seen[rows, nodes] = True
            s = np.einsum("ij,ij->i", x[q[rows]], x[nodes])
            hit[rows, nodes] = _angle(s) <= limit + radius[q[rows]] + radius[nodes] + 1e-7
            return rows, nodes, s

        beam, near = np.full((m, BEAM), -1), np.full((m, BEAM), -np.inf)

        def push(rows: np.ndarray, nodes: np.ndarray, s: np.ndarray) -> None:
            order = np.lexsort((-s, rows))
            rows, nodes, s = rows[order], nodes[order], s[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            k = place < BEAM
            more, sims = np.full((m, BEAM), -1), np.full((m, BEAM), -np.inf)
            more[rows[k], place[k]], sims[rows[k], place[k]] = nodes[k], s[k]
            both, values = np.concatenate([beam, more], axis=1), np.concatenate([near, sims], axis=1)
            best = np.argsort(-values, axis=1, kind="stable")[:, :BEAM]
            beam[:], near[:] = np.take_along_axis(both, best, 1), np.take_along_axis(values, best, 1)

        every = np.arange(m)
        push(*look(np.concatenate([every, every]), np.concatenate([np.full(m, medoid), q])))
        while True:  # greedy walk: each query opens the best node of its beam that is still closed
            shut = (beam >= 0) & ~done[every[:, None], np.maximum(beam, 0)]
            rows = np.flatnonzero(shut.any(axis=1))
            if not len(rows):
                break
            at = beam[rows, shut[rows].argmax(axis=1)]
            done[rows, at] = True
            push(*look(np.repeat(rows, wide), table[at].ravel()))
        while True:  # range expansion: every hit is opened
            rows, nodes = np.nonzero(hit & ~done)
            if not len(rows):
                break
            done[rows, nodes] = True
            look(np.repeat(rows, wide), table[nodes].ravel())
        rows, nodes = np.nonzero(hit)
        keep = q[rows] != nodes
        yield q[rows[keep]], nodes[keep]


def _ranked(place: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest shards of each node."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "shard"))
    return place.groupBy("id", "shard").agg(F.max("sim").alias("sim")).withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def _split(place: DataFrame, points: DataFrame, half: float, overlap: int, margin: float) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """One level: nodes of crowded shards (place: id, shard, sim; points: id, v, n, is_ball) dealt to their clusters.

    Returns places, points and ball members (node, id, gap), or nothing if no shard is crowded. A vector in several
    shards may lie in balls of more than one. It belongs to one of them (the smallest node id), leaves all its shards
    for it, and the ball takes its place in each of them."""
    crowded = cut(place.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > SHARD))
    if crowded.isEmpty():
        return None
    active = place.select("id", "shard").join(crowded, "shard").join(points, "id")
    sample = active.groupBy("shard", "size", F.pmod(F.xxhash64("id"), F.lit(SAMPLE)).alias("slot")).agg(F.min_by("v", "id").alias("v"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(np.clip(-(-4 * rows["size"].iloc[0] // SHARD), 8, 32))
        balls, centres = clusters(_unit(rows.sort_values("slot")["v"]), k, half)
        return pd.DataFrame({"shard": rows["shard"].iloc[0], "balls": [balls.tobytes()], "centres": [centres.tobytes()], "dim": centres.shape[1]})

    models = cut(sample.groupBy("shard").applyInPandas(fit, "shard long, balls binary, centres binary, dim int"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("size") / 2048)).cast("int")
    parts = models.join(crowded, "shard").select("shard", "balls", "centres", "dim", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("id", "shard"), salts).cast("int")).drop("size").groupBy("shard", "salt")

    def deal(key: tuple, rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        """Claims of balls (child -1, near: the angle) and the nearest centroids (child, near: the cosine)."""
        if not len(rows):
            return pd.DataFrame({"id": [], "parent": [], "child": [], "ball": [], "near": []})
        dim = int(model["dim"].iloc[0])
        balls, centres = (np.frombuffer(model[c].iloc[0]).reshape(-1, dim) for c in ("balls", "centres"))
        x, ids = _unit(rows["v"]), rows["id"].to_numpy()
        out = []
        if len(balls):
            s = x @ balls.T
            ok = (s.max(axis=1) >= np.cos(half - 1e-6)) & ~rows["is_ball"].to_numpy(bool)
            out.append(pd.DataFrame({"id": ids, "parent": key[0], "child": -1, "ball": s.argmax(axis=1), "near": _angle(s.max(axis=1))})[ok])
        s = x @ centres.T
        most = max(1, min(overlap, len(centres) // 2))
        order = np.argsort(-s, axis=1, kind="stable")[:, :most]
        near = np.take_along_axis(s, order, 1)
        row, col = np.nonzero(near >= near[:, :1] - margin)
        out.append(pd.DataFrame({"id": ids[row], "parent": key[0], "child": order[row, col], "ball": -1, "near": near[row, col]}))
        return pd.concat(out)

    def centred(rows: pd.DataFrame) -> pd.DataFrame:
        balls = np.frombuffer(rows["balls"].iloc[0]).reshape(-1, int(rows["dim"].iloc[0])).astype(np.float32)
        return pd.DataFrame({"parent": rows["shard"].iloc[0], "ball": np.arange(len(balls)), "v": pd.Series(balls.tolist(), dtype=object)})

    shape = "id long, parent long, child int, ball int, near double"
    ball_id = F.xxhash64(F.lit("ball"), "parent", "ball")
    dealt = lambda found: found.where("child >= 0").select("id", F.xxhash64(F.lit("shard"), "parent", "child").alias("shard"), F.col("near").alias("sim"))
    found = stored(salted(active).cogroup(parts.groupBy("shard", "salt")).applyInPandas(deal, shape), "dealt")
    owners = stored(found.where("child < 0").groupBy("id").agg(F.min(F.struct(ball_id.alias("node"), F.col("near").alias("gap"))).alias("o")).select("id", "o.node", "o.gap"), "owners")
    calm = place.join(crowded.select("shard"), "shard", "left_anti").select("id", "shard", "sim")
    rest = calm.unionByName(dealt(found)).join(owners.select("id"), "id", "left_anti")
    if not owners.isEmpty():
        spots = models.groupBy("shard").applyInPandas(centred, "parent long, ball int, v array<float>").select(ball_id.alias("id"), F.col("v").cast(points.schema["v"].dataType).alias("v"))
        spots = cut(spots.join(owners.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("id", "v", F.lit(0).cast("long").alias("n"), F.lit(True).alias("is_ball")))
        moved = cut(place.join(owners.select("id", "node"), "id").groupBy("shard", F.col("node").alias("id")).agg(F.max("sim").alias("sim")))
        again = salted(moved.select("id", "shard").join(crowded, "shard").join(spots, "id")).cogroup(parts.groupBy("shard", "salt")).applyInPandas(deal, shape)
        rest = rest.unionByName(moved.join(crowded.select("shard"), "shard", "left_anti").select("id", "shard", "sim")).unionByName(dealt(again))
        points = points.join(owners.select("id"), "id", "left_anti").unionByName(spots)
    return stored(_ranked(rest, overlap), "place"), stored(points, "points"), owners.select("node", "id", "gap")


def _links(shards: DataFrame, limit: float) -> DataFrame:
    """(kind, a, b, n) from rows (shard, id, v, n, radius, shards) of each shard.

    0: a has n links more; 1: a and b are linked; 2: members of a and b must be compared; 3: an edge of the graph, at most
    twice the radius long; 4: b is a hit of a and lies in a shard where a is not."""

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, n, r, x = rows["id"].to_numpy(), rows["n"].to_numpy(), rows["radius"].to_numpy(), _unit(rows["v"])
        edges = [sorted(e) for e in pruned(x)]
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        a = np.repeat(np.arange(len(ids)), list(map(len, edges)))
        b = np.fromiter((j for e in edges for j in e), np.int64, len(a))
        near = _angle(np.einsum("ij,ij->i", x[a], x[b])) <= 2 * limit + r[a] + r[b] + 1e-7
        out.append((3, a[near], b[near]))
        homes = rows["shards"].map(np.asarray).tolist()
        single = np.array([len(h) == 1 for h in homes])
        names, inverse = np.unique(np.concatenate(homes), return_inverse=True)
        member = np.zeros((len(ids), len(names)), bool)
        member[np.repeat(np.arange(len(ids)), list(map(len, homes))), inverse] = True
        counts, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
        sures: list[np.ndarray] = []
        for a, b in searched(x, edges, r, limit):
            cosines = np.einsum("ij,ij->i", x[a], x[b])
            angle, slack = _angle(cosines), r[a] + r[b]
            sure = np.where(slack > 0, angle + slack <= limit - 1e-7, cosines >= np.cos(limit))
            maybe = (slack > 0) & ~sure & (angle - slack <= limit + 1e-7)
            hit = sure | maybe
            a, b, sure, maybe = a[hit], b[hit], sure[hit], maybe[hit]
            beyond = (~single[b]).nonzero()[0]
            beyond = beyond[(member[b[beyond]] & ~member[a[beyond]]).any(axis=1)]
            out.append((4, a[beyond], b[beyond]))
            first = np.ones(len(a), bool)
            both = (~single[a] & ~single[b]).nonzero()[0]
            first[both] = names[(member[a[both]] & member[b[both]]).argmax(axis=1)] == key[0]
            np.add.at(counts, a[sure & first], n[b[sure & first]])
            sures.append(np.stack([a[sure], b[sure]]))
            open_ = maybe & first & (ids[a] < ids[b])
            out.append((2, a[open_], b[open_]))
        a, b = np.concatenate([np.zeros((2, 0), np.int64), *sures], axis=1)
        while True:  # the smallest node that each one reaches: one link for each node stands for all
            before = low.copy()
            np.minimum.at(low, a, low[b])
            if (before == low).all():
                break
        tied = np.flatnonzero(low < np.arange(len(ids)))
        out.append((1, tied, low[tied]))
        frames = [pd.DataFrame({"kind": k, "a": ids[i], "b": ids[j], "n": 0}) for k, i, j in out]
        some = np.flatnonzero(counts)
        return pd.concat([*frames, pd.DataFrame({"kind": 0, "a": ids[some], "b": ids[some], "n": counts[some]})])

    return stored(shards.groupBy("shard").applyInPandas(search, "kind int, a long, b long, n long"), "links")


def _across(found: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """(kind, a, b): pairs (a < b) that share no shard, found by range expansion over the united adjacency lists;
    kind as in ``_links``. ``nodes``: (id, v, radius, shards)."""
    edges = stored(found.where("kind = 3").select(F.col("a").alias("hit"), F.col("b").alias("c")).distinct(), "edges")
    front = found.where("kind = 4").select(F.col("a").alias("q"), F.col("b").alias("hit")).distinct()
    side = lambda name: nodes.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("v", "radius", "shards")])

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            if len(rows):
                c = np.einsum("ij,ij->i", _unit(rows["v_a"]), _unit(rows["v_b"]))
                slack, angle = (rows["radius_a"] + rows["radius_b"]).to_numpy(), _angle(c)
                sure = np.where(slack > 0, angle + slack <= limit - 1e-7, c >= np.cos(limit))
                maybe = (slack > 0) & ~sure & (angle - slack <= limit + 1e-7)
                yield pd.DataFrame({"kind": np.where(sure, 1, 2), "a": rows["a"], "b": rows["b"]})[sure | maybe]

    every: DataFrame | None = None
    while True:
        pairs = front.join(edges, "hit").where("q != c").select(F.least("q", "c").alias("a"), F.greatest("q", "c").alias("b")).distinct()
        if every is not None:
            pairs = pairs.join(every.select("a", "b"), ["a", "b"], "left_anti")
        far = pairs.join(side("a"), "a").join(side("b"), "b").where(~F.arrays_overlap("shards_a", "shards_b"))
        new = stored(far.select("a", "b", "v_a", "v_b", "radius_a", "radius_b").mapInPandas(verify, "kind int, a long, b long"), "across")
        if new.isEmpty():
            return new if every is None else every
        front = new.select(F.col("a").alias("q"), F.col("b").alias("hit")).union(new.select("b", "a"))
        every = new if every is None else stored(every.unionByName(new), "across")


def _compared(pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """(id, node_a, node_b, n): exact links between the members of two nodes, counted for each member, in blocks."""
    size = 512
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    total = members.groupBy("node").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("blocks"))
    inside = members.join(total, "node").withColumn("block", block)
    sides = pairs.join(total.select(F.col("node").alias("a"), F.col("blocks").alias("na")), "a").join(total.select(F.col("node").alias("b"), F.col("blocks").alias("nb")), "b")
    cells = sides.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ka"), "nb").select("a", "b", "ka", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("kb"))
    pick = lambda n, k: cells.join(inside.select(F.col("node").alias(n), F.col("block").alias(k), "id", "v", "n"), [n, k]).select("a", "b", "ka", "kb", "id", "v", "n")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "a": [], "b": [], "n": []}).astype("int64")
        hit = _unit(x["v"]) @ _unit(y["v_"]).T >= cosine
        out = pd.DataFrame({"id": np.concatenate([x["id"], y["id_"]]), "n": np.concatenate([hit @ y["n_"].to_numpy(), x["n"].to_numpy() @ hit])})
        return out[out["n"] > 0].assign(a=x["a"].iloc[0], b=x["b"].iloc[0])[["id", "a", "b", "n"]]

    keys = ["a", "b", "ka", "kb"]
    other = pick("b", "kb")
    other = other.select(*[F.col(c).alias(f"{c}_") for c in other.columns])
    return pick("a", "ka").groupBy(*keys).cogroup(other.groupBy(*[f"{k}_" for k in keys])).applyInPandas(compare, "id long, a long, b long, n long")


def _audited(nodes: DataFrame, found: DataFrame, cosine: float) -> tuple[float, float]:
    """Mean and smallest share of its links that a vector has, of at most AUDIT vectors with links, by brute force."""
    picked = nodes.groupBy(F.pmod(F.xxhash64("id"), F.lit(AUDIT)).alias("slot")).agg(F.min_by(F.struct("id", "shard", "v"), F.xxhash64("id", F.lit(1))).alias("q")).select("q.*").collect()
    if not picked:
        return 1.0, 1.0
    ids, labels = np.array([p["id"] for p in picked]), np.array([p["shard"] for p in picked])
    sides = {k: _unit(pd.Series([p["v"] for p in picked if p["shard"] == k])) for k in set(labels.tolist())}
    shared = nodes.sparkSession.sparkContext.broadcast((ids, labels, sides))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, sides = shared.value
        for rows in parts:
            for label, own in rows.groupby("shard"):
                if label in sides:
                    hit = sides[label] @ _unit(own["v"]).T >= cosine
                    mine = ids[labels == label]
                    hit &= mine[:, None] != own["id"].to_numpy()[None]
                    yield pd.DataFrame({"id": mine, "true": hit @ own["n"].to_numpy()})

    true = nodes.select("shard", "id", "v", "n").mapInPandas(count, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    right, n = F.col("true"), F.coalesce("n", F.lit(0))
    share = true.where(F.col("true") > 0).join(found, "id", "left").select((F.least(right, n) / F.greatest(right, n)).alias("share"))
    got = share.agg(F.avg("share").alias("mean"), F.min("share").alias("worst")).first()
    return (1.0, 1.0) if got["mean"] is None else (got["mean"], got["worst"])


def _exact(nodes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(id, n) and links (a, b) of all pairs of each label, in blocks."""
    total = nodes.groupBy("shard").agg(F.ceil(F.count("*") / 1024).cast("int").alias("blocks"))
    inside = nodes.join(total, "shard").withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks"))).select("shard", "block", "id", "v", "n")
    cells = total.select("shard", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("ka")).select("shard", "ka", F.explode(F.sequence(F.col("ka"), F.col("blocks") - 1)).alias("kb"))
    pick = lambda k: inside.withColumnRenamed("block", k).join(cells, ["shard", k])

    def compare(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        hit = _unit(x["v"]) @ _unit(y["v_"]).T >= cosine
        a, b = x["id"].to_numpy(), y["id_"].to_numpy()
        hit &= a[:, None] != b[None]
        sides = [(a, hit @ y["n_"].to_numpy())] + ([] if key[1] == key[2] else [(b, x["n"].to_numpy() @ hit)])
        out = [pd.DataFrame({"a": i, "b": i, "n": n})[n > 0] for i, n in sides]
        low = np.where(hit.any(axis=0), b, np.iinfo(np.int64).max)  # smallest id that a column reaches within the block
        while True:
            left = np.where(hit, low[None], np.iinfo(np.int64).max).min(axis=1)
            left = np.minimum(left, a)
            less = np.minimum(low, np.where(hit, left[:, None], np.iinfo(np.int64).max).min(axis=0))
            if (less == low).all():
                break
            low = less
        for ids, to, ok in ((a, left, hit.any(axis=1)), (b, low, hit.any(axis=0))):
            out.append(pd.DataFrame({"a": ids, "b": to, "n": 0})[ok & (ids != to)])
        return pd.concat(out)

    other = pick("kb").select(F.col("shard").alias("shard_"), F.col("ka").alias("ka_"), F.col("kb").alias("kb_"), F.col("id").alias("id_"), F.col("v").alias("v_"), F.col("n").alias("n_"))
    found = stored(pick("ka").groupBy("shard", "ka", "kb").cogroup(other.groupBy("shard_", "ka_", "kb_")).applyInPandas(compare, "a long, b long, n long"), "exact")
    return found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), found.where("a != b").select("a", "b")


def groups(df: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", overlap: int = OVERLAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) for every row; the last is the mean share of its links that a
    vector of the audit's sample has."""
    limit = float(np.arccos(cosine))
    rows = take(df, vec_id=id_col, v=vector_col, label=label_col)
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    fine &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    real = "array<float>" if "float" in rows.schema["v"].dataType.simpleString() else "array<double>"  # as given: half the bytes
    keyed = rows.select("vec_id", F.col("v").cast(real).alias("v"), F.when(fine, F.xxhash64("label", F.size("v"))).alias("shard")).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    valid = keyed.where(F.col("shard").isNotNull() & F.col("vec_id").isNotNull())
    nodes = stored(valid.groupBy("shard", "h1", "h2").agg(F.min("vec_id").alias("id"), F.first("v").alias("v"), F.count("*").alias("n")), "vectors")

    margin = MARGIN
    while True:
        place, points = nodes.select("id", "shard", F.lit(1.0).alias("sim")), nodes.select("id", "v", "n", F.lit(False).alias("is_ball"))
        members = nodes.limit(0).select(F.col("id").alias("node"), "id", F.lit(0.0).alias("gap"))
        level = 0
        while (more := _split(place, points, limit / 2, overlap if level < DEEP else 1, margin)) is not None:
            place, points, level = more[0], more[1], level + 1
            members = members.unionByName(more[2])
        members = stored(members.join(nodes.select("id", "n"), "id"), "members")
        balls = cut(members.groupBy("node").agg(F.min("id").alias("lead"), F.sum("n").alias("total"), F.max("gap").alias("radius")))
        homes = place.groupBy("id").agg(F.collect_set("shard").alias("shards"))
        whole = points.join(homes, "id").join(balls, points["id"] == balls["node"], "left")
        whole = stored(whole.select(F.coalesce("lead", "id").alias("id"), "v", F.coalesce("total", "n").alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius"), "shards"), "points")
        found = _links(whole.select(F.explode("shards").alias("shard"), "*"), limit)
        beyond = cut(_across(found, whole, limit))
        inside = members.join(balls, "node").select(F.col("lead").alias("node"), "id", "n", "total")
        counts = found.where("kind = 0").select(F.col("a").alias("node"), "n")
        sure = beyond.where("kind = 1")
        sizes = whole.select("id", "n")
        for one, other in (("a", "b"), ("b", "a")):
            counts = counts.unionByName(sure.join(sizes, sure[other] == sizes["id"]).select(F.col(one).alias("node"), "n"))
        counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
        links = found.where("kind = 1").select("a", "b").union(sure.select("a", "b"))
        extra = None
        unsure = cut(found.where("kind = 2").select("a", "b").union(beyond.where("kind = 2").select("a", "b")).distinct())
        if not unsure.isEmpty():
            alone = nodes.join(inside.select("id"), "id", "left_anti").select(F.col("id").alias("node"), "id", "v", "n")
            grouped = inside.select("node", "id").join(nodes.select("id", "v", "n"), "id").select("node", "id", "v", "n")
            extra = stored(_compared(unsure, grouped.unionByName(alone), cosine), "compared")
            links = links.union(extra.select("a", "b").distinct())
        place = nodes.select("id", F.col("n").alias("own")).join(inside.select("id", F.col("node").alias("ball"), "total"), "id", "left").withColumn("node", F.coalesce("ball", "id"))
        place = place.join(counts, "node", "left")
        if extra is not None:
            place = place.join(extra.groupBy("id").agg(F.sum("n").alias("more")), "id", "left")
        else:
            place = place.withColumn("more", F.lit(0))
        place = stored(place.select("id", "node", "own", (F.coalesce("total", "own") - F.col("own") + F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n")), "place")
        mean, worst = _audited(nodes, place.select("id", "n"), cosine)
        if mean >= RECALL and worst >= WORST:
            break
        if overlap >= 2 * OVERLAP:
            counts, links = _exact(nodes, cosine)
            place = nodes.select("id", F.col("id").alias("node"), F.col("n").alias("own")).join(counts, "id", "left").select("id", "node", "own", F.coalesce("n", F.lit(0)).alias("n"))
            mean = 1.0
            break
        overlap, margin = 2 * overlap, 2 * margin
    group = components(links, "a", "b")
    classes = cut(place.join(group, place["node"] == group["node"], "left").select("id", (F.col("own") - 1 + F.col("n")).alias("n_links"), F.coalesce("component", place["node"]).alias("component_id")))
    named = cut(nodes.select("id", "shard", "h1", "h2").join(classes, "id"))
    out = keyed.select("vec_id", "shard", "h1", "h2").join(named.drop("id"), ["shard", "h1", "h2"], "left")
    own = F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(own, F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).withColumn("audited_recall", F.lit(float(mean)))
