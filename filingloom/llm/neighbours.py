"""Problem 2: the most similar vectors for every vector.

Vectors are projected by a few random Gaussian (2-stable) directions and indexed by kd-trees over the projections, whose
upper levels are the partitioning of the cluster and whose lower levels are built in each partition. In its leaf a vector
meets the others in the order of projected distance; verifying stops when a chi-square test holds: had a vector as close
as the bound (or as the k-th best so far) not been met yet, its projected distance would have been smaller with high
probability. Several trees with other directions make up for neighbours that a cut of one tree parts.

That needs a bound of close vectors. Without one the k best may be as far apart as most vectors of one subject, and neither
projections nor trees tell such distances: there vectors are parted into cells around centroids, and each is compared with
all vectors of the cells that are nearest to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingloom.plans.scratch import materialise

DIM, K = 64, 5
#: Projected dimensions of a tree, vectors in a leaf, and vectors that the upper levels are fitted on at least.
DIRECTIONS, LEAF, SAMPLE = 8, 2048, 32_768
#: Upper levels at most, which are broadcast and fitted on ``PER_CELL`` vectors for each cell; what is below is cut in its task,
#: by exact medians. With 16,384 cells a task gets 61,000 of a milliard vectors, and the cuts of a tree are 64 KB.
UPPER = 14
#: Probability with which a close enough vector has a projected distance inside the tested one.
CONFIDENCE = 0.995
#: Share of close pairs that no tree brings together, from which the number of trees follows.
LOSS = 0.01
#: Least bound that the trees are made for; below it, or without one, cells are searched.
CLOSE = 0.9
#: Vectors in a cell, cells that a vector visits (up to which the search is exact), and vectors of the sample for each cell.
CELL, VISITS, PER_CELL = 16_384, 8, 32


def chi_square_quantile(p: float, dof: int) -> float:
    """By bisection on the regularised incomplete gamma function's series."""

    def cdf(x: float) -> float:
        a, x = dof / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-12:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    lo, hi = 1e-9, 100.0 + 10 * dof
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def directions(tree: int, dim: int, count: int, seed: int = 7) -> np.ndarray:
    """``count`` Gaussian directions of one tree; the same on every executor."""
    return np.random.default_rng([seed, tree]).standard_normal((dim, count)).astype(np.float32)


def fit_cuts(points: np.ndarray, depth: int) -> list[np.ndarray]:
    """Medians of a kd-tree of ``depth`` levels over projected points, level by level, the dimensions in turn."""
    cell = np.zeros(len(points), np.int64)
    cuts = []
    for level in range(depth):
        x = points[:, level % points.shape[1]]
        medians = np.zeros(1 << level, np.float32)
        order = np.lexsort((x, cell))
        ends = np.searchsorted(cell[order], np.arange((1 << level) + 1))
        for c in range(1 << level):
            if ends[c + 1] > ends[c]:
                medians[c] = x[order[(ends[c] + ends[c + 1]) // 2]]
        cuts.append(medians)
        cell = 2 * cell + (x >= medians[cell])
    return cuts


def cells(points: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The leaf of each point."""
    cell = np.zeros(len(points), np.int64)
    for level, medians in enumerate(cuts):
        cell = 2 * cell + (points[:, level % points.shape[1]] >= medians[cell])
    return cell


def kept_at(distance: float, depth: int) -> float:
    """Probability that two unit vectors so far apart stay in one cell: each median cut parts them with the probability
    that one lies between, for projections of unit variance."""
    return max(1e-3, 1 - 0.8 * distance * 0.4) ** depth


def trees_needed(depth: int, distance: float, loss: float = LOSS) -> int:
    return max(1, math.ceil(math.log(loss) / math.log(1 - min(0.999, kept_at(distance, depth)))))


def search_leaf(unit: np.ndarray, low: np.ndarray, k: int, min_cos: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, cosine): for each row its k best of the leaf with at least ``min_cos``.

    The projected distances of a leaf come from one product. A row's candidates are verified in their order, in steps
    that double, until the projected distance of the next exceeds what the chi-square test allows at the bound.
    """
    n, m = low.shape
    quantile = chi_square_quantile(CONFIDENCE, m)
    reach = (2 - 2 * min_cos) * quantile
    norms = (low * low).sum(1)
    rows, cols, sims = [], [], []
    for a in range(0, n, 512):
        b = min(n, a + 512)
        d2 = norms[a:b, None] + norms[None, :] - 2 * low[a:b] @ low.T
        d2[np.arange(b - a), np.arange(a, b)] = np.inf
        i, j = np.nonzero(d2 <= reach)
        if not len(i):
            continue
        order = np.lexsort((d2[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, np.arange(b - a))
        rank = np.arange(len(i)) - first[i]
        best = np.full((b - a, k), -1.0, np.float32)
        step, done, open_ = 4 * k, 0, np.ones(b - a, bool)
        while True:
            take = (rank >= done) & (rank < step) & open_[i]
            if not take.any():
                break
            r, c = i[take], j[take]
            cos = np.einsum("ij,ij->i", unit[a + r], unit[c])
            good = cos >= min_cos
            rows.append(a + r[good])
            cols.append(c[good])
            sims.append(cos[good])
            if good.any():
                rr, cc = r[good], cos[good]
                o = np.lexsort((-cc, rr))
                rr, cc = rr[o], cc[o]
                p = np.arange(len(rr)) - np.searchsorted(rr, rr)
                held = p < k
                new = np.full((b - a, k), -1.0, np.float32)
                new[rr[held], p[held]] = cc[held]
                best = -np.sort(-np.concatenate([best, new], axis=1), axis=1)[:, :k]
            # stop where even the next projected distance is beyond what the k-th best allows
            last = np.minimum(first + step, np.searchsorted(i, np.arange(b - a), side="right")) - 1
            has = last >= first
            seen = np.zeros(b - a)
            seen[has] = d2[np.nonzero(has)[0], j[last[has]]]
            limit = np.where(best[:, -1] > min_cos, (2 - 2 * best[:, -1]) * quantile, reach)
            open_ &= ~(has & (seen > limit))
            done, step = step, 2 * step
    if not rows:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.float32)
    r, c, s = np.concatenate(rows), np.concatenate(cols), np.concatenate(sims)
    o = np.lexsort((c, -s, r))
    r, c, s = r[o], c[o], s[o]
    held = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[held], c[held], s[held]


def usable(df: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """(id, v) of the distinct rows whose vector has ``dim`` finite numbers, not all zero; a null key has no row."""
    v = F.col(vector).cast("array<float>")
    ok = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), v.alias("v")).where(ok)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [np.asarray(p.flatten().to_numpy(zero_copy_only=False), np.float32) for p in parts]
    return np.concatenate(flat).reshape(-1, dim) if flat else np.empty((0, dim), np.float32)


def _units(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest number first, so that no square overflows."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids of unit length of at most ``count`` cells, by spherical k-means from vectors of the sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        total = np.zeros((len(centres), sample.shape[1]))
        np.add.at(total, home, sample)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 1e-6, total / np.maximum(length, 1e-6), centres).astype(np.float32)
    return centres


def visited(unit: np.ndarray, centres: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, and the ``visits`` cells nearest to it, its own among them."""
    homes, cells_ = [], []
    for a in range(0, len(unit), 4096):
        sims = unit[a : a + 4096] @ centres.T
        near = np.argpartition(-sims, visits - 1, axis=1)[:, :visits] if visits < len(centres) else np.tile(np.arange(len(centres)), (len(sims), 1))
        homes.append(near[np.arange(len(near)), np.take_along_axis(sims, near, 1).argmax(axis=1)])
        cells_.append(near)
    return np.concatenate(homes), np.concatenate(cells_)


def best_of_cell(asking: np.ndarray, unit: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, cosine): for each asking vector the ``k`` most similar of ``unit`` but ``own``, its own place or -1.

    The k best stand in the k stripes of the greatest maxima, so only these are sorted.
    """
    n = len(unit)
    stripes = max(k, n // 64)
    deep = -(-n // stripes)
    padded = np.concatenate([unit, np.zeros((deep * stripes - n, unit.shape[1]), np.float32)])
    rows, cols, sims = [], [], []
    for a in range(0, len(asking), 512):
        cos = asking[a : a + 512] @ padded.T
        cos[:, n:] = -2
        at = np.flatnonzero(own[a : a + 512] >= 0)
        cos[at, own[a + at]] = -2
        top = cos.reshape(len(cos), deep, stripes).max(axis=1)
        stripe = np.argpartition(-top, k - 1, axis=1)[:, :k] if k < stripes else np.tile(np.arange(stripes), (len(cos), 1))
        place = (stripe[:, None, :] + stripes * np.arange(deep)[None, :, None]).reshape(len(cos), -1)
        value = np.take_along_axis(cos, place, 1)
        best = np.argpartition(-value, k - 1, axis=1)[:, :k] if k < value.shape[1] else np.tile(np.arange(value.shape[1]), (len(cos), 1))
        value, place = np.take_along_axis(value, best, 1), np.take_along_axis(place, best, 1)
        i, j = np.nonzero(value > -1.5)
        rows.append(a + i)
        cols.append(place[i, j])
        sims.append(value[i, j])
    if not rows:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.float32)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(sims)


def _met_in_cells(classes: DataFrame, total: int, k: int, dim: int, cell: int, visits: int) -> DataFrame:
    """(cls, other, cos): the k best of each class in each cell that it visits.

    A cell in which more meet than planned is tiled: its vectors in some pieces, those that ask in others, each piece of
    the one with each of the other, so that no task gets them all and no pair is left out.
    """
    count = max(1, math.ceil(total / cell))
    share = min(1.0, max(4096, PER_CELL * count) / max(1, total))
    table = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1_000_003)) < math.ceil(1_000_003 * share)).orderBy("cls").select("u").toArrow()
    sample = np.frombuffer(b"".join(table.column("u").to_pylist()), np.float32).reshape(-1, dim)
    centres = fit_centroids(sample, count) if len(sample) else np.zeros((1, dim), np.float32)
    visits = min(visits, len(centres))
    home, near = visited(sample, centres, visits) if len(sample) else (np.zeros(0, int), np.zeros((0, 1), int))
    scale = total / max(1, len(sample))
    held = np.maximum(1, np.ceil(np.bincount(home, minlength=len(centres)) * scale / (2 * cell))).astype(np.int64)
    asked = np.maximum(1, np.ceil(np.bincount(near.ravel(), minlength=len(centres)) * scale / (4 * cell))).astype(np.int64)
    index = classes.sparkSession.sparkContext.broadcast((centres, held, asked))  # dim + 2 numbers a cell

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, held, asked = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cls = batch.column("cls").to_numpy()
            u = np.frombuffer(b"".join(batch.column("u").to_pylist()), np.float32).reshape(-1, dim)
            home, near = visited(u, centres, visits)
            mixed = (cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for asks, to in [(False, home)] + [(True, near[:, v]) for v in range(near.shape[1])]:
                own, other = (asked, held) if asks else (held, asked)
                times = np.repeat(np.arange(len(to)), other[to])
                with_ = np.arange(len(times)) - np.repeat(np.cumsum(other[to]) - other[to], other[to])
                mine, t = mixed[times] % own[to[times]], to[times]
                tile = with_ * held[t] + mine if not asks else mine * held[t] + with_
                for a in range(0, len(times), 16_384):
                    r = times[a : a + 16_384]
                    yield pa.RecordBatch.from_arrays([pa.array((t[a : a + 16_384] << 32) + tile[a : a + 16_384]), pa.array(np.full(len(r), asks)), pa.array(cls[r]), batch.column("u").take(pa.array(r))], ["cell", "asks", "cls", "u"])

    def search(table: pa.Table) -> pa.Table:
        asks, cls = table.column("asks").to_numpy(), table.column("cls").to_numpy()
        u = np.frombuffer(b"".join(table.column("u").to_pylist()), np.float32).reshape(-1, dim)
        mine, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(mine) or not len(ask):
            return pa.table({"cls": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "cos": pa.array([], pa.float32())})
        mine = mine[np.argsort(cls[mine])]
        at = np.minimum(np.searchsorted(cls[mine], cls[ask]), len(mine) - 1)
        r, c, s = best_of_cell(u[ask], u[mine], np.where(cls[mine[at]] == cls[ask], at, -1), k)
        return pa.table({"cls": cls[ask[r]], "other": cls[mine[c]], "cos": s})

    placed = classes.mapInArrow(place, "cell long, asks boolean, cls long, u binary")
    return placed.groupBy("cell").applyInArrow(search, "cls long, other long, cos float")


def _met_in_trees(classes: DataFrame, total: int, k: int, min_cos: float, dim: int, leaf: int, upper: int) -> DataFrame:
    """(cls, other, cos): the k best of each class in its leaf of each tree, with at least ``min_cos``."""
    depth = max(0, math.ceil(math.log2(max(1, total) / leaf)))
    trees = trees_needed(depth, math.sqrt(2 - 2 * min_cos) * 0.75)
    upper = min(depth, upper)
    wanted = max(SAMPLE, PER_CELL << upper)
    sample = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1_000_003)) < math.ceil(1_000_003 * min(1.0, wanted / max(1, total)))).select("u").limit(2 * wanted).toArrow()
    fitted = np.frombuffer(b"".join(sample.column("u").to_pylist()), np.float32).reshape(-1, dim)
    shape = [(directions(t, dim, DIRECTIONS), fit_cuts(fitted @ directions(t, dim, DIRECTIONS), upper)) for t in range(trees)]
    index = classes.sparkSession.sparkContext.broadcast(shape)  # DIRECTIONS * dim and fewer than 2 ** UPPER numbers for each tree

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = np.frombuffer(b"".join(batch.column("u").to_pylist()), np.float32).reshape(-1, dim)
            for t, (axes, cuts) in enumerate(index.value):
                cell = cells(u @ axes, cuts) + (t << 40)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("cls"), batch.column("u")], ["cell", "cls", "u"])

    def search(table: pa.Table) -> pa.Table:
        cls = table.column("cls").to_numpy()
        u = np.frombuffer(b"".join(table.column("u").to_pylist()), np.float32).reshape(-1, dim)
        low = u @ index.value[int(table.column("cell")[0].as_py()) >> 40][0]
        out = []
        # cells larger than planned are cut further, by exact medians
        extra = max(0, math.ceil(math.log2(len(u) / (2 * leaf)))) if len(u) > 2 * leaf else 0
        part = cells(low, fit_cuts(low, extra)) if extra else np.zeros(len(u), np.int64)
        for p in range(1 << extra):
            own = np.nonzero(part == p)[0]
            if len(own) > 1:
                r, c, s = search_leaf(u[own], low[own], k, min_cos)
                out.append((cls[own[r]], cls[own[c]], s))
        a, b, s = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        return pa.table({"cls": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "cos": pa.array(s, pa.float32())})

    placed = classes.mapInArrow(place, "cell long, cls long, u binary")
    return placed.groupBy("cell").applyInArrow(search, "cls long, other long, cos float")


def nearest(df: DataFrame, key: str, vector: str, k: int = K, min_cos: float | None = 0.9, dim: int = DIM, leaf: int = LEAF, cell: int = CELL, visits: int = VISITS, upper: int = UPPER) -> DataFrame:
    """(id, neighbour, cos): for every usable vector its ``k`` most similar with at least ``min_cos`` (ties: the smaller id).

    Without ``min_cos`` the k most similar, however far. Trees find those of a bound of ``CLOSE`` or more, cells all others.

    Vectors of one direction are one class, represented by its smallest id: the index holds classes, so copies of one
    vector never meet in a task, and of each class the k+1 smallest ids are enough for everyone's k best.
    """
    rows = usable(df.select(key, vector), key, vector, dim)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _units(_matrix(batch.column("v"), dim))
            near = np.ascontiguousarray(np.round(unit, 5) + 0.0)
            packed = pa.array([x.tobytes() for x in unit], pa.binary())
            cls = pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in near], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), cls, packed], ["id", "cls", "u"])

    kind = rows.schema["id"].dataType.simpleString()
    units = rows.mapInArrow(direct, f"id {kind}, cls long, u binary")
    members = materialise(units.distinct(), "vectors")
    ranked = members.select("cls", "id").withColumn("rank", F.row_number().over(W.partitionBy("cls").orderBy("id"))).where(F.col("rank") <= k + 1)
    few = materialise(ranked, "class-members")
    classes = members.join(few.where("rank = 1").select("cls", "id"), ["cls", "id"]).select("cls", "u")

    total = few.where("rank = 1").count()
    if min_cos is not None and min_cos >= CLOSE:
        met = _met_in_trees(classes, total, k, min_cos, dim, leaf, upper)
    else:
        met = _met_in_cells(classes, total, k, dim, cell, visits).where(F.col("cos") >= (-2.0 if min_cos is None else min_cos))
    met = met.groupBy("cls", "other").agg(F.max("cos").alias("cos"))
    best = met.withColumn("r", F.row_number().over(W.partitionBy("cls").orderBy(F.desc("cos"), "other"))).where(F.col("r") <= k).drop("r")
    own = few.select("cls", F.col("cls").alias("other"), F.lit(1.0).cast("float").alias("cos")).distinct()
    linked = best.unionByName(own)
    # every member of a class has the same neighbours, but for itself
    options = linked.join(few.select(F.col("cls").alias("other"), F.col("id").alias("neighbour")), "other")
    topped = options.withColumn("r", F.row_number().over(W.partitionBy("cls").orderBy(F.desc("cos"), "neighbour"))).where(F.col("r") <= k + 1)
    pairs = members.select("cls", "id").join(topped.select("cls", "neighbour", "cos"), "cls").where("id <> neighbour")
    final = pairs.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("cos"), "neighbour"))).where(F.col("r") <= k)
    return final.select("id", "neighbour", "cos")


def similar_pairs(df: DataFrame, key: str, vector: str, k: int = K, min_cos: float = 0.9) -> DataFrame:
    """(id_a, id_b) of different rows of which one is among the other's ``k`` nearest, the smaller id first."""
    found = nearest(df, key, vector, k, min_cos)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
