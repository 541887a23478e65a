"""Problem 1: near-duplicate records with small edits.

The tokens of a record are its distinct runs of three words. They are hashed into groups; a record's group counts are a
point, and the sum of the coordinate minima of two points bounds how many tokens the records share. The points are indexed
in R-trees, whose boxes keep coordinate maxima, so one bound rules out whole boxes; pairs that survive are verified.

Nothing is lost on the way, whatever the data:

* Tokens are parted by hash into blocks. If all tokens of two records agree to a similarity of s, so do those of one block
  at least, so a record is a few smaller ones, of a size for which a point of 24 bytes tells much. Records of more than
  ``LARGE`` tokens have more blocks; those that may be similar to one of them are in both forms.
* Two such sets that share o tokens share ``MEET`` of their first n - o + MEET, in any fixed order of tokens (here the
  seldom ones first). So points are sent to the tasks by these tokens, the token is a coordinate of the tree, and a pair
  is tested where both have the token within the prefix that their two sizes demand.

Counts are kept as bit planes (count at least 1, 2, 3): a minimum is an AND, a maximum an OR, a sum a population count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.canonical import consistent
from filingloom.plans.scratch import discard, materialise

MIN_WORDS, RUN, SIMILARITY = 30, 3, 0.6
#: Similar sets share this many tokens of their prefixes at least, or all they need to share.
MEET = 2
#: Blocks of a record are 4 to the power of its level and one; records of more than LARGE times 4 to that power have more.
LARGE, LEVELS = 1024, 6
#: Tokens are put in order by their counts if these are so many times the mean of the cells, and more than MANY.
OFTEN, MANY = 2, 8
#: Cells that the occurrences of all tokens are counted in, and cells of one row of counts.
CELLS, ROW = 1 << 20, 1 << 14
#: Groups of a point, planes of its counts, and children of a node.
GROUPS, PLANES, NODE = 64, 3, 16
#: Sets in which a token stands above which they are spread over tasks, and sets that a task indexes at once.
SPREAD, TASK = 16_384, 200_000
#: Tokens handled at once, and pairs tested at once.
SLICE, TESTS = 1 << 21, 1 << 20
#: Members of groups of exact copies up to which all their pairs are written.
EXPAND = 64


def words(text: Column) -> Column:
    """Maximal runs of letters and digits of the consistent form, in lower case."""
    return F.filter(F.split(F.lower(consistent(text)), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def prepared(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(tbl, id, txt, cls, sh) of the rows of (tbl, id, text) with enough words: hashes of the text and of its words, which
    are its class, and the distinct tokens, in ascending order."""
    some = df.where(F.col("id").isNotNull() & (F.length("text") >= 2 * max(min_words, RUN) - 1))  # no fewer can be so many words
    split = some.select("tbl", "id", F.xxhash64("tbl", "text").alias("txt"), words(F.col("text")).alias("w"))
    hashed = split.select("tbl", "id", "txt", F.xxhash64("tbl", "w").alias("cls"), F.hash("tbl").alias("salt"), F.transform("w", lambda x: F.hash(x)).alias("h"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater_equal(pc.list_value_length(batch.column("h")), max(min_words, RUN)))
            if not batch.num_rows:
                continue
            flat, starts = _flat(batch.column("h"))
            n = np.diff(starts)
            rec = np.repeat(np.arange(len(n), dtype=np.uint64), n)
            h = flat.view(np.uint32).astype(np.uint64)
            last = len(h) - RUN + 1
            x = h[:last] * np.uint64(0x9E3779B97F4A7C15) + h[1 : last + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
            x += batch.column("salt").to_numpy().astype(np.uint32).astype(np.uint64)[rec[:last].astype(np.int64)]  # runs of different tables differ
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            got = (rec[:last] << np.uint64(32) | x >> np.uint64(32))[rec[:last] == rec[RUN - 1 :]]
            got.sort()
            got = got[np.concatenate([[True], got[1:] != got[:-1]])]
            counts = np.bincount((got >> np.uint64(32)).astype(np.int64), minlength=len(n))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(got.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tbl", "id", "txt", "cls")), lists], ["tbl", "id", "txt", "cls", "sh"])

    kinds = {f.name: f.dataType.simpleString() for f in hashed.schema}
    return hashed.mapInArrow(runs, f"tbl {kinds['tbl']}, id {kinds['id']}, txt long, cls long, sh array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column and the start of each list, with the end."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int32)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 32-bit hash of a hash, so that cells, blocks and groups are independent."""
    x = h ^ np.uint32(salt)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def token_counts(classes: DataFrame) -> np.ndarray:
    """How often the tokens of each of ``CELLS`` cells occur in all classes: 8 MB, whatever the data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("sh"))[0].view(np.uint32) >> np.uint32(12), minlength=CELLS)
        for at in range(0, CELLS, ROW):
            part = total[at : at + ROW]
            if part.any():
                small = part.astype(np.uint16) if part.max() < 65_536 else part
                yield pa.RecordBatch.from_arrays([pa.array([at // ROW], pa.int32()), pa.array([small.tobytes()], pa.binary())], ["row", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(ROW, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, np.uint16 if len(x) == 2 * ROW else np.int64)
        return pa.table({"row": table.column("row").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = classes.select("sh").mapInArrow(count, "row int, counts binary").groupBy("row").applyInArrow(add, "row int, counts binary")
    out = np.zeros(CELLS, np.int64)
    for r in rows.collect():  # CELLS / ROW rows at most
        out[r["row"] * ROW : (r["row"] + 1) * ROW] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out


def points(group: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes (n x PLANES) of the group counts of ``n`` sets, and the sum of what exceeds the planes, 255 for any more.

    The minima of two sets sum up to no more than those of their planes and the smaller excess.
    """
    planes, excess = np.empty((n, PLANES), np.uint64), np.empty(n, np.uint8)
    for a in range(0, n, 8192):
        b = min(n, a + 8192)
        lo, hi = np.searchsorted(owner, [a, b])
        got = np.bincount((owner[lo:hi] - a) * GROUPS + group[lo:hi], minlength=(b - a) * GROUPS).reshape(b - a, GROUPS)
        for t in range(PLANES):
            planes[a:b, t] = np.packbits(got > t, axis=1, bitorder="little").view(np.uint64).ravel()
        excess[a:b] = np.minimum(np.maximum(got - PLANES, 0).sum(axis=1), 255)
    return planes, excess


FIELDS = (("key", np.uint32), ("rec", np.uint64), ("n", np.uint32), ("own", np.uint32), ("pos", np.uint32), ("side", np.uint8), ("excess", np.uint8), *((f"p{t}", np.uint64) for t in range(PLANES)))
WIDTH = sum(np.dtype(k).itemsize for _, k in FIELDS)


def packed(fields: dict[str, np.ndarray]) -> bytes:
    """Columns as bytes, the first byte of all numbers first, and so on: what is alike stands together, and is compressed."""
    raw = b"".join(np.ascontiguousarray(fields[f].astype(k).view(np.uint8).reshape(-1, np.dtype(k).itemsize).T).tobytes() for f, k in FIELDS)
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpacked(blob: bytes, n: int) -> dict[str, np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob, n * WIDTH), np.uint8)
    out, at = {}, 0
    for f, k in FIELDS:
        size = np.dtype(k).itemsize
        out[f] = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).ravel()
        at += n * size
    return out


def _sets(flat: np.ndarray, starts: np.ndarray, level: int, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sets of some records at a level: (record, tokens in order, position of each, size) of every token's set, and its number."""
    n = np.diff(starts)
    bits = 2 * (level + 1)
    tok = flat.view(np.uint32)
    rec = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    block = (_mixed(tok, 0x5BD1E995) >> np.uint32(32 - bits)).astype(np.uint64)
    cell = (tok >> np.uint32(12)).astype(np.int64)
    whole = ((rec << np.uint64(bits) | block) << np.uint64(6) | rank[cell].astype(np.uint64)) << np.uint64(32) | tok
    whole.sort()
    of = whole >> np.uint64(38)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(of)))
    number = np.repeat(np.arange(len(first)), size)
    return (of >> np.uint64(bits)).astype(np.int64), whole.astype(np.uint32), np.arange(len(of)) - first[number], size[number], number


def levels_of(n: np.ndarray, level: int, similarity: float) -> np.ndarray:
    """Which records have sets at a level: those of its size, and smaller ones that may be similar to one of them."""
    low = 0 if level == 0 else LARGE * 4 ** (level - 1)
    high = LARGE * 4**level if level + 1 < LEVELS else np.inf
    return (n >= math.floor(similarity * low)) & (n < high)


def ranks(counts: np.ndarray) -> np.ndarray:
    """The place of each cell's tokens in the order of prefixes, seldom ones first: two to a power of two of the counts.

    The mean of the cells grows with the data, and so does what can't be told apart from it. The nearer to it tokens are put
    in order, the fewer sets meet under those that stand in very many, which would grow with the square of the data.
    """
    return np.where(counts > OFTEN * counts.mean() + MANY, 2 * np.log2(np.maximum(counts, 1)), 0).clip(0, 63).astype(np.uint8)


def postings(classes: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """(task, n, blob): the sets of each record under the tokens of which two similar ones share some, many in a row.

    A token that stands in very many sets is kept in pieces: a set goes to one row of a square of tiles and its column, so
    any two of them meet in one tile, and no task gets them all.
    """
    mean = counts.mean()
    rank = ranks(counts)
    tiles = np.ceil(np.maximum(0, counts - 2 * mean) / SPREAD).clip(1, 65_535).astype(np.uint16)
    tasks = max(1, math.ceil(counts.sum() * (1 - similarity + 0.1) / TASK))
    sent = classes.sparkSession.sparkContext.broadcast((rank, tiles))  # 3 MB, whatever the data

    def one(rec: np.ndarray, flat: np.ndarray, starts: np.ndarray, level: int) -> Iterator[pa.RecordBatch]:
        rank, tiles = sent.value
        n = np.diff(starts)
        own, tok, pos, size, number = _sets(flat, starts, level, rank)
        planes, excess = points(_mixed(tok, 0x2545F491) >> np.uint32(26), number, int(number[-1]) + 1 if len(number) else 0)
        at = np.flatnonzero(pos < size - np.ceil(similarity * size - 1e-9).astype(np.int64) + MEET)
        key, t = _mixed(tok[at], 0x68E31DA4 + level), tiles[(tok[at] >> np.uint32(12)).astype(np.int64)].astype(np.int64)
        side = np.full(len(at), 2, np.uint8)
        if (t > 1).any():
            mine = (_mixed(rec[own[at]].astype(np.uint32), 0x1B56C4E9) % np.maximum(t, 1).astype(np.uint32)).astype(np.int64)
            again = np.repeat(np.arange(len(at)), t)
            other = np.arange(len(again)) - np.repeat(np.cumsum(t) - t, t)
            at, key, mine, t = at[again], key[again], mine[again], t[again]
            low, high = np.minimum(mine, other), np.maximum(mine, other)
            side = np.where(low == high, 2, (mine == high).astype(np.uint8)).astype(np.uint8)
            key = np.where(t > 1, _mixed(key ^ (low * 65_599 + high).astype(np.uint32), 0x7F4A7C15), key)
        task = _mixed(key, 0x3C6EF372) % np.uint32(tasks)
        order = np.argsort(task.astype(np.uint64) << np.uint64(32) | key)
        ends = np.searchsorted(task[order], np.arange(tasks + 1))
        fields = {"key": key, "rec": rec[own[at]], "n": n[own[at]], "own": size[at], "pos": pos[at], "side": side, "excess": excess[number[at]], **{f"p{i}": planes[number[at], i] for i in range(PLANES)}}
        out = [(k, ends[k + 1] - ends[k], packed({f: v[order[ends[k] : ends[k + 1]]] for f, v in fields.items()})) for k in np.flatnonzero(np.diff(ends))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], ["task", "n", "blob"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = _flat(batch.column("sh"))
            rec = batch.column("rec").to_numpy().astype(np.uint64)
            n = np.diff(starts)
            for level in range(LEVELS):
                mine = np.flatnonzero(levels_of(n, level, similarity))
                part = np.cumsum(n[mine]) // SLICE
                for k in np.unique(part):
                    some = mine[part == k]
                    again = np.concatenate([[0], np.cumsum(n[some])])
                    where = np.arange(again[-1]) + np.repeat(starts[some] - again[:-1], n[some])
                    yield from one(rec[some], flat[where], again, level)

    return classes.select("rec", "sh").mapInArrow(post, "task int, n int, blob binary")


class CountRTree:
    """R-tree over points with the coordinates token, size and group counts, packed in the order of the first two.

    Nodes keep the range of tokens and sizes, and the maxima of the counts. ``pairs`` joins the tree with itself.
    """

    def __init__(self, fields: dict[str, np.ndarray]) -> None:
        order = np.argsort(fields["key"].astype(np.uint64) << np.uint64(32) | fields["own"])
        key = fields["key"][order]
        same = key[1:] == key[:-1]
        met = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(key) else np.zeros(0, bool)
        order = order[met]  # a token of one set alone leads nowhere
        self.at = {f: v[order] for f, v in fields.items()}
        excess = np.where(self.at["excess"] == 255, 1 << 30, self.at["excess"].astype(np.int64))
        planes = np.stack([self.at[f"p{t}"] for t in range(PLANES)], axis=1)
        top = (self.at["key"], self.at["key"], self.at["own"].astype(np.int64), self.at["own"].astype(np.int64), planes, excess)
        self.levels = [top]
        while len(top[0]) > NODE:
            cut = np.arange(0, len(top[0]), NODE)
            last = np.append(cut[1:], len(top[0])) - 1
            top = (top[0][cut], top[1][last], np.minimum.reduceat(top[2], cut), np.maximum.reduceat(top[3], cut), np.bitwise_or.reduceat(top[4], cut), np.maximum.reduceat(top[5], cut))
            self.levels.append(top)

    @staticmethod
    def may(level: tuple, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Of pairs of boxes, a not after b: whether they share a token, their sizes can agree, and the summed minima of the
        maxima reach what the smallest sets of both need."""
        first, last, least, most, planes, excess = level
        at = np.flatnonzero(last[a] >= first[b])
        i, j = a[at], b[at]
        fits = (most[i] >= similarity * least[j] - 1e-9) & (most[j] >= similarity * least[i] - 1e-9)
        at, i, j = at[fits], i[fits], j[fits]
        bound = np.minimum(excess[i], excess[j])
        for t in range(PLANES):
            bound += np.bitwise_count(planes[i, t] & planes[j, t])
        return at[bound >= similarity / (1 + similarity) * (least[i] + least[j]) - 1e-9]

    def pairs(self, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(record, record, tokens needed) of the pairs of sets, some at a time, that no bound rules out."""
        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top][0]))
        keep = self.may(self.levels[top], a, b, similarity)
        todo = [(top, a[keep], b[keep])]
        i, j = np.divmod(np.arange(NODE * NODE), NODE)
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                yield self._tested(a, b, similarity)
                continue
            step = TESTS // (NODE * NODE)
            if len(a) > step:
                todo += [(level, a[k : k + step], b[k : k + step]) for k in range(0, len(a), step)]
                continue
            below = len(self.levels[level - 1][0])
            low, high = (NODE * a[:, None] + i).ravel(), (NODE * b[:, None] + j).ravel()
            some = np.flatnonzero((high < below) & (low < high if level == 1 else low <= high))
            some = some[self.may(self.levels[level - 1], low[some], high[some], similarity)]
            if len(some):
                todo.append((level - 1, low[some], high[some]))

    def _tested(self, a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.at
        other = a != b  # a tree of one node
        a, b = a[other], b[other]
        n, m = x["own"][a].astype(np.int64), x["own"][b].astype(np.int64)
        need = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9).astype(np.int64)
        keep = (x["key"][a] == x["key"][b]) & (x["pos"][a] < n - need + MEET) & (x["pos"][b] < m - need + MEET)
        keep &= (x["side"][a] == 2) | (x["side"][a] != x["side"][b])
        large, small = np.maximum(x["n"][a], x["n"][b]), np.minimum(x["n"][a], x["n"][b])
        keep &= (small >= similarity * large - 1e-9) & (x["rec"][a] != x["rec"][b])
        return x["rec"][a[keep]].astype(np.int64), x["rec"][b[keep]].astype(np.int64), need[keep]


def _candidates(posted: DataFrame, similarity: float) -> DataFrame:
    """(a, b) records, a before b, that meet under ``MEET`` tokens, or all they need to share, and that no bound rules out."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[dict]) -> Iterator[pa.RecordBatch]:
            tree = CountRTree({f: np.concatenate([h[f] for h in held]) for f, _ in FIELDS})
            for a, b, need in tree.pairs(similarity) if len(tree.at["key"]) else ():
                few = np.flatnonzero(need < MEET)
                a, b = (np.concatenate([x, np.repeat(x[few], MEET - 1)]) for x in (a, b))
                if len(a):
                    order = np.lexsort((np.maximum(a, b), np.minimum(a, b)))
                    low, high = np.minimum(a, b)[order], np.maximum(a, b)[order]
                    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
                    yield pa.RecordBatch.from_arrays([pa.array(low[first]), pa.array(high[first]), pa.array(np.diff(np.append(first, len(low))))], ["a", "b", "times"])

        held, now = [], None
        for batch in batches:
            for task, n, blob in zip(*(batch.column(c).to_pylist() for c in ("task", "n", "blob"))):
                if task != now and held:
                    yield from found(held)
                    held = []
                now = task
                held.append(unpacked(blob, n))
        if held:
            yield from found(held)

    shared = posted.repartition("task").sortWithinPartitions("task")
    met = shared.mapInArrow(join, "a long, b long, times long")
    return met.groupBy("a", "b").agg(F.sum("times").alias("times")).where(F.col("times") >= MEET).select("a", "b")


def similar_classes(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) of the classes (rec, cls, sh) of different words whose tokens' similarity is at least ``similarity``.

    Tokens are hashes of 32 bits, so two different ones of a pair of records are taken for one with a probability of their
    sizes' product in four milliards; that can only matter to a pair at the very threshold.
    """
    pairs = materialise(_candidates(postings(classes, token_counts(classes), similarity), similarity), "near-pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("rec")).distinct()
    sets = materialise(classes.join(named, "rec", "left_semi").select("rec", "cls", "sh"), "near-sets")
    left = pairs.join(sets.select(F.col("rec").alias("a"), F.col("cls").alias("cls_a"), F.col("sh").alias("x")), "a")
    both = left.join(sets.select(F.col("rec").alias("b"), F.col("cls").alias("cls_b"), F.col("sh").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))


def near_pairs(df: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, expand: int = EXPAND) -> DataFrame:
    """(tbl, id_a, id_b) of the pairs of rows of (tbl, id, text) of one tbl that are similar, the smaller id first.

    Rows of too few words and null texts or ids are no cases; repeated rows count once. Texts of equal words are one class,
    of which the similar ones are found once. Every two different texts that are similar, or of equal words, give a pair.
    Rows of one and the same text are exact copies: of up to ``expand`` of them all pairs are written, with each other and
    with the copies of similar texts; larger groups as links of each copy to their smallest, which alone is paired with
    other texts. So no link is lost, but the pairs of a huge group of copies, which would grow with its square.
    """
    prep = materialise(prepared(df, min_words), "near-records")
    once = prep.groupBy("cls").agg(F.first("sh").alias("sh")).withColumn("rec", F.monotonically_increasing_id())
    classes = materialise(once, "near-classes")  # written, as a number must not change if an executor is lost
    members = materialise(prep.select("tbl", "id", "txt", "cls").distinct(), "near-members")
    discard(prep)
    links = similar_classes(classes, similarity)
    discard(classes)
    # the copies of a text are counted where they are before they meet, so a text of a third of all rows does no harm
    texts = materialise(members.groupBy("txt", "cls", "tbl").agg(F.count("*").alias("size"), F.min("id").alias("least")), "near-texts")
    side = {c: texts.select(*[F.col(x).alias(f"{x}_{c}") for x in ("cls", "txt", "size", "least")]) for c in "ab"}
    near = links.join(side["a"], F.col("a") == F.col("cls_a")).join(side["b"], F.col("b") == F.col("cls_b")).drop("a", "b")
    several = texts.groupBy("cls").agg(F.count("*").alias("texts")).where("texts > 1").select("cls")
    varied = texts.join(several, "cls", "left_semi")
    alike = varied.select(*[F.col(x).alias(f"{x}_a") for x in ("cls", "txt", "size", "least")]).join(varied.select(*[F.col(x).alias(f"{x}_b") for x in ("cls", "txt", "size", "least")]), F.col("cls_a") == F.col("cls_b")).where("txt_a < txt_b")
    tbl = texts.select(F.col("txt").alias("txt_a"), "tbl")
    apart = materialise(near.unionByName(alike).join(tbl, "txt_a"), "near-links")
    firsts = apart.select("tbl", F.col("least_a").alias("x"), F.col("least_b").alias("y"))
    # the copies of texts that have few
    few = materialise(members.join(texts.where((F.col("size") > 1) & (F.col("size") <= expand)).select("txt"), "txt", "left_semi").select("txt", "id"), "near-copies")
    both = apart.where(F.col("size_a").between(2, expand) | F.col("size_b").between(2, expand)).select("tbl", "txt_a", "txt_b", "least_a", "least_b")
    a = both.join(few.select(F.col("txt").alias("txt_a"), F.col("id").alias("id_a")), "txt_a", "left")
    b = a.join(few.select(F.col("txt").alias("txt_b"), F.col("id").alias("id_b")), "txt_b", "left")
    others = b.select("tbl", F.coalesce("id_a", "least_a").alias("x"), F.coalesce("id_b", "least_b").alias("y"))
    kinds = texts.where((F.col("size") > 1) & (F.col("size") <= expand)).select("txt", "tbl")
    copies = few.join(kinds, "txt").select("tbl", "txt", F.col("id").alias("x")).join(few.select("txt", F.col("id").alias("y")), "txt").where("x < y").select("tbl", "x", "y")
    # of larger groups there are fewer than rows / expand; their rows are not shuffled by the text, which may be a hot key
    many = texts.where(F.col("size") > expand).select("txt", "least")
    stars = _to_least(members, many)
    out = firsts.unionByName(others).unionByName(copies).unionByName(stars)
    return out.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _to_least(members: DataFrame, many: DataFrame, salts: int = 64) -> DataFrame:
    """(tbl, x, y): each copy of a large group with the smallest one; the groups' rows are spread over salts."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    wide = many.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(wide, ["txt", "salt"]).where(F.col("id") != F.col("least")).select("tbl", F.col("id").alias("x"), F.col("least").alias("y"))
