"""Problem 7: evaluation texts leaking into training text.

Words are typed: numbers, units (the word after a number) and names (words that the items write with a capital inside a
sentence) become placeholders, so that each run of twelve words has a template and, apart from it, the values of its slots.
Windows of texts meet those of the items under the hash of their template; the slots decide what a match is: the same
values are a leak, other values, put in consistently, a question with new parameters.

A text's words are hashed once, in the JVM; its windows' hashes are sums over shifted arrays. The items' windows are
broadcast, in as many slices as ``WINDOWS`` demands, so a list of items of any size works, with a scan for each slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 12
#: Windows of items that are broadcast at once, some 150 bytes each, and names that texts are typed by.
WINDOWS, NAMES = 200_000, 200_000
#: Words of its own that a window needs for its slots to be put in otherwise, and those of them that texts are searched by.
OWN, ANCHOR = WINDOW // 2, 4
PLAIN, NUMBER, UNIT, NAME = range(4)
#: What stands for a slot in a template, and the odd factors of a window's places, by rule.
SLOT = np.random.default_rng(11).integers(1, 2**63, 4, dtype=np.uint64)
PLACES = np.random.default_rng(12).integers(1, 2**63, (2, WINDOW), dtype=np.uint64) | np.uint64(1)


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, in lower case; empty for a text without any, null for a null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def _hashed(all_words: Column) -> Column:
    """A hash of each word, odd if the word holds a digit."""
    return F.transform(all_words, lambda w: F.xxhash64(w).bitwiseAND(-2).bitwiseOR(w.rlike("\\p{N}").cast("long")))


def item_parts(items: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(item, text): a row per distinct item and part that isn't null."""
    parts = items.select(F.col(key).alias("item"), F.explode(F.array(*columns)).alias("text"))
    return parts.where("item IS NOT NULL AND text IS NOT NULL").distinct()


def names(parts: DataFrame) -> DataFrame:
    """(w) hashes of the words that the items write with a capital inside a sentence.

    Whether a word is a name depends on the word alone, so a copy in other case keeps its template.
    """
    inner = F.explode(F.regexp_extract_all("text", F.lit("(?<=[\\p{Ll}\\p{N},;] )\\p{Lu}[\\p{L}\\p{N}]+"), F.lit(0)))
    return parts.select(inner.alias("w")).select(_hashed(F.array(F.lower("w")))[0].alias("w")).distinct()


def some_names(parts: DataFrame, limit: int) -> np.ndarray:
    """Names to type texts by, where the slots are compared too: any set of words will do, if both sides have the same, so
    beyond ``limit`` those of the smallest hashes are taken, which costs no match."""
    return np.sort(np.array([r[0] for r in names(parts).orderBy("w").limit(limit).collect()], np.int64))


def kinds_of(h: np.ndarray, first: np.ndarray, named: np.ndarray) -> np.ndarray:
    """The type of each word; ``first`` marks those that begin a text, ``named`` names."""
    number = (h & 1).astype(bool)
    after = np.concatenate([[False], number[:-1]]) & ~first
    out = np.where(named, NAME, PLAIN)
    return np.where(number, NUMBER, np.where(after, UNIT, out)).astype(np.uint8)


def windows_of(h: np.ndarray, sizes: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, template, slots, kinds) of each window of the texts whose words' hashes follow each other in ``h``.

    The first word of a window is typed without the one before, so that a window's template depends on its words alone.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)])
    text = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.zeros(len(h), bool)
    begin[starts[:-1][sizes > 0]] = True
    kind, bare = kinds_of(h, begin, named), kinds_of(h, np.ones(len(h), bool), named)
    left = starts[1:][text] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)
    at = np.flatnonzero(left >= WINDOW)
    u = h.view(np.uint64)
    template, slots = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(WINDOW):
        k = (bare if j == 0 else kind)[at + j]
        word = u[at + j]
        template += np.where(k == PLAIN, word, SLOT[k]) * PLACES[0, j]
        slots += np.where(k == PLAIN, np.uint64(0), word) * PLACES[1, j]
    return text[at], at, template ^ template >> np.uint64(31), slots ^ slots >> np.uint64(29), (kind, bare)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.asarray(batch.column("h").value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return np.ascontiguousarray(batch.column("h").flatten().to_numpy(zero_copy_only=False), np.int64), sizes


ITEM = "template long, slots long, words array<long>, kinds binary"


def item_windows(parts: DataFrame, known: np.ndarray | None) -> DataFrame:
    """(item, template, slots, words, kinds) of the items' distinct windows, typed by the names ``known``, or by all if None.

    All names may be too many for one place, so each item gets those that are words of its own.
    """
    split = parts.select("item", _hashed(words(F.col("text"))).alias("h")).where(F.size("h") >= WINDOW)
    if known is None:
        own = split.select("item", F.explode("h").alias("w")).distinct().join(names(parts), "w")
        split = split.join(own.groupBy("item").agg(F.collect_set("w").alias("own")), "item", "left")
    kind = parts.schema["item"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, sizes = _texts(batch)
            if known is None:
                ends = np.cumsum(sizes)
                each = [np.isin(h[end - n : end], own or []) for own, n, end in zip(batch.column("own").to_pylist(), sizes, ends)]
                named = np.concatenate([np.zeros(0, bool), *each])
            else:
                named = np.isin(h, known)
            text, at, template, slots, (kind, bare) = windows_of(h, sizes, named)
            span = at[:, None] + np.arange(WINDOW)
            kinds = kind[span] if len(at) else np.zeros((0, WINDOW), np.uint8)
            if len(at):
                kinds[:, 0] = bare[at]
            cols = [batch.column("item").take(pa.array(text)), pa.array(template.view(np.int64)), pa.array(slots.view(np.int64)), pa.array(list(h[span]), pa.list_(pa.int64())), pa.array([k.tobytes() for k in kinds], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["item", "template", "slots", "words", "kinds"])

    return split.mapInArrow(cut, f"item {kind}, {ITEM}").distinct()


def _search(docs: DataFrame, doc: str, text: str, items: DataFrame, key: str, columns: tuple[str, ...], found, result: str, typed: bool) -> DataFrame:
    """The union of what ``found`` yields for the texts and each slice of the items' windows. If the texts are ``typed`` too,
    ``NAMES`` names will do; else all names are slots of the items."""
    parts = item_parts(items.select(key, *columns), key, columns)
    known = some_names(parts, NAMES) if typed else None
    have = item_windows(parts, known)
    slices = max(1, math.ceil(have.count() / WINDOWS))
    split = docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text")).distinct()
    split = split.select("doc", _hashed(words(F.col("text"))).alias("h")).where(F.size("h") >= WINDOW)
    schema = f"doc {docs.schema[doc].dataType.simpleString()}, item {parts.schema['item'].dataType.simpleString()}, {result}"
    context = docs.sparkSession.sparkContext
    out = []
    for s in range(slices):
        mine = have.where(F.pmod(F.xxhash64("item", "template", "slots"), F.lit(slices)) == s).toArrow()
        sent = context.broadcast((mine, known))  # WINDOWS rows or a few more, and the names

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            mine, known = sent.value
            index = _Index(mine)
            for batch in batches:
                h, sizes = _texts(batch)
                who, item, *more = found(index, h, sizes, known)
                cols = [batch.column("doc").take(pa.array(who)), mine.column("item").combine_chunks().take(pa.array(item)), *map(pa.array, more)]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "item", *(c.split()[0] for c in result.split(", ") if more)])

        out.append(split.mapInArrow(run, schema.rstrip(", ")))
    return reduce(DataFrame.unionByName, out)


class _Index:
    """The windows of items, in the order of their templates, and of their anchors."""

    def __init__(self, table: pa.Table) -> None:
        n = table.num_rows
        self.template, self.slots = (table.column(c).to_numpy().view(np.uint64) for c in ("template", "slots"))
        self.order = np.argsort(self.template, kind="stable")
        self.words = np.asarray(table.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64).reshape(n, WINDOW)
        self.kinds = np.frombuffer(b"".join(table.column("kinds").to_pylist()), np.uint8).reshape(n, WINDOW)
        plain = self.kinds == PLAIN
        left = plain.sum(axis=1) >= OWN
        #: for each form of anchors that is needed: its places, and the keys in order, with their windows and places there
        self.anchors = []
        for places in anchor_forms():
            fits = np.stack([plain[:, [o + p for p in places]].all(axis=1) for o in range(WINDOW - places[-1])], axis=1)
            has = np.flatnonzero(left & fits.any(axis=1))
            left[has] = False
            if len(has):
                offset = fits[has].argmax(axis=1)
                keys = anchors([self.words[has, offset + p] for p in places])
                by = np.argsort(keys, kind="stable")
                self.anchors.append((places, keys[by], has[by], offset[by]))

    @staticmethod
    def meet(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in keys, position in sorted_keys) of all equal pairs."""
        lo, hi = np.searchsorted(sorted_keys, keys), np.searchsorted(sorted_keys, keys, side="right")
        n = hi - lo
        some = np.repeat(np.arange(len(keys)), n)
        return some, np.repeat(lo, n) + np.arange(len(some)) - np.repeat(np.cumsum(n) - n, n)


@cache
def anchor_forms() -> list[tuple[int, ...]]:
    """Places of ``ANCHOR`` words, from the first, one form of which at least any window of ``OWN`` words of its own has: four
    side by side, then those that the most windows are still without."""
    masks = np.array([m for m in range(1 << WINDOW) if m.bit_count() >= OWN], np.int64)
    has = {}
    for places in ((0, *rest) for rest in combinations(range(1, WINDOW), ANCHOR - 1)):
        bits = sum(1 << p for p in places)
        has[places] = np.any([masks & bits << o == bits << o for o in range(WINDOW - places[-1])], axis=0)
    out = [tuple(range(ANCHOR))]
    left = ~has[out[0]]
    while left.any():
        out.append(max(has, key=lambda p: (has[p] & left).sum()))
        left &= ~has[out[-1]]
    return out


def anchors(each: list[np.ndarray]) -> np.ndarray:
    """A hash of ``ANCHOR`` words, given as arrays of the first ones, the second ones, and so on."""
    return sum(h.view(np.uint64) * PLACES[0, j] for j, h in enumerate(each))


def _same_values(index: _Index, h: np.ndarray, sizes: np.ndarray, known: np.ndarray):
    """Windows of one template whose slots hold the same values."""
    text, at, template, slots, _ = windows_of(h, sizes, np.isin(h, known))
    i, j = index.meet(index.template[index.order], template)
    own = index.order[j]
    same = index.slots[own] == slots[i]
    both = np.unique(np.stack([text[i[same]], own[same]]), axis=1) if same.any() else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _other_values(index: _Index, h: np.ndarray, sizes: np.ndarray, known: None):
    """Windows that agree with an item's in all words but its slots, which hold other values, put in consistently."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    text = np.repeat(np.arange(len(sizes)), sizes)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for places, sorted_keys, owner, offset in index.anchors:
        n = len(h) - places[-1]
        if n <= 0:
            continue
        i, j = index.meet(sorted_keys, anchors([h[p : p + n] for p in places]))
        begin = i - offset[j]
        inside = (begin >= starts[text[i]]) & (begin + WINDOW <= starts[text[i] + 1])
        i, own, begin = i[inside], owner[j[inside]], begin[inside]
        theirs, mine = index.words[own], h[begin[:, None] + np.arange(WINDOW)] if len(begin) else np.zeros((0, WINDOW), np.int64)
        slot = index.kinds[own] != PLAIN
        ok = ((theirs == mine) | slot).all(axis=1) & (theirs != mine).any(axis=1)
        ok &= (((theirs ^ mine) & 1 == 0) | ~slot).all(axis=1)  # numbers for numbers
        a, b = theirs[ok], mine[ok]
        # equal values stay equal, and different ones different
        consistent = np.array([len({*zip(x, y)}) == len({*x}) == len({*y}) for x, y in zip(a.tolist(), b.tolist())], bool)
        out.append((text[i[ok]][consistent], own[ok][consistent]))
    i, own = (np.concatenate(x) for x in zip(*out))
    return i, own, index.template[own].view(np.int64)


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", key: str = "eval_id", columns: tuple[str, ...] = ("passage", "question")) -> DataFrame:
    """(doc, item) for every document that holds twelve consecutive words of an item's part, the slots with its values.

    Null keys and texts give no row; repeated rows count once.
    """
    hit = _search(docs, doc, text, items, key, columns, _same_values, "", True)
    return hit.select(F.col("doc").alias(doc), F.col("item").alias(key)).distinct()


def reparameterised(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", key: str = "eval_id", columns: tuple[str, ...] = ("passage", "question")) -> DataFrame:
    """(doc, item, windows) where a document repeats an item's window with other values in its slots.

    Any word may stand for a name or a unit, a number for a number. The values must be put in consistently: one that occurs
    twice is replaced by the same twice. At least half of the window is words of its own, wherever they stand.
    Equal values are :func:`leaks`.
    """
    hit = _search(docs, doc, text, items, key, columns, _other_values, "template long", False)
    return hit.groupBy(F.col("doc").alias(doc), F.col("item").alias(key)).agg(F.countDistinct("template").alias("windows"))
