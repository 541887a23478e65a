"""Problem 6: encoding of the whole corpus with a public byte-level BPE vocabulary.

The texts are cut into words by the tokenizer's own pattern; a word is encoded by folding ranked merges over its array of
bytes (each in hexadecimal) with higher-order functions. A text stays in its row: a word that is one piece is looked up in
the ranks, a distinct word that is frequent is folded once and looked up in a literal of the frequent words, any other is
folded where it stands. So nothing is shuffled but the counts of words and each text once.
Literals are arrays of small maps, because a lookup in a map takes time in proportion to its size. A fold takes time in
proportion to the square of a word's length; words above ``LONG`` bytes are merged with a heap, in Python.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.plans.scratch import materialise

#: Where the public vocabulary files lie.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Maps that the ranks are spread over, a power of two.
MAPS = 16384
#: A word that is more than one in so many of all is folded once: there are fewer such words than this.
HOT = 1 << 15
#: Bytes of a word above which it is merged with a heap.
LONG = 192
#: The words of the vocabulary's pattern, for Java; white space is Unicode's there too.
WORDS = "(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
NONE = 2**31 - 1


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ids, from a file with a piece in base 64 and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _slot(piece: Column) -> Column:
    return F.pmod(F.crc32(piece), F.lit(MAPS)).cast("int")


def rank_table(path: str) -> Column:
    """The literal: for each slot a map from piece to rank."""
    slots: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for piece, rank in ranks(path).items():
        name = piece.hex().upper()
        slots[zlib.crc32(name.encode()) % MAPS][name] = rank
    # a function of literals alone, so that the optimizer replaces it by its value, once
    return F.from_json(F.lit(json.dumps(slots)), T.ArrayType(T.MapType(T.StringType(), T.IntegerType())))


def _rank(table: Column, piece: Column) -> Column:
    return F.coalesce(F.try_element_at(F.get(table, _slot(piece)), piece), F.lit(NONE))


def merged(word: Column, table: Column) -> Column:
    """The ids of a word: while two neighbours make a piece, the pair of the lowest rank is merged.

    Each step looks up only the two pairs that a merge makes, so a word of n bytes takes n steps over arrays of its
    length. The empty word has no ids.
    """
    none = F.array().cast("array<int>")

    def merge(s: Column, low: Column) -> Column:
        p, r = s["p"], s["r"]

        def at(k: Column) -> Column:
            def put(q: Column) -> Column:
                left = F.when(k > 1, F.array(_rank(table, F.concat(F.try_element_at(p, k - 1), q)))).otherwise(none)
                right = F.when(k < F.size(r), F.array(_rank(table, F.concat(q, F.try_element_at(p, k + 2))))).otherwise(none)
                newp = F.concat(F.slice(p, F.lit(1), k - 1), F.array(q), F.slice(p, k + 2, F.size(p)))
                newr = F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), left, right, F.slice(r, k + 2, F.size(r)))
                return F.struct(newp.alias("p"), newr.alias("r"))

            return _let(F.concat(F.element_at(p, k), F.element_at(p, k + 1)), put)

        return _let(F.array_position(r, low).cast("int"), at)

    def step(s: Column, _: Column) -> Column:
        return _let(F.coalesce(F.array_min(s["r"]), F.lit(NONE)), lambda low: F.when(low == NONE, s).otherwise(merge(s, low)))

    def fold(p: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: _rank(table, F.concat(F.element_at(p, i), F.element_at(p, i + 1))))
        done = F.aggregate(F.sequence(F.lit(2), F.size(p)), F.struct(p.alias("p"), pairs.alias("r")), step, lambda s: s["p"])
        return F.transform(F.when(F.size(p) < 2, p).otherwise(done), lambda x: _rank(table, x))

    def whole(code: Column) -> Column:
        return _let(_rank(table, code), lambda r: F.when(r != NONE, F.array(r)).otherwise(_let(F.regexp_extract_all(code, F.lit(".."), F.lit(0)), fold)))

    return _let(F.hex(F.encode(word, "UTF-8")), whole)


def merged_long(word: bytes, known: dict[bytes, int]) -> list[int]:
    """The same for a word of any length: a heap of pairs over a linked list of pieces."""
    n = len(word)
    start, after, before = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
    ends = list(range(1, n + 1))  # the piece that starts at i ends at ends[i]; 0 once it is part of another
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := known.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, ends[j]))

    for i in start[:-1]:
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not ends[i] or j >= n or ends[j] != end:
            continue  # one of the two was merged meanwhile
        ends[i], ends[j], after[i] = end, 0, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [known[word[i : ends[i]]] for i in start if ends[i]]


def frequent(words: DataFrame, table: Column, hot: int = HOT) -> Column:
    """A literal, as of the ranks: the ids of each word, not one piece itself, that is more than one in ``hot`` of all."""
    rows = words.select(F.explode("words").alias("word")).where(F.octet_length("word").between(2, LONG))
    counts = rows.where(_rank(table, F.hex(F.encode("word", "UTF-8"))) == NONE).groupBy("word").agg(F.count("*").alias("times"))
    counts = materialise(counts, "word-counts")
    total = counts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    few = counts.where(F.col("times") * hot > total).select("word", _let(table, lambda t: merged(F.col("word"), t)).alias("ids"))
    slots: list[dict[str, list[int]]] = [{} for _ in range(MAPS)]
    for r in few.collect():  # fewer than ``hot`` rows, by the condition
        slots[zlib.crc32(r["word"].encode()) % MAPS][r["word"]] = r["ids"]
    return F.from_json(F.lit(json.dumps(slots)), T.ArrayType(T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))))


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids) for every distinct row of ``key`` and ``text``; a null or empty text has the empty list.

    A null key keeps its row, and so does each text of a key that has several. Only the two columns are read.
    """
    table = rank_table(path)
    known = df.sparkSession.sparkContext.broadcast(ranks(path))  # the vocabulary, whatever the data

    @F.pandas_udf("array<array<int>>")
    def long_ids(s: pd.Series) -> pd.Series:
        return s.map(lambda ws: [None if w is None else merged_long(w.encode(), known.value) for w in ws], na_action="ignore")

    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    cut = docs.distinct().select("key", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words"))
    often = frequent(docs.select(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words")), table)
    is_long = F.exists("words", lambda w: F.octet_length(w) > LONG)
    held = cut.withColumn("long", long_ids(F.when(is_long, F.transform("words", lambda w: F.when(F.octet_length(w) > LONG, w)))))

    def ids(known: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            seen = F.try_element_at(F.get(known["often"], F.pmod(F.crc32(F.encode(w, "UTF-8")), F.lit(MAPS)).cast("int")), w)
            return F.coalesce(F.get("long", i), seen, merged(w, known["ranks"]))

        return F.flatten(F.transform("words", one))

    # each literal stands once in the plan
    found = _let(F.struct(table.alias("ranks"), often.alias("often")), ids)
    return held.select(F.col("key").alias(key), F.coalesce(found, F.array().cast("array<int>")).alias("ids"))


def decode(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """(key, text): the binary pieces of the ids in order, read as UTF-8; the empty list gives the empty text, null null."""
    names = [p.hex().upper() for p, _ in sorted(ranks(path).items(), key=lambda x: x[1])]
    table = F.split(F.lit(",".join(names)), ",")
    whole = F.array_join(F.transform(F.col(ids), lambda i: F.get(table, i)), "")
    return df.select(key, F.decode(F.unhex(whole), "UTF-8").alias("text"))
