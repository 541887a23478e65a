"""Each operator against brute force or an exact round trip, with nulls, empty and long texts, ties, repeats and empty tables."""

import random
import unicodedata

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filingloom.llm import canonical, leaks, nearcopies, neighbours, pieces, queries, sentences, sitelines, tokenizer

SF = "/root/testdata/sf0.001"
VOCABULARY = f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"


# 1


def _brute_pairs(rows, similarity=0.6):
    seen = []
    for tbl, key, text in {r for r in rows if r[1] is not None and r[2] is not None}:
        w = regex.findall(r"[\p{L}\p{N}]+", canonical.consistent_form(text).lower())
        if len(w) >= 30:
            seen.append((tbl, key, set(zip(w, w[1:], w[2:]))))
    out = set()
    for i, (t, a, x) in enumerate(seen):
        for u, b, y in seen[:i]:
            if t == u and len(x & y) >= similarity * len(x | y) - 1e-9:
                out.add((t, min(a, b), max(a, b)))
    return out


def _edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        k = rng.randrange(len(w))
        if rng.random() < 0.5:
            w[k] = f"x{rng.randrange(10**6)}"
        else:
            w.insert(k, f"y{rng.randrange(10**6)}")
    return " ".join(w)


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(3)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 45, 80, 300]))]
        rows += [("a" if g % 3 else "b", f"{g}-{k}", _edited(rng, base, rng.randrange(0, len(base) // 8))) for k in range(5)]
        rows.append(("a", f"{g}-copy", rows[-1][2].upper()))
    halves = " ".join(rows[3][2].split()[15:] + rows[3][2].split()[:15])
    long = " ".join(f"z{i}" for i in range(20_000))
    return rows + rows[:7] + [("a", "moved", halves), ("a", None, rows[0][2]), ("a", "null", None), ("a", "empty", ""), ("a", "short", "one two"), ("a", "long1", long), ("a", "long2", long + " end")]


def test_near_pairs_match_brute_force(spark, near_rows):
    df = spark.createDataFrame(near_rows, "tbl string, id string, text string").withColumn("cls", F.lit("clash")).withColumn("n", F.lit(1))
    got = {tuple(r) for r in nearcopies.near_pairs(df).collect()}
    assert got == _brute_pairs(near_rows)
    assert ("a", "long1", "long2") in got


def test_near_pairs_of_nothing(spark):
    assert nearcopies.near_pairs(spark.createDataFrame([], "tbl string, id string, text string")).collect() == []


def test_large_groups_of_copies_lose_no_link(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [("a", f"{i:03}", text) for i in range(100)] + [("a", "zz", text + " more"), ("a", "zzz", text + " more"), ("a", "yy", text.upper() + "."), ("b", "000", text)]
    got = {(r["tbl"], r["id_a"], r["id_b"]) for r in nearcopies.near_pairs(spark.createDataFrame(rows, "tbl string, id string, text string")).collect()}
    # each of the hundred copies is linked to the smallest, and different texts to each other
    assert got == {("a", "000", f"{i:03}") for i in range(1, 100)} | {("a", "000", x) for x in ("yy", "zz", "zzz")} | {("a", "yy", "zz"), ("a", "yy", "zzz"), ("a", "zz", "zzz")}
    few = [r for r in rows if r[1] < "030" or r[1] > "yy" or r[0] == "b"]
    assert {tuple(r) for r in nearcopies.near_pairs(spark.createDataFrame(few, "tbl string, id string, text string")).collect()} == _brute_pairs(few)


def test_near_pairs_of_all_sizes(spark, monkeypatch):
    """Records on both sides of the sizes at which they get more blocks, and tokens that stand in many sets, in tiles."""
    rng = random.Random(8)
    rows = []
    for g, n in enumerate((90, 600, 640, 1000, 1050, 1500, 2600, 4200)):
        base = [f"v{g}x{i}" for i in range(n)]
        rows += [("a", f"{g}-{k}", _edited(rng, base[: int(n * (1 - 0.12 * k))], n // 100)) for k in range(4)]
    shared = [f"s{i}" for i in range(60)]
    rows += [("a", f"h{k}", _edited(rng, shared + [f"h{k}y{i}" for i in range(rng.choice([4, 30, 90]))], 1)) for k in range(40)]
    want = _brute_pairs(rows)
    df = spark.createDataFrame(rows, "tbl string, id string, text string")
    assert {tuple(r) for r in nearcopies.near_pairs(df).collect()} == want
    monkeypatch.setattr(nearcopies, "SPREAD", 1)
    assert {tuple(r) for r in nearcopies.near_pairs(df).collect()} == want and len(want) > 90


def test_near_pairs_of_few_tokens(spark):
    rows = [("a", f"one{n}", " ".join(["word"] * n)) for n in (30, 40)]
    rows += [("a", f"two{n}", " ".join(["left", "right"] * n)) for n in (15, 20)] + [("a", "two31", " ".join(["left", "right"] * 15 + ["left"]))]
    rows += [("a", f"three{n}", " ".join(["x", "y", "z"] * n)) for n in (11, 14)] + [("a", "most", " ".join(["left", "right"] * 16 + ["end"]))]
    got = {tuple(r) for r in nearcopies.near_pairs(spark.createDataFrame(rows, "tbl string, id string, text string")).collect()}
    assert got == _brute_pairs(rows) and ("a", "one30", "one40") in got and ("a", "two15", "two31") in got and ("a", "most", "two15") in got


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.5, 0.6, 0.8]), st.integers(0, 2))
def test_tree_keeps_every_similar_pair(seed, similarity, level):
    """Sets of a level's blocks, met under their prefixes in the tree, give every similar pair ``MEET`` times or as often as it can."""
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        n = int(rng.choice([3, 40, 70, 300]))
        base = rng.choice(2**31, n, replace=False)
        sets += [np.unique(np.where(rng.random(n) < rng.choice([0, 0.1, 0.2]), rng.integers(0, 2**31, n), base)) for _ in range(4)]
    flat, starts = np.concatenate(sets).astype(np.int32), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    own, tok, pos, size, number = nearcopies._sets(flat, starts, level, np.zeros(nearcopies.CELLS, np.uint8))
    planes, excess = nearcopies.points(tok >> np.uint32(26), number, int(number[-1]) + 1)
    at = np.flatnonzero(pos < size - np.ceil(similarity * size - 1e-9).astype(np.int64) + nearcopies.MEET)
    n = np.diff(starts)
    fields = {"key": tok[at], "rec": own[at].astype(np.uint64), "n": n[own[at]].astype(np.uint32), "own": size[at].astype(np.uint32), "pos": pos[at].astype(np.uint32), "side": np.full(len(at), 2, np.uint8), "excess": excess[number[at]], **{f"p{t}": planes[number[at], t] for t in range(nearcopies.PLANES)}}
    back = nearcopies.unpacked(nearcopies.packed(fields), len(at))
    assert all((back[f] == fields[f]).all() for f in fields)
    times: dict = {}
    for a, b, need in nearcopies.CountRTree(back).pairs(similarity):
        for x, y, k in zip(a, b, need):
            pair = (min(x, y), max(x, y))
            times[pair] = times.get(pair, 0) + (nearcopies.MEET if k < nearcopies.MEET else 1)
    want = {(j, i) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= similarity * len(np.union1d(sets[i], sets[j])) - 1e-9}
    assert want <= {p for p, k in times.items() if k >= nearcopies.MEET}


def test_seldom_tokens_come_first_however_much_there_is():
    """Tokens of a few times the mean stay behind seldom ones where the mean is large, as in much data."""
    counts = np.full(nearcopies.CELLS, 500)
    counts[:6] = 3, 1500, 2500, 5000, 15_000, 10**8
    rank = nearcopies.ranks(counts)
    assert rank[0] == rank[6] == 0 and (np.diff(rank[1:6].astype(int)) > 0).all() and rank[1] > 0 and rank[5] < 64


# 2


def _vectors():
    rng = np.random.default_rng(1)
    rows = []
    for g in range(60):
        centre = rng.standard_normal(64)
        rows += [(f"{g:02}-{k}", [float(x) for x in (centre + 0.15 * rng.standard_normal(64)) * rng.uniform(0.1, 9)]) for k in range(7)]
    rows += [(f"copy{i}", [2.0 * x for x in rows[0][1]]) for i in range(9)]
    return rows


def _brute_nearest(rows, k=5, least=0.9):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = np.round(x @ x.T, 6)
    return {(a, ids[j]) for i, a in enumerate(ids) for j in sorted((j for j in range(len(ids)) if j != i and cos[i, j] >= least), key=lambda j: (-cos[i, j], ids[j]))[:k]}


def test_nearest_recall(spark):
    rows = _vectors()
    bad = [("null", None), ("empty", []), ("short", [1.0]), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] + [1.0] * 63), (None, rows[0][1])]
    df = spark.createDataFrame(rows + rows[:5] + bad, "chunk_id string, vector array<float>").withColumn("id", F.lit(1)).withColumn("cls", F.lit(2))
    got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(df, "chunk_id", "vector", leaf=64).collect()}
    want = _brute_nearest(rows)
    assert len(got & want) >= 0.97 * len(want)
    # most levels cut in the tasks, as of very many vectors
    deep = {(r["id"], r["neighbour"]) for r in neighbours.nearest(df, "chunk_id", "vector", leaf=16, upper=2).collect()}
    assert len(deep & want) >= 0.97 * len(want)
    assert max(np.unique([a for a, _ in got], return_counts=True)[1]) <= 5
    assert {b for a, b in got if a == "copy8"} == {"00-0", "copy0", "copy1", "copy2", "copy3"}  # ties: the smaller ids


def test_nearest_of_nothing(spark):
    assert neighbours.nearest(spark.createDataFrame([], "chunk_id string, vector array<float>"), "chunk_id", "vector").collect() == []


def test_every_vector_has_its_neighbours(spark):
    rng = np.random.default_rng(4)
    subjects = rng.standard_normal((12, 64))
    far = [(f"far{i:03}", [float(x) for x in subjects[i % 12] + rng.standard_normal(64)]) for i in range(500)]
    rows = _vectors() + far
    df = spark.createDataFrame(rows + rows[:5] + [("null", None), ("zero", [0.0] * 64)], "chunk_id string, vector array<float>")
    want = _brute_nearest(rows, least=-1)
    assert len(want) == 5 * len(rows)
    got = neighbours.nearest(df, "chunk_id", "vector", min_cos=None).collect()
    assert {(r["id"], r["neighbour"]) for r in got} == want and len(got) == len(want)  # one cell: exact
    # hot cells in tiles, none left out: all cells are visited
    tiled = neighbours.nearest(df, "chunk_id", "vector", min_cos=None, cell=40, visits=1000).collect()
    assert {(r["id"], r["neighbour"]) for r in tiled} == want
    some = neighbours.nearest(df, "chunk_id", "vector", min_cos=None, cell=40, visits=8).collect()
    assert len({(r["id"], r["neighbour"]) for r in some} & want) >= 0.95 * len(want)
    floor = {(r["id"], r["neighbour"]) for r in neighbours.nearest(df, "chunk_id", "vector", min_cos=0.5).collect()}
    assert floor == _brute_nearest(rows, least=0.5)
    assert neighbours.nearest(df.limit(0), "chunk_id", "vector", min_cos=None).collect() == []


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 0.01


# 3


@pytest.mark.parametrize(
    "text, want",
    [
        ("Ｔｈｅ １２", "The 12"), ("ﬁrm oﬀer", "firm offer"), ("a b　c d", "a b c d"), ("x​y­z﻿", "xyz"),
        ("été", "été"), ("re​́sumé", "résumé"), ("pаyment", "payment"), ("Κatel", "Katel"),
        ("привет", "привет"), ("приvет", "приvет"), ("пoкaз", "показ"), ("αβγ", "αβγ"), ("“quoted” – it’s … ½ ™", "“quoted” – it’s … ½ ™"),
        ("café São Řeka", "café São Řeka"), ("東京タワー", "東京タワー"), ("ﾊﾞｽ", "バス"), ("", ""), (None, None), ("Ь", "Ь"),
    ],
)
def test_consistent_form(text, want):
    assert canonical.consistent_form(text) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abeoасеοκ́̈​ ＡＢ１ﬁ漢 .é­"), max_size=30))
def test_consistent_form_is_stable(text):
    once = canonical.consistent_form(text)
    assert canonical.consistent_form(once) == once


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeoAOsd\u0301\u0300\u0302\u0323\u0327\u0345\u0307\u0338éếẹ\u01d6각\u1100\u1161\u11a8\u09c7\u09be ."), max_size=12))
def test_transducer_composes_as_unicode_does(text):
    """Without widths, blanks, invisible characters and borrowed letters the form is the composed one of Unicode."""
    assert canonical.consistent_form(text) == unicodedata.normalize("NFC", text)


def test_changed_rows(spark):
    rows = [("1", "plain"), ("2", "pаyment"), ("2", "pаyment"), ("3", None), (None, "ﬁ"), ("4", "é" * 5), ("5", "x" * 100_000 + "​"), ("6", "Привет мир")]
    df = spark.createDataFrame(rows, "id string, content string").withColumn("row_key", F.lit("clash"))
    got = canonical.changed_rows(df, F.col("id"), F.col("content"), "t")
    assert sorted(map(tuple, got.collect())) == [("t", "2"), ("t", "5")]
    assert canonical.changed_rows(df.limit(0), F.col("id"), F.col("content"), "t").collect() == []


# 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "a", "\n\n", "\n", ". ", ", ", " ", "x" * 90]), max_size=400), st.integers(20, 60))
def test_pieces_cover_the_text(parts, size):
    text = "".join(parts)
    got = pieces.split_points(text, size, size // 8)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(len(text[a:b]) // 4 <= size for a, b in got)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert b - (4 * (size // 8) + 3) <= c <= b < d and c > a


def test_pieces_cut_at_the_strongest_boundary():
    text = "w " * 800 + "\n\n" + "v " * 800
    assert text[: pieces.split_points(text)[0][1]].endswith("\n\n")
    assert pieces.split_points("x" * 5000)[0] == (0, 2051)


def test_range_maximum():
    values = np.random.default_rng(2).integers(0, 4, 300).astype(np.int8)
    table = pieces.RangeMaximum(values, 64)
    for lo in range(0, 236, 7):
        for n in (1, 2, 33, 64):
            part = values[lo : lo + n]
            assert table.argmax(lo, lo + n) == lo + int(np.flatnonzero(part == part.max())[-1])


def test_split_oversized(spark):
    rows = [("a", "x y " * 1000), ("a", "x y " * 1000), ("b", "short"), ("c", None), (None, "x" * 9000), ("d", "q" * 200_000), ("e", "")]
    df = spark.createDataFrame(rows, "id string, content string").withColumn("piece", F.lit(9))
    got = pieces.split_oversized(df, F.col("id"), F.col("content")).collect()
    assert {r["row_key"] for r in got} == {"a", "d"}
    assert all(len(r["content"]) // 4 <= 512 and len(r["content"]) == r["end_at"] - r["start_at"] for r in got)
    assert pieces.split_oversized(df.limit(0), F.col("id"), F.col("content")).collect() == []


# 5


def test_found_lines(spark):
    pages = [(f"d{i}", 1, f"Share this page {i}\n| table {i} |\nITEM 1. Same\nown words {'abcdefgh'[i]}\nLegal notice\n12") for i in range(8)]
    pages += [pages[0], ("d0", 2, "SHARE  this page 77"), ("d1", 2, None), ("zz", 1, "Share this page 1"), (None, 1, "Share this page 1")]
    filings = [(f"d{i}", "s" if i < 5 else "t") for i in range(8)] + [("d0", "s"), ("e", None), (None, "s")]
    p = spark.createDataFrame(pages, "doc_id string, number int, content string").withColumn("site", F.lit("clash")).withColumn("line_no", F.lit(1))
    f = spark.createDataFrame(filings, "doc_id string, site string").withColumn("content", F.lit("clash"))
    got = {tuple(r) for r in sitelines.found_lines(p, f).collect()}
    want = {(f"d{i}", 1, n) for i in range(5) for n in (0, 4)} | {("d0", 2, 0)}  # source t has three documents only
    assert got == want
    left = {(r["doc_id"], r["number"]): r["content"] for r in sitelines.without_lines(p, sitelines.found_lines(p, f)).collect()}
    assert left["d1", 1] == "| table 1 |\nITEM 1. Same\nown words b\n12" and left["d1", 2] is None and left["d6", 1] == pages[6][2]
    assert sitelines.found_lines(p.limit(0), f.limit(0)).collect() == []


# 6


def test_ids_are_those_of_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["Hello  world", "", None, "   ", "it's 3.14 <|endoftext|>", "Größe 漢字 ไทย मानक 👩‍🔧", "a" * 700, "\n\n\t x", "don't I'LL\r\n", " x　y", "same same same " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("ids", F.lit(1))
    df = df.union(df.where("doc_id = 0"))
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode(df, "doc_id", "text", VOCABULARY).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    back = spark.createDataFrame([(k, v) for k, v in got.items()] + [(99, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in tokenizer.decode(back, "doc_id", "ids", VOCABULARY).collect()} == {**{i: x or "" for i, x in enumerate(texts)}, 99: None}
    assert tokenizer.encode(df.limit(0), "doc_id", "text", VOCABULARY).collect() == []
    # each text of a key by itself, null keys too
    several = spark.createDataFrame([(1, "hello world"), (1, "other text here"), (None, "hello world"), (None, "x")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["ids"]) for r in tokenizer.encode(several, "doc_id", "text", VOCABULARY).collect()), key=str) == sorted(
        ((k, t.encode(x, add_special_tokens=False).ids) for k, x in [(1, "hello world"), (1, "other text here"), (None, "hello world"), (None, "x")]), key=str
    )


def test_long_words_and_whole_pieces():
    """A piece of the vocabulary merges to itself, which the lookup of whole words relies on; a blob of a megabyte ends."""
    known = tokenizer.ranks(VOCABULARY)
    assert all(tokenizer.merged_long(piece, known) == [rank] for piece, rank in known.items())
    rng = random.Random(2)
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ") for _ in range(1_000_000)).encode()
    names = {v: k for k, v in known.items()}
    assert b"".join(names[i] for i in tokenizer.merged_long(blob, known)) == blob
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.json")
    for n in (1, 2, 50, 3000):
        assert tokenizer.merged_long(blob[:n], known) == t.encode(blob[:n].decode(), add_special_tokens=False).ids


# 7


def test_leaks(spark):
    passage = "When the Kelulvik toll house in Firelck closed in 1762 its 76 lanterns were carried by barge to the coast"
    items = [(1, passage, "short question"), (2, None, None), (None, passage, ""), (3, "", "What would happen if the ferry of Gorby sank with 9 crates of salt near Dax today")]
    exact = passage.lower().replace(" in ", " -- in, ")
    docs = [(10, f"Well. {exact} and more"), (10, f"Well. {exact} and more"), (11, passage.replace("76", "95").replace("1762", "1801")), (12, None), (13, ""), (None, passage), (14, " ".join(passage.split()[:11])), (15, "x " * 50_000 + items[3][2])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("template", F.lit(1)).withColumn("eval_id", F.lit(7))
    e = spark.createDataFrame(items, "eval_id long, passage string, question string").withColumn("text", F.lit("clash")).withColumn("doc_id", F.lit(1))
    assert sorted(map(tuple, leaks.leaks(d, e).collect())) == [(10, 1), (15, 3)]
    assert {(r["doc_id"], r["eval_id"]) for r in leaks.reparameterised(d, e).collect()} == {(11, 1)}
    assert leaks.leaks(d.limit(0), e).collect() == [] and leaks.leaks(d, e.limit(0)).collect() == []
    assert leaks.reparameterised(d.limit(0), e).collect() == [] and leaks.reparameterised(d, e.limit(0)).collect() == []


def test_replaced_values_must_be_consistent(spark):
    item = "On the way to Kelulvik the 12 boats of Kelulvik carried 40 kg of salt for the long winter feast"
    docs = [
        (1, item.replace("Kelulvik", "Umbrath").replace("kg", "tons")), (2, item.replace("Kelulvik", "Umbrath", 1)), (3, item.replace("12", "dozen")), (4, item.replace("winter", "summer")),
        (5, item), (6, item.replace("40", "12")), (7, item.replace("12", "12,5")),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(9, "Well, Kelulvik " + item, None)], "eval_id long, passage string, question string")
    # new names and units; one name for two places only in windows with one of them; no number; another plain word, outside of some windows
    got = {r["doc_id"] for r in leaks.reparameterised(d, e).collect()}
    assert 1 in got and 5 not in got and 4 not in got
    assert {tuple(r) for r in leaks.leaks(d, e).collect()} >= {(5, 9)}


def test_no_name_and_no_window_is_left_out(spark, monkeypatch):
    """More names than texts are typed by are slots all the same, and words of a window's own needn't stand side by side."""
    item = "later that day Umbra sold nine red lamps to Kelu and left for Gorby with the old mule of Dax"
    apart = "he met Alu and saw Belu but not Celu or even Delu again"  # no three words of its own side by side
    renamed = [item.replace(x, "Vorn") for x in ("Umbra", "Kelu", "Gorby")] + [apart.replace("Belu", "Zork").replace("Delu", "Mirk")]
    d = spark.createDataFrame(list(enumerate(renamed)), "doc_id long, text string")
    e = spark.createDataFrame([(7, item, None), (8, apart, None)], "eval_id long, passage string, question string")
    want = {(0, 7), (1, 7), (2, 7), (3, 8)}
    assert {(r["doc_id"], r["eval_id"]) for r in leaks.reparameterised(d, e).collect()} == want
    monkeypatch.setattr(leaks, "NAMES", 1)
    assert {(r["doc_id"], r["eval_id"]) for r in leaks.reparameterised(d, e).collect()} == want
    same = spark.createDataFrame([(1, item.upper()), (2, apart)], "doc_id long, text string")
    assert {tuple(r) for r in leaks.leaks(same, e).collect()} == {(1, 7), (2, 8)}


def test_every_window_has_an_anchor():
    forms = leaks.anchor_forms()
    for mask in range(1 << leaks.WINDOW):
        own = {j for j in range(leaks.WINDOW) if mask >> j & 1}
        assert len(own) < leaks.OWN or any({o + p for p in f} <= own for f in forms for o in range(leaks.WINDOW - f[-1]))


def test_items_in_slices(spark, monkeypatch):
    want = {tuple(r) for r in queries.p7_found(spark, SF).collect()}
    monkeypatch.setattr(leaks, "WINDOWS", 3000)
    assert {tuple(r) for r in queries.p7_found(spark, SF).collect()} == want


def test_leaks_match_brute_force(spark):
    got = {tuple(r) for r in queries.p7_found(spark, SF).collect()}
    items: dict = {}
    for r in spark.read.parquet(f"{SF}/eval_items.parquet").collect():
        for t in (r["passage"], r["question"]):
            w = regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
            for k in range(len(w) - 11):
                items.setdefault(tuple(w[k : k + 12]), set()).add(r["eval_id"])
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = regex.findall(r"[\p{L}\p{N}]+", (r["text"] or "").lower())
        for k in range(len(w) - 11):
            want |= {(r["doc_id"], i) for i in items.get(tuple(w[k : k + 12]), ())}
    assert got == want and want


# 8


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL").select("text", F.lower(F.substring("lang", 1, 2))).collect()
    return sentences.fit([tuple(r) for r in rows])


@pytest.mark.parametrize(
    "text, want",
    [
        ("It broke. I sent it back.", ["It broke.", "I sent it back."]),
        ("It broke.I sent it back! Why?", ["It broke.", "I sent it back!", "Why?"]),
        ("It weighs approx. 27.6 kg, i.e. less than the old backpack.", None),
        ("“Is it loud?” my flatmate asked.", None),
        ("I gave one to Prof. Deltorck, and now the whole lab wants it.", None),
        ("The box lists screws, clips, tape, etc. Dr. Dorsorton next door has the olive one.", ["The box lists screws, clips, tape, etc.", "Dr. Dorsorton next door has the olive one."]),
        ("„Endlich einmal Qualität!“ rief meine Frau.", None),
        ("« Quelle merveille ! » a dit ma voisine.", None),
        ("朋友问“会不会吵？”的时候我还没拆开。58分钟就装好了！", ["朋友问“会不会吵？”的时候我还没拆开。", "58分钟就装好了！"]),
        ("「買ってよかった。」と母が言いました。", None),
        ("สีสวยกว่าในรูป ส่งเร็วและห่อดีมาก", ["สีสวยกว่าในรูป", "ส่งเร็วและห่อดีมาก"]),
        ("Quiet motor. 👍 It arrived late!!!", ["Quiet motor. 👍", "It arrived late!!!"]),
        ("one line\r\n\n  another line  ", ["one line", "another line"]),
        ("سألني د. Miinby عن السعر؟", None), ("डॉ. Relmar ने भी यही थैला खरीदा।", None),
        ("It does not fit. The lid leaks.", ["It does not fit.", "The lid leaks."]), ("it does not fit. the lid leaks.", ["it does not fit.", "the lid leaks."]),
        ("OllinのVer.11.1と比べました。サイズは9.1cmです。", ["OllinのVer.11.1と比べました。", "サイズは9.1cmです。"]),
        ("no mark at all", None), ("", []), ("  \n ", []), (None, []),
    ],
)
def test_sentences(model, text, want):
    assert [text[a:b] for a, b in sentences.sentences(text, model)] == ([text] if want is None else want)


def test_point_classes():
    """A word whose points never end a line is an abbreviation, one whose points do isn't, and too few tell nothing."""
    lines = ["Ask Dr. Bo now.", "See Dr. Mi. She is in.", "We met Dr. Al. He left."] * 10 + ["It is in. Go on.", "Some x."]
    found = sentences.point_classes([(sentences.tokens_of(x), False) for x in lines])
    assert found["dr", "."] == "A" and found["left", "."] == "F" and found["now", "."] == "F" and ("x", ".") not in found


def test_sentences_lose_nothing(model, spark):
    for (text,) in spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").select("text").collect():
        spans = sentences.sentences(text, model)
        assert all(text[a:b] == text[a:b].strip() != "" for a, b in spans)
        at = 0
        for a, b in spans:
            assert a >= at and not text[at:a].strip()
            at = b
        assert not text[at:].strip()


def test_split_sentences(spark):
    rows = [(1, "One. Two."), (1, "One. Two."), (2, None), (3, " "), (None, "Key missing."), (4, "word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("start_at", F.lit(2))
    got = sorted(((r["doc_id"], r["start_at"], r["end_at"]) for r in sentences.split_sentences(df, "doc_id", "text").collect()), key=str)
    assert (None, 0, 12) in got and (4, 0, 199_999) in got and {r[0] for r in got} == {1, 4, None} and len(got) == len(set(got))
    assert sentences.split_sentences(df.limit(0), "doc_id", "text").collect() == []


def test_the_model_is_fitted_on_every_text(spark):
    """Parted in any way, all texts give the model that one place makes of them; none is left to a sample."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").select("text", F.lower(F.substring("lang", 1, 2)).alias("lang")).distinct()
    more = spark.range(9000).select(F.concat(F.lit("We met Dr. Qi"), "id", F.lit(" at no. "), "id", F.lit(". It is a lamp")).alias("text"), F.lit("en").alias("lang"))
    texts = rows.unionByName(more)
    want = sentences._packed(sentences.fit([tuple(r) for r in texts.collect()]))
    assert sentences._packed(sentences.fit_all(texts)) == want
    assert sentences._packed(sentences.fit_all(texts.unionByName(rows).repartition(7))) == want
    assert want[0][1]["no", "."] == "A" and sentences.fit_all(texts).tri["<s>", "<s>en", "we"] > 0.9 * 9000**0.75


def test_every_problem_has_its_query():
    names = queries.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 7, 8)} | {"p6_ids"} <= set(names)
