"""Problem 3: visually identical text with different characters.

A transducer, compiled once by rule from the Unicode tables that Python ships, reads a text cluster by cluster in one pass:
a character is folded (width, blank, ligature; what is invisible vanishes), its marks are put in their order, and the letter
and its marks go through the transitions of composition as far as they lead, which is the longest match; what takes no
further transition stays. Letters borrowed from another script are replaced by a mapping, compiled too, when their word
ends, and then take the marks that follow them. No key has two results and no result is mapped again: that is checked.
Texts that hold no character the mapping could change never leave the JVM.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that look alike, as Latin, Greek, Cyrillic; "-" where a script has none.
LOOK_ALIKES = """
A Α А|B Β В|C - С|E Ε Е|H Η Н|I Ι І|J - Ј|K Κ К|M Μ М|N Ν -|O Ο О|P Ρ Р|S - Ѕ|T Τ Т|X Χ Х|Y Υ У|Z Ζ -
a α а|c ϲ с|e - е|h - һ|i ι і|j ϳ ј|k κ к|o ο о|p ρ р|s - ѕ|u υ -|v ν ѵ|x χ х|y γ у|d - ԁ|q - ԛ|Q - Ԛ|W - Ԝ|w - ԝ|G - Ԍ|Y - Ү|- Γ Г|- Π П|- Λ Л|- Φ Ф|- π п|- τ т|- φ ф
"""  # fmt: skip
# Letters too rare to be what a word of their script had in that place; they are replaced, never put in.
RARE = "ϲϳһѵԁԛԝԌҮ"
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC")


def _script(ch: str) -> str:
    name = unicodedata.name(ch, "")
    for s in SCRIPTS:
        if name.startswith(s):
            return s
    return name.split(" ", 1)[0]


def _single(ch: str) -> str:
    """What one character becomes by itself."""
    cat, name = unicodedata.category(ch), unicodedata.name(ch, "")
    if cat == "Cf":
        return ch if "NUMBER" in name or "SIGN" in name and "ARABIC" in name or "END OF AYAH" in name else ""
    if cat == "Zs":
        return " "
    tag = unicodedata.decomposition(ch)
    if tag.startswith(("<wide>", "<narrow>")) or tag.startswith("<") and " LIGATURE " in f" {name} ":
        return unicodedata.normalize("NFKC", ch)
    return unicodedata.normalize("NFC", ch)


class Transducer:
    """``single``: what a character is folded to; ``parts``: the letter and marks that a composed letter stands for;
    ``steps``: the letter that a letter and a mark (or a letter) become; ``order``: the order of a mark among marks;
    ``alike``: the letter of a script that a borrowed one looks like, by (script, letter), with its marks."""

    def __init__(self) -> None:
        self.single, self.parts, self.steps, self.order = {}, {}, {}, {}
        for code in (*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE1000)):  # the planes with letters, and tags
            ch = chr(code)
            if (to := _single(ch)) != ch:
                self.single[ch] = to
            if rank := unicodedata.combining(ch):
                self.order[ch] = rank
            pair = unicodedata.decomposition(ch)
            if pair and not pair.startswith("<"):
                self.parts[ch] = unicodedata.normalize("NFD", ch)
                letters = [chr(int(x, 16)) for x in pair.split()]
                if len(letters) == 2 and unicodedata.normalize("NFC", "".join(letters)) == ch:
                    self._add(self.steps, tuple(letters), ch)
        for code in range(11_172):  # syllables of Hangul, by their rule
            lead, vowel, tail = code // 588, code % 588 // 28, code % 28
            ch = chr(0xAC00 + code)
            self._add(self.steps, (chr(0x1100 + lead), chr(0x1161 + vowel)) if not tail else (chr(0xAC00 + code - tail), chr(0x11A7 + tail)), ch)
        for ch, to in self.single.items():
            if any(x in self.single for x in to):
                raise ValueError(f"{ch!r} becomes {to!r}, which is mapped again")
        self.alike: dict[tuple[str, str], str] = {}
        for row in LOOK_ALIKES.replace("\n", "|").split("|"):
            letters = row.split()
            for i, a in enumerate(letters):
                for j, b in enumerate(letters):
                    if i != j and "-" not in (a, b) and b not in RARE:
                        self.alike.setdefault((SCRIPTS[j], a), b)
        for (script, a), b in self.alike.items():
            if _script(b) != script or _script(a) == script:
                raise ValueError(f"{a!r} to {b!r} doesn't lead to {script}")
        for ch, parts in self.parts.items():  # the same with marks, where the other script has that letter
            for script in SCRIPTS:
                if (to := self.alike.get((script, parts[0]))) is not None and _script(ch) != script:
                    whole, left = self.composed(to, list(parts[1:]))
                    if not left:
                        self._add(self.alike, (script, ch), whole)

    @staticmethod
    def _add(table: dict, key: tuple, value: str) -> None:
        if table.setdefault(key, value) != value:
            raise ValueError(f"{key!r} has two results, {table[key]!r} and {value!r}")

    def composed(self, letter: str, marks: list[str]) -> tuple[str, list[str]]:
        """The letter with the marks that it takes, and those that it doesn't, in their order."""
        left: list[str] = []
        for m in marks:
            if (not left or self.order.get(left[-1], 0) < self.order.get(m, 0)) and (to := self.steps.get((letter, m))) is not None:
                letter = to
            else:
                left.append(m)
        return letter, left

    def cluster(self, letter: str, marks: list[str]) -> tuple[str, list[str]]:
        if not marks:
            return letter, marks
        whole = self.parts.get(letter, letter)
        return self.composed(whole[0], sorted([*whole[1:], *marks], key=lambda m: self.order.get(m, 0)))

    def run(self, text: str) -> str:
        out: list[str] = []
        word: list[tuple[str, list[str]]] = []
        letter, marks = "", []

        def end() -> None:
            """The cluster is over: a letter joins its word, anything else ends it."""
            nonlocal letter, marks
            if letter or marks:
                whole = self.cluster(letter, marks) if letter else ("", sorted(marks, key=self.order.__getitem__))
                if letter.isalpha() or word and unicodedata.category(letter or marks[0])[0] == "M":
                    word.append(whole)
                else:
                    settle()
                    out.append(whole[0] + "".join(whole[1]))
            letter, marks = "", []

        def settle() -> None:
            """Give the letters of the word the script that most of them have."""
            if word:
                seen = [_script(c) if c.isalpha() else "" for c, _ in word]
                counts = Counter(s for s in seen if s)
                script, most = counts.most_common(1)[0] if counts else ("", 0)
                mixed = len(counts) > 1 and 2 * most > sum(counts.values()) and script in SCRIPTS
                for (c, left), s in zip(word, seen):
                    if mixed and s and s != script and (to := self.alike.get((script, c))) is not None:
                        c, left = self.cluster(to, left)
                    out.append(c + "".join(left))
                word.clear()

        for ch in text:
            for c in self.single.get(ch, ch):
                if c in self.order:
                    marks.append(c)
                    continue
                if letter:
                    whole, left = self.cluster(letter, marks)
                    if not left and (to := self.steps.get((whole, c))) is not None:
                        letter, marks = to, []
                        continue
                end()
                letter = c
        end()
        settle()
        return "".join(out)


@lru_cache(1)
def compiled() -> Transducer:
    return Transducer()


#: A run of letters with their marks and what is invisible among them, or any other character outside ASCII.
SPANS = regex.compile(r"[\p{L}\p{M}\p{Cf}]*[^\x00-\x7F][\p{L}\p{M}\p{Cf}]*")


@lru_cache(200_000)
def _span(text: str) -> str:
    return compiled().run(text)


def consistent_form(text: str | None) -> str | None:
    """The consistent form of one text; null stays null. Applying it twice changes nothing more.

    >>> consistent_form("Ｔhe \\u200bﬁrm\\u00a0раid")
    'The firm paid'
    """
    if text is None or text.isascii():
        return text
    return SPANS.sub(lambda m: _span(m[0]), text)


@lru_cache(1)
def _ranges() -> str:
    """The characters that never stay as they are, as a class of Java's patterns."""
    codes, out = sorted(ord(c) for c in compiled().single), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


def may_change(text: Column) -> Column:
    """True where the consistent form may differ: a necessary condition, tested without leaving the JVM."""
    seen = "[^\\x00-\\x7F]"  # found fast; what it is, is looked up only then
    alone = text.rlike(f"{seen}(?<=[\\p{{M}}{_ranges()}])")
    other = text.rlike(f"{seen}(?<=[\\p{{IsGreek}}\\p{{IsCyrillic}}])")
    mixed = "|".join(f"\\p{{Is{s}}}[\\p{{L}}&&[^\\p{{Is{s}}}]]|[\\p{{L}}&&[^\\p{{Is{s}}}]]\\p{{Is{s}}}" for s in ("Greek", "Cyrillic"))
    return (F.octet_length(text) != F.length(text)) & (alone | (other & text.rlike(mixed)))


@F.pandas_udf(T.StringType())
def _form(s: pd.Series) -> pd.Series:
    return s.map(consistent_form, na_action="ignore")


def consistent(text: Column) -> Column:
    """The consistent form as a column: only texts that may change are sent to Python."""
    return F.coalesce(_form(F.when(may_change(text), text)), text)


def changed_rows(df: DataFrame, key: Column, content: Column, tbl: str) -> DataFrame:
    """(tbl, row_key) of the rows whose content differs from its consistent form.

    Null contents and keys give no row, repeated rows one; other columns of ``df`` are not read.
    """
    rows = df.select(key.alias("row_key"), content.alias("content")).where(F.col("row_key").isNotNull() & may_change(F.col("content")))
    return rows.where(_form("content") != F.col("content")).select(F.lit(tbl).alias("tbl"), "row_key").distinct()
