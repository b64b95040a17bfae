"""Per-document text statistics and a verdict: prose, list, table or junk.

A text of more than WINDOW characters is cut into chunks, and only where a cut cuts nothing: after a space between two words of a long
plain run (no markup, entity or line break near). A chunk yields additive counts, the judged counts of the segments that lie wholly inside,
and the state of its two ends: the last characters of its cut lines, and the open segments as summaries (Segment), which join to the
summary of the whole segment. So chunks merge associatively to exactly what the uncut text gives (``merge``), verdict included. Ordinary
texts are one chunk and merge with nothing; chunks of huge ones merge in a tree of FAN per level.

The verdict weighs characters: each segment (line, table row, sentence) is prose, list, table or junk by what it holds, and a text is what
the most of its characters are; it is prose unless more than half of them are not. Which common words speak for a sentence is fitted on
labelled documents, since some of them ("for", "de") join nouns in lists as well. Scripts without common words are judged by their form.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 32_768
FAN = 256
#: Characters without markup or line break on both sides of a cut.
PLAIN = 256
#: The common words are looked up in every task; more of them are an error.
MAX_COMMON = 10_000
#: Labelled documents that the fit takes, at most; a word seen in so many lists, tables and texts of junk is no sign of a sentence if the
#: share of these that hold it is at least this part of the share of prose that does. A few wrong labels leave the ratio far below.
LABELLED, SEEN, SHARE = 5_000, 3, 0.3
#: Least share of sentence-making common words in a segment of prose.
PROSE_SHARE = 0.08
#: What digits and signs of markup add to that, by their share of the visible characters.
MARKS_SHARE = 2.0

COUNTS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_punct_lines", "n_common", "prose_chars", "list_chars", "table_chars", "junk_chars", "repeat_chars", "short_chars", "n_short"]
STATE = ", ".join(f"{c} bigint" for c in COUNTS) + ", head_line string, tail_line string, has_break boolean, head_piece binary, tail_piece binary, only_piece binary, first_key string, last_key string"
TERMINAL = frozenset(".!?…。！？:;\"'»”)")

_RUN = re.compile(r"(?:[^\W\d_]|['’])+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SYMBOL = re.compile(r"[^\w\s]|_")
_LINE_ENDS = "\n\r  \u0085"
_LINES = re.compile(rf"[{_LINE_ENDS}]+")
_BREAK = re.compile(rf"\r\n|[{_LINE_ENDS}]|<br\s*/?>|</?(?:tr|p|li|div|ul|ol|table)(?:\s[^<>]{{0,200}})?>", re.I)
_CELL = re.compile(r"</?t[dh](?:\s[^<>]{0,200})?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_SENTENCE = re.compile(r"(?<=[^\W\d_][.!?;])\s+|(?<=[!?。！？])\s*")
_ZERO = dict.fromkeys(map(ord, "​‌‍⁠﻿­"), None)
_BULLET = re.compile(r"\s*(?:[*\-•·‣▪–—✓✔>»○◦+#●]+|\(?\d{1,3}[.)]|\d{1,3}\s|[a-z][.)])\s*\S")
_KANA = re.compile(r"[ぁ-ゟ]")
_CJK = re.compile(r"[ぁ-ヿ㐀-鿿]")
_CJK_STOPS = re.compile(r"[。！？，]")
_LATIN = re.compile(r"[a-zA-ZÀ-ɏ]")
_DIGIT = re.compile(r"\d")
_LEADER = re.compile(r"(?<=..)(?: {3,}|\.{4,})(?=.)")
_PAIR = re.compile(r"\S[^=:;]{0,30}\s?[=:;]\s?\S{1,30}")
_NOISE = re.compile(r"[{}\[\]\\|~^_=<>@#$%&*+/�□¿Ã¢€¤©ƒ\x00-\x08\x0e-\x1f]")
#: Modulus of the keys by which segments are compared across chunks.
_PRIME = (1 << 61) - 1


class Segment:
    """What the judgement of a segment reads, so that two pieces of a segment join to the segment."""

    #: All of these add up.
    ADDED = ("size", "words", "letters", "hits")
    SUMS = ("length", "short_words", "noise", "digits", "cjk", "kana", "stops", "latin", "vowels", "cells", "pipes", "squares", "leaders", "commas")
    #: What is stored of a piece.
    FACTS = (*SUMS, "letters_seen", "bullet", "pair", "first_field", "last_field", "inner_field", "key", "width")
    __slots__ = (*FACTS, "text", "inside", "lower", "size", "words", "letters", "hits")

    def __init__(self, text: str, strong: frozenset[str], inside: bool = False) -> None:
        """Of a whole segment or a piece of one, stripped where the segment ends; ``inside``: the piece does not start the segment. What most
        judgements do without is worked out when it is asked for."""
        self.text, self.inside = text, inside
        self.lower = text.lower()
        words = _WORD.findall(self.lower)
        if "’" in text:
            words = [w.replace("’", "'") for w in words]
        self.size = len("".join(text.split()))
        self.words, self.letters = len(words), len("".join(words))
        self.hits = sum(map(strong.__contains__, words))

    def __getattr__(self, name: str):
        value = _FACTS[name](self)
        setattr(self, name, value)
        return value

    def join(self, other: Segment) -> Segment:
        """The segment of this piece followed by the other; the pieces meet between words of plain text."""
        out = object.__new__(Segment)
        for f in (*self.ADDED, *self.SUMS):
            setattr(out, f, getattr(self, f) + getattr(other, f))
        seen = set(self.letters_seen) | set(other.letters_seen)
        out.letters_seen = "".join(sorted(seen)[:4])
        out.bullet, out.pair = self.bullet, self.pair
        middle = self.last_field + other.first_field
        inner = [self.inner_field, other.inner_field]
        if self.commas and other.commas:
            inner.append(middle)
        out.first_field = self.first_field if self.commas else middle
        out.last_field = other.last_field if other.commas else middle
        out.inner_field = max(inner)
        out.key = (self.key * pow(256, other.width, _PRIME) + other.key) % _PRIME
        out.width = self.width + other.width
        return out

    def pack(self) -> bytes:
        return repr([getattr(self, f) for f in (*self.ADDED, *self.FACTS)]).encode()

    @classmethod
    def unpack(cls, raw: bytes) -> Segment:
        import ast

        out = object.__new__(cls)
        for f, v in zip((*cls.ADDED, *cls.FACTS), ast.literal_eval(raw.decode())):
            setattr(out, f, v)
        return out

    def row(self) -> bool:
        """A table row by separators, leaders, short fields between commas or a name before a value."""
        short = self.commas and 1 <= self.first_field <= 30 and self.inner_field <= 20 and self.last_field <= 20
        return bool(self.cells or self.pipes >= 2 or self.leaders or short or self.pair)

    def few_vowels(self) -> bool:
        """Letters that no language strings together: one or two repeated, or hardly a vowel in Latin script."""
        return self.letters >= 8 and (len(self.letters_seen) <= 3 or (2 * self.latin > self.letters and self.vowels < 0.22 * self.letters))

    def kind(self) -> str:
        """prose, list, table, junk, or '' for a segment too short to tell."""
        n, size, letters = self.words, self.size, self.letters
        if self.cjk > 0.3 * size:
            # kana between ideographs, or a sentence's own marks, tell a sentence from a row of nouns
            return "prose" if self.kana > 0.2 * self.cjk or (self.stops and self.kana + self.cjk >= 8 and not self.cells) else "list"
        # the more of it is no letter, the more common words a sentence needs to be told from a row of labels
        if n and self.hits >= (PROSE_SHARE + MARKS_SHARE * (self.noise + self.digits) / size) * n and letters >= 0.5 * size:
            return "prose"
        if self.cells or (self.pipes >= 2 and not self.squares):
            return "table"
        if self.noise > 0.25 * size and not self.bullet:
            return "junk"
        if n < 4 and size < 40 and not self.bullet and not self.row() and letters > 0.6 * size:
            return "junk" if self.few_vowels() else ""
        if 2 * self.latin < letters and n >= 4 and letters >= 0.6 * size and not self.bullet and not self.pair and self.short_words >= 0.1 * n:
            return "prose"  # no common words are known in this script
        if self.row() and not self.bullet:
            return "table"
        if letters < 0.5 * size:
            return "junk"
        if self.bullet:
            return "list"
        return "junk" if self.few_vowels() else "list"


def _fields(s: Segment) -> list[int]:
    return [len(f) for f in s.text.split(",")]


def _unless_ascii(pattern: re.Pattern):
    return lambda s: 0 if s.text.isascii() else len(pattern.findall(s.text))


_FACTS = {
    "length": lambda s: len(s.text),
    "short_words": lambda s: sum(1 for w in _WORD.findall(s.lower) if len(w) <= 3),
    "noise": lambda s: len(_NOISE.findall(s.text)),
    "digits": lambda s: len(_DIGIT.findall(s.text)),
    "cjk": _unless_ascii(_CJK),
    "kana": _unless_ascii(_KANA),
    "stops": _unless_ascii(_CJK_STOPS),
    "latin": lambda s: len(_LATIN.findall(s.text)),
    "vowels": lambda s: sum(map(s.lower.count, "aeiouyäöüéèáíóú")),
    "cells": lambda s: s.text.count("\x1f") + s.text.count("\t"),
    "pipes": lambda s: s.text.count("|"),
    "squares": lambda s: s.text.count("["),
    "leaders": lambda s: len(_LEADER.findall("xx" + s.text if s.inside else s.text)),
    "commas": lambda s: s.text.count(","),
    "first_field": lambda s: _fields(s)[0],
    "last_field": lambda s: _fields(s)[-1],
    "inner_field": lambda s: max(_fields(s)[1:-1], default=0),
    "letters_seen": lambda s: "".join(sorted(set(s.lower))[:4]),
    "bullet": lambda s: _BULLET.match(s.text) is not None,
    "pair": lambda s: _PAIR.match(s.text) is not None,
    "key": lambda s: int.from_bytes(s.text.encode("utf-8", "surrogatepass"), "big") % _PRIME,
    "width": lambda s: len(s.text.encode("utf-8", "surrogatepass")),
}


def _plain(run: str) -> str:
    """The word in a run of lower-case letters and apostrophes, as common words are written; empty if it has no letter."""
    return run.strip("'’").replace("’", "'") if "'" in run or "’" in run else run


def segments(text: str, starts: bool = True, ends: bool = True) -> list[str]:
    """Lines, table rows and sentences of a chunk, markup taken out. Short lines are one segment; a line that a cut goes through is long."""
    t = text
    if "<" in t:
        t = _TAG.sub(" ", _BREAK.sub("\n", _CELL.sub("\x1f", t)))
    if "&" in t:
        t = html.unescape(t)
    if not t.isascii():
        t = t.translate(_ZERO)
    out = []
    lines = _LINES.split(t)
    for i, line in enumerate(lines):
        long = len(line) > 60 or (i == 0 and not starts) or (i == len(lines) - 1 and not ends)
        out += [p for p in _SENTENCE.split(line) if p] if long else [line]
    return out


def _key(s: Segment) -> str:
    return f"{s.key}.{s.width}.{s.size}"


def _same(a: str | None, b: str | None) -> int:
    """The visible characters of a segment that says what the one before it said; one of a few characters does not count."""
    size = int(b.rsplit(".", 1)[1]) if a and a == b else 0
    return size if size > 8 else 0


def state_of(text: str, common: frozenset[str], strong: frozenset[str], starts: bool = True, ends: bool = True) -> tuple:
    """The mergeable state of one chunk, in the order of STATE; ``starts`` and ``ends`` tell whether the text starts and ends with it."""
    words = [w for w in map(_plain, _RUN.findall(text.lower())) if w]
    lines = text.replace("\r\n", "\n").split("\n")
    last = [line.rstrip()[-1:] for line in lines]
    weight = {"prose": 0, "list": 0, "table": 0, "junk": 0, "": 0}
    repeat, short, first_key, before = 0, 0, None, None
    pieces: list[bytes | None] = [None, None, None]
    parts = segments(text, starts, ends)
    for i, part in enumerate(parts):
        opens, closes = i == 0 and not starts, i == len(parts) - 1 and not ends
        if opens or closes:
            piece = part if opens and closes else part.rstrip() if opens else part.lstrip()
            pieces[2 if opens and closes else 0 if opens else 1] = Segment(piece, strong, opens).pack()
            continue
        part = part.strip()
        if not part:
            continue
        s = Segment(part, strong)
        kind = s.kind()
        weight[kind] += s.size
        short += kind == ""
        if before is not None and part == before.text and s.size > 8:
            repeat += s.size
        first_key, before = first_key or _key(s), s
    closed = last[1:-1]
    return (
        len(text), len(words), sum(len(w) - w.count("'") for w in words), len(_SYMBOL.findall(text)), sum(1 for e in closed if e), sum(1 for e in closed if e in TERMINAL and e), sum(map(common.__contains__, words)),
        weight["prose"], weight["list"], weight["table"], weight["junk"], repeat, weight[""], short,
        last[0], last[-1], len(lines) > 1, *pieces, first_key, before and _key(before),
    )


def merge(a: tuple, b: tuple) -> tuple:
    """The state of chunk a followed by chunk b. Associative: a line or segment that the cut went through is counted once."""
    k = len(COUNTS)
    counts = [x + y for x, y in zip(a[:k], b[:k])]
    a_first, a_last, a_break, a_head, a_tail, a_only, a_from, a_to = a[k:]
    b_first, b_last, b_break, b_head, b_tail, b_only, b_from, b_to = b[k:]
    joined = Segment.unpack(a_only or a_tail).join(Segment.unpack(b_only or b_head))
    head, tail, only, first_key, last_key = a_head, b_tail, None, a_from, b_to
    if a_only and b_only:
        only = joined.pack()
    elif a_only:
        head, first_key = joined.pack(), b_from
    elif b_only:
        tail, last_key = joined.pack(), a_to
    else:
        kind, key = joined.kind(), _key(joined)
        counts[{"prose": 7, "list": 8, "table": 9, "junk": 10, "": 12}[kind]] += joined.size
        counts[13] += kind == ""
        counts[11] += _same(a_to, key) + _same(key, b_from)
        first_key, last_key = a_from or key, b_to or key
    middle = b_first or a_last
    if a_break and b_break:
        counts[4] += bool(middle)
        counts[5] += middle in TERMINAL and bool(middle)
        first, last = a_first, b_last
    elif a_break:
        first, last = a_first, middle
    elif b_break:
        first, last = (b_first or a_first), b_last
    else:
        first = last = b_first or a_first
    return (*counts, first, last, a_break or b_break, head, tail, only, first_key, last_key)


def finish(s: tuple) -> tuple:
    """(n_lines, n_punct_lines) with the first and last line of the whole text."""
    first, last, broken = s[len(COUNTS) : len(COUNTS) + 3]
    ends = [first, last] if broken else [first]
    return s[4] + sum(1 for e in ends if e), s[5] + sum(1 for e in ends if e and e in TERMINAL)


def verdict(s: tuple) -> str | None:
    """prose, list, table or junk by most characters; None for a text without visible characters. Repetition of one segment is junk."""
    prose, listed, table, junk, repeat, short_chars, n_short = s[7:14]
    if not s[0] or not s[1] + s[3]:
        return None
    if n_short >= 3:  # a few bare words may be a remark, many are a list
        listed += short_chars
    total = prose + listed + table + junk
    if repeat > 0.5 * max(1, total):
        return "junk"
    if listed + table + junk > prose and total:
        return max((("list", listed), ("table", table), ("junk", junk)), key=lambda x: x[1])[0]
    if not total and s[3] > 2 * s[2] and s[3] > 3:
        return "junk"
    return "prose"


def chunk_pattern(window: int) -> str:
    """A chunk: at least ``window`` characters, up to the next place where a cut cuts nothing; the rest where there is none."""
    zero = "".join(map(chr, _ZERO))
    plain = rf"[^{_LINE_ENDS}{zero}<>&]"
    return rf"(?s).{{{window}}}.*?(?<={plain}{{{PLAIN - 2}}}\p{{L}} )(?=\p{{L}}{plain}{{{PLAIN - 1}}})|.+"


def sentence_words(common: frozenset[str], documents: DataFrame | None = None, labels: DataFrame | None = None) -> frozenset[str]:
    """The common words of more than one letter, without those that labelled documents show to be as usual in lists, tables and junk.

    labels: doc_id, label of a sample; at most LABELLED of them are taken, by the hash of the id. Without labels all words speak.
    """
    longer = frozenset(w for w in common if len(w) > 1)
    if documents is None or labels is None:
        return longer
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("label") == "prose").alias("prose")).where("doc_id IS NOT NULL AND prose IS NOT NULL")
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "prose").limit(LABELLED))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    texts = texts.select("prose", found.alias("found"))
    # as many rows as there are common words
    held = texts.select("prose", F.explode("found").alias("word")).where(F.col("word").isin(sorted(longer)))
    held = held.groupBy("word").agg(F.count(F.when(F.col("prose"), 1)).alias("p"), F.count(F.when(~F.col("prose"), 1)).alias("o"))
    total = F.broadcast(texts.agg(F.count(F.when(F.col("prose"), 1)).alias("all_p"), F.count(F.when(~F.col("prose"), 1)).alias("all_o")))
    usual = held.where(F.col("o") >= SEEN).crossJoin(total).where(F.col("o") * F.col("all_p") >= F.lit(SHARE) * F.col("p") * F.col("all_o"))
    return longer - {r[0] for r in usual.select("word").collect()}


def text_statistics(documents: DataFrame, common_words: DataFrame, window: int = WINDOW, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, n_chars, n_words, mean_word_length, symbol_ratio, punct_line_share, common_share, verdict: one row per row of documents,
    repeated and null doc_ids included. Ratios are null where nothing is counted; null, empty and blank texts have counts 0 and no verdict.
    No text is shuffled but the chunks of huge ones."""
    rows = common_words.select(F.lower("word")).where(F.col("word").isNotNull()).distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    common = frozenset(r[0] for r in rows)
    strong = sentence_words(common, documents, labels)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    # one pass over the characters; a text of one chunk is not copied
    cut = F.when(F.length("text") <= window, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(chunk_pattern(window)), F.lit(0)))
    chunks = docs.select("rid", "doc_id", cut.alias("c")).select("rid", "doc_id", F.size("c").alias("n"), F.posexplode("c").alias("no", "part"))
    names = ["rid", "doc_id", "no", *[c.split()[0] for c in STATE.split(", ")]]

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, *state_of(t, common, strong, no == 0, no == n - 1)) for r, t, no, n in zip(b.rid, b.part, b.no, b.n)]
            yield pd.DataFrame(rows, columns=["rid", *names[3:]]).assign(doc_id=b.doc_id, no=b.no)[names]

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no", kind="stable")
        state = None
        for row in pdf[names[3:]].astype(object).where(pdf[names[3:]].notna(), None).itertuples(index=False, name=None):
            state = row if state is None else merge(state, row)
        return pd.DataFrame([(pdf.rid.iloc[0], pdf.doc_id.iloc[0], int(pdf.no.iloc[0]) // FAN, *state)], columns=names)

    schema = f"rid bigint, doc_id bigint, no int, {STATE}"
    # huge texts are few but heavy: their chunks are spread before Python sees them
    first = chunks.where("n = 1").mapInPandas(states, schema)
    huge = chunks.where("n > 1").repartition("rid", "no").mapInPandas(states, schema)
    level = huge.groupBy("rid", F.floor(F.col("no") / FAN)).applyInPandas(joined, schema)
    top = level.groupBy("rid").applyInPandas(joined, schema)

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                doc, s = (None if row[1] != row[1] else row[1]), row[3:]
                lines, punct = finish(s)
                ratio = lambda x, y: x / y if y else None
                out.append((doc, s[0], s[1], ratio(s[2], s[1]), ratio(s[3], s[0]), ratio(punct, lines), ratio(s[6], s[1]), verdict(s)))
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share", "verdict"]).astype({"doc_id": "Int64"})

    return first.unionByName(top).mapInPandas(last, "doc_id bigint, n_chars bigint, n_words bigint, mean_word_length double, symbol_ratio double, punct_line_share double, common_share double, verdict string")


def not_prose(documents: DataFrame, common_words: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id of texts that are by most of their characters a list, a table or junk."""
    return text_statistics(documents, common_words, labels=labels).where(F.col("verdict").isin("list", "table", "junk")).select("doc_id")
