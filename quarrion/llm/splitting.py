"""Splitting oversized texts at natural boundaries, with overlap.

A text is tokenized once, whole; every cut is a token of that sequence. The cuts allowed come from a hierarchy:
sections, then paragraphs within sections that are too large, then lines, sentences, words and at last single
characters, each level only inside the parts that the level before left too large. Pieces are packed greedily
from these parts up to the limit; each after the first begins ``overlap`` tokens before the end of the one before
(more by up to three where that token begins inside a character).

A text within the limit gives no piece. Where a cut or a start lies inside a word, tokenizing the piece alone may
give other tokens than the whole text did; such a piece is counted again, and shortened until it fits, so no
piece exceeds the limit. A last piece of fewer than ``min_tokens`` takes over parts of the one before.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrion.llm.tokens import VOCABULARY, Tokenizer, tokenizer
from quarrion.session import spread

_SECTION = re.compile(r"\n(?=#{1,6} \S|(?:[A-Z]+ )?\d{1,3}\. [^\n]{1,80}\n|={3,}|-{3,})")
_PARAGRAPH = re.compile(r"\r?\n[^\S\n]*(?:\r?\n)+")
_LINE = re.compile(r"\r?\n")
_SENTENCE = re.compile(
    r"[.!?…](?<!\b[A-Za-z]\.)(?<!\b[DMSJ]r\.)(?<!\bSt\.)(?<!\bMt\.)(?<!\bN[or]\.)(?<!\bvs\.)(?<!\bca\.)(?<!\bcf\.)"
    r"(?<!\bProf\.)(?<!\bpág\.)(?<!\bvgl\.)(?<!\bbzw\.)(?<!\bSec\.)(?<!\bFig\.)(?<!\bart\.)(?<!\bDra\.)"
    r"[.!?…]*[\"”’»)\]]*(?=\s+[\"“«„(¿¡\[—]*[A-ZÀ-ÖØ-Þ0-9])|[。！？।॥؟]+[”」』）»]*"
)
_BLANKS = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
#: Levels from the coarsest, cut at the end of a match; words and characters come after them.
_LEVELS = (_SECTION, _PARAGRAPH, _LINE, _SENTENCE)
_WORDS, _CHARACTERS = len(_LEVELS), len(_LEVELS) + 1


def _kind(char: str) -> int:
    """Classes by which the tokenizer parts words: a cut between two of a class is inside one of its units."""
    return 0 if char.isspace() else 1 if char.isalpha() else 2 if char.isnumeric() else 3


class Splitter:
    """The cuts of one text, found level by level and only when asked for."""

    def __init__(self, text: str, coder: Tokenizer) -> None:
        self.text, self.coder = text, coder
        self.chars = coder.boundaries(text)
        self.size = len(self.chars) - 1
        self.valid = np.flatnonzero(self.chars >= 0)
        self.valid_chars = self.chars[self.valid]
        self._cuts: dict[int, np.ndarray] = {}
        self._counts: dict[tuple[int, int], int] = {}
        self._blank: np.ndarray | None = None

    def level(self, number: int) -> np.ndarray:
        """Token numbers at which level ``number`` may cut."""
        if number not in self._cuts:
            if number == _CHARACTERS:
                self._cuts[number] = self.valid
            elif number == _WORDS:
                blank, at = self.blank(), self.valid_chars
                self._cuts[number] = self.valid[blank[at] & ~blank[np.maximum(at - 1, 0)]]
            else:
                at = [m.end() for m in _LEVELS[number].finditer(self.text)]
                where = np.searchsorted(self.valid_chars, np.asarray(at, dtype=np.int64), "left")
                self._cuts[number] = np.unique(self.valid[np.minimum(where, len(self.valid) - 1)])
        return self._cuts[number]

    def blank(self) -> np.ndarray:
        """Whether each character is white space, and True at the end."""
        if self._blank is None:
            codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            known = np.zeros(int(codes.max(initial=0)) + 1, dtype=bool)
            known[_BLANKS[_BLANKS < len(known)]] = True
            self._blank = np.concatenate((known[codes], [True]))
            self.blank_tokens = self.valid[self._blank[self.valid_chars]].tolist()
        return self._blank

    def parts(self, largest: int) -> np.ndarray:
        """Cuts, from 0 to the end, such that no part between two exceeds ``largest`` tokens if that can be."""
        cuts = np.array([0, self.size])
        for number in range(_CHARACTERS + 1):
            big = np.flatnonzero(np.diff(cuts) > largest)
            if not len(big):
                break
            finer = self.level(number)
            inside = np.zeros(len(cuts), dtype=bool)
            inside[big] = True
            added = finer[inside[np.searchsorted(cuts, finer, "right") - 1]]
            if len(added):
                cuts = np.unique(np.concatenate((cuts, added)))
        return cuts

    def count(self, start: int, end: int) -> int:
        """Tokens of the piece [start, end) tokenized alone, counted again only where an edge is inside a unit."""
        known = self._counts.get((start, end))
        if known is None:
            known = self._counts[start, end] = self._count(start, end)
        return known

    def _count(self, start: int, end: int) -> int:
        text, a, b = self.text, int(self.chars[start]), int(self.chars[end])
        if b < len(text):
            if text[b - 1].isspace():
                body = len(text[a:b].rstrip()) + a
                if b - body > 1 and not text[b].isspace():  # a run of blanks is one unit at the end of a text
                    first = int(self.valid[np.searchsorted(self.valid_chars, body, "left")])
                    if self.chars[first] != body or first < start:
                        return self.coder.count(text[a:b])
                    return self.count(start, first) + self.coder.count(text[body:b]) if first > start else self.coder.count(text[a:b])
            if _kind(text[b - 1]) == _kind(text[b]):
                return self.coder.count(text[a:b])
        if a == 0 or text[a].isspace() or _kind(text[a - 1]) != _kind(text[a]) and not text[a - 1].isspace():
            return end - start
        self.blank()
        k = bisect_right(self.blank_tokens, start)
        stop = min(end, self.blank_tokens[k]) if k < len(self.blank_tokens) else end
        return self.coder.count(text[a : self.chars[stop]]) + end - stop

    def pieces(self, limit: int, overlap: int, least: int) -> list[tuple[int, int, int]]:
        """(first token, end token, tokens) of each piece."""
        cuts = self.parts(limit - overlap)
        ends: list[int] = []
        starts = [0]
        while True:
            start, done = starts[-1], ends[-1] if ends else 0
            end = self._end(cuts, start, done, limit, least)
            ends.append(end)
            if end >= self.size:
                break
            starts.append(self._back(end, overlap, start))
        if len(ends) > 1 and self.size - starts[-1] < least:
            for cut in cuts[(cuts > starts[-2] + least) & (cuts < ends[-2])][::-1]:
                start = self._back(int(cut), overlap, starts[-2])
                if self.count(start, self.size) > limit:
                    break
                if self.size - start >= least:
                    ends[-2], starts[-1] = int(cut), start
                    break
        return [(a, b, self.count(a, b)) for a, b in zip(starts, ends, strict=True)]

    def _back(self, end: int, overlap: int, start: int) -> int:
        where = bisect_right(self.valid, max(end - overlap, start + 1)) - 1
        begin = int(self.valid[where])
        return begin if begin > start else int(self.valid[where + 1])

    def _end(self, cuts: np.ndarray, start: int, done: int, limit: int, least: int) -> int:
        """The last cut that fits; of a finer level where the coarse one would leave a piece too small."""
        for number in (None, *range(_WORDS - 1, _CHARACTERS + 1)):
            options = cuts if number is None else self.level(number)
            hi, lo = bisect_right(options, start + limit), bisect_right(options, done)
            for k in range(hi - 1, lo - 1, -1):
                end = int(options[k])
                if self.count(start, end) <= limit:
                    if end - start >= min(least, limit // 2) or end == self.size or number == _CHARACTERS:
                        return end
                    break
        return int(self.valid[bisect_right(self.valid, done)])


def split_documents(
    documents: DataFrame, limits: list[tuple[int, int, int, int]], id_col: str = "doc_id", vocabulary: str = VOCABULARY
) -> DataFrame:
    """(limit_id, doc_id, piece_index, char_start, char_end, n_tokens, overlap_tokens) of every oversized text.

    ``limits`` has (limit_id, max_tokens, overlap_tokens, min_tokens). Rows are split where they lie, with no
    shuffle; offsets count code points and are all that comes out, ``with_piece_text`` adds the text. Null and
    blank texts give no piece; an id may be null or repeated. An overlap of over half of its limit is refused.
    """
    for _, limit, overlap, _ in limits:
        if not 0 <= overlap <= limit // 2:
            raise ValueError(f"overlap {overlap} of limit {limit}")
    rows = spread(documents).select(F.col(id_col).alias("id"), F.col("text").alias("text"))
    least = min((limit for _, limit, _, _ in limits), default=0)
    id_type = rows.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = tokenizer(vocabulary)
        for batch in batches:
            ids, table = [], []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                splitter = Splitter(text, coder)
                for limit_id, limit, overlap, smallest in limits:
                    if splitter.size <= limit:
                        continue
                    before = 0
                    for k, (a, b, n) in enumerate(splitter.pieces(limit, overlap, smallest)):
                        ids.append(key)
                        table.append((limit_id, k, splitter.chars[a], splitter.chars[b], n, before - a if k else 0))
                        before = b
            out = pd.DataFrame(table, columns=["limit_id", "piece_index", "char_start", "char_end", "n_tokens", "overlap_tokens"])
            out.insert(1, "id", pd.Series(ids, dtype=batch["id"].dtype))
            yield out

    schema = f"limit_id int, id {id_type}, piece_index int, char_start int, char_end int, n_tokens int, overlap_tokens int"
    return rows.where(F.octet_length("text") > least).mapInPandas(split, schema).withColumnRenamed("id", id_col)


def with_piece_text(pieces: DataFrame, documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with their text, by a join with the documents (ids unique)."""
    texts = documents.select(id_col, F.col("text").alias("whole"))
    cut = F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return pieces.join(texts, id_col).withColumn("piece", cut).drop("whole")


def piece_limits(size_limits: DataFrame) -> list[tuple[int, int, int, int]]:
    """(limit_id, max_tokens, overlap_tokens, min_tokens) of the fixed table's piece sizes."""
    rows = size_limits.where("purpose = 'piece' AND max_tokens > 0")
    rows = rows.select("limit_id", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)), F.coalesce("min_tokens", F.lit(0)))
    return [tuple(r) for r in rows.orderBy("limit_id").collect()]


def audit(pieces: DataFrame, documents: DataFrame, size_limits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per limit: pieces over it, documents whose pieces leave out a character, and pieces that don't go beyond the one
    before (ids unique)."""
    sizes = size_limits.where("purpose = 'piece'").select("limit_id", "max_tokens")
    order = Window.partitionBy("limit_id", id_col).orderBy("piece_index")
    rows = pieces.withColumn("_end", F.lag("char_end").over(order)).withColumn("_start", F.lag("char_start").over(order))
    gap = F.col("char_start") > F.coalesce("_end", F.lit(0))
    back = (F.col("char_end") <= F.col("_end")) | (F.col("char_start") <= F.col("_start"))
    per_text = rows.join(sizes, "limit_id").groupBy("limit_id", id_col).agg(
        F.sum((F.col("n_tokens") > F.col("max_tokens")).cast("int")).alias("over"), F.max(gap.cast("int")).alias("gaps"),
        F.sum(F.coalesce(back, F.lit(False)).cast("int")).alias("back"), F.max("char_end").alias("end"),
    )
    whole = documents.select(id_col, F.length("text").alias("_size"))
    per_text = per_text.join(whole, id_col)
    found = per_text.groupBy("limit_id").agg(F.sum("over").alias("o"), F.sum(((F.col("gaps") > 0) | (F.col("end") != F.col("_size"))).cast("int")).alias("u"), F.sum("back").alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sizes.where("max_tokens > 0").join(found, "limit_id", "left").select("limit_id", zero("o").alias("over_limit"), zero("u").alias("uncovered"), zero("b").alias("unordered"))
