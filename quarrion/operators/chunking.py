"""Chunks of texts: unit spans, greedy packing with overlap, and packing that follows discourse markers.

Each text is chunked inside one Arrow batch; nothing is shuffled. Null and empty texts give no chunk. Chunk rows have
``passage_id`` (the chunk's id), ``source_id``, ``chunk_index``, ``chunk_count``, ``char_start``, ``char_end``, ``text``
and the copied columns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.functions.ids import chunk_id
from quarrion.functions.markers import anaphora_hits, rule_sentences, temporal_hits, trimmed
from quarrion.functions.text import words

_TOKEN = re.compile(r"\S+")
_BREAKS = {"paragraph": re.compile(r"\n\s*\n+"), "line": re.compile(r"\n+")}
#: Other names of units and length measures.
_UNIT_NAMES = {"sentences": "sentence", "tokens": "token", "words": "token", "paragraphs": "paragraph", "lines": "line"}
_LENGTH_NAMES = {"token": "tokens", "word": "tokens", "words": "tokens", "char": "chars", "characters": "chars"}


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes of chunks. ``extension`` and the last three are for discourse-aware chunks only."""

    max_length: int = 200
    overlap: int = 30
    min_length: int = 50
    split_on: str = "sentence"
    length_unit: str = "tokens"
    extension: int = 1
    temporal: bool = False
    reformulation: bool = True
    parenthetical: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "split_on", _UNIT_NAMES.get(self.split_on.lower(), self.split_on.lower()))
        object.__setattr__(self, "length_unit", _LENGTH_NAMES.get(self.length_unit.lower(), self.length_unit.lower()))
        if self.max_length <= 0 or not 0 <= self.overlap < self.max_length:
            raise ValueError("max_length must be positive and overlap from 0 below it")
        if not 0 <= self.min_length <= self.max_length or self.extension < 0:
            raise ValueError("min_length must be from 0 to max_length, extension not negative")
        if self.split_on not in {"sentence", "token", *_BREAKS} or self.length_unit not in {"tokens", "chars"}:
            raise ValueError("unknown split_on or length_unit")

    def measure(self, text: str) -> int:
        """Length of a text in the configured unit."""
        return len(text) if self.length_unit == "chars" else len(_TOKEN.findall(text))


def unit_spans(text: str, split_on: str) -> list[tuple[int, int]]:
    """Spans of the units of a text, trimmed, none empty."""
    if split_on == "sentence":
        return rule_sentences(text)
    if split_on == "token":
        return [m.span() for m in _TOKEN.finditer(text)]
    edges = [0, *(x for m in _BREAKS[split_on].finditer(text) for x in m.span()), len(text)]
    spans = (trimmed(text, a, b) for a, b in zip(edges[::2], edges[1::2], strict=True))
    return [s for s in spans if s[0] < s[1]]


def window_spans(text: str, start: int, end: int, config: ChunkConfig) -> list[tuple[int, int]]:
    """Sliding windows over a unit that exceeds the limit."""
    out = []
    if config.length_unit == "chars":
        at = start
        while at < end:
            a, b = trimmed(text, at, min(at + config.max_length, end))
            if a < b:
                out.append((a, b))
            if at + config.max_length >= end:
                break
            at = max(at + 1, b - config.overlap)
        return out
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    for at in range(0, len(tokens), config.max_length - config.overlap):
        window = tokens[at : at + config.max_length]
        out.append((window[0][0], window[-1][1]))
        if at + config.max_length >= len(tokens):
            break
    return out


def pack_units(lengths: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Runs [first, end) of units; a unit that exceeds the limit is a run of its own.

    After a full run the next one begins with its last units, as many as reach ``overlap``; where the next unit does
    not fit beside them they come out as a run of their own.
    """
    total = [0, *accumulate(lengths)]
    runs: list[tuple[int, int]] = []
    lo = hi = 0
    for k, length in enumerate(lengths):
        if length > limit:
            if hi > lo:
                runs.append((lo, hi))
            runs.append((k, k + 1))
            lo = hi = k + 1
        elif hi == lo or total[k + 1] - total[lo] <= limit:
            lo, hi = (k, k + 1) if hi == lo else (lo, k + 1)
        else:
            runs.append((lo, hi))
            lo = max(lo, bisect_right(total, total[hi] - overlap, lo, hi) - 1) if overlap else hi
            if lo < hi and total[k + 1] - total[lo] > limit:
                runs.append((lo, hi))
                lo = k
            hi = k + 1
    if hi > lo:
        runs.append((lo, hi))
    return runs


def chunk_spans(text: str | None, config: ChunkConfig, discourse: bool = False) -> list[tuple[int, int]]:
    """Spans of the chunks of one text."""
    return [(row[0], row[1]) for row in chunk_rows(text, config, discourse)]


def chunk_rows(text: str | None, config: ChunkConfig, discourse: bool = False) -> list[tuple[int, int, int, int, bool, bool]]:
    """Chunks of one text: span, first and last unit before any extension, and whether each end is that of its unit."""
    units = unit_spans(text, "sentence" if discourse else config.split_on) if text else []
    lengths = [config.measure(text[a:b]) for a, b in units]
    spans: list[list] = []  # start, end, first sentence, last sentence, whether each end is that of its sentence
    for lo, hi in pack_units(lengths, config.max_length, config.overlap):
        start, end = units[lo][0], units[hi - 1][1]
        if hi - lo == 1 and lengths[lo] > config.max_length:
            spans += [[a, b, lo, lo, a == start, b == end] for a, b in window_spans(text, start, end, config)]
        else:
            spans.append([start, end, lo, hi - 1, True, True])
    if config.min_length and len(spans) > 1 and config.measure(text[spans[-1][0] : spans[-1][1]]) < config.min_length:
        tail = spans.pop()
        head = spans[-1]
        head[1], head[3], head[5] = tail[1], tail[3], tail[5]
    if discourse and config.extension:
        marks = [(h.start, h.end) for h in anaphora_hits(text, units, config.reformulation, config.parenthetical)]
        if config.temporal:
            marks += [(h.start, h.end) for h in temporal_hits(text)]
        marked = [any(a < hi and lo < b for a, b in marks) for lo, hi in units]
        last = len(units) - 1
        for span in spans:
            if span[4] and span[2] > 0 and marked[span[2]]:
                span[0] = units[max(0, span[2] - config.extension)][0]
            if span[5] and span[3] < last and marked[span[3]]:
                span[1] = units[min(last, span[3] + config.extension)][1]
    return [(*trimmed(text, s[0], s[1]), *s[2:]) for s in spans]


def chunk_alignment(df: DataFrame, config: ChunkConfig | None = None, id_col: str = "passage_id", text_col: str = "text", discourse: bool = True) -> DataFrame:
    """(source_id, chunk_index, char_start, char_end, first_unit, last_unit, starts_unit, ends_unit) of every chunk.

    The range of sentences is that before markers extended the chunk; a part of an oversized sentence begins or ends
    inside it. Rows without an id or a text give none.
    """
    setting = config or ChunkConfig()
    fields = "chunk_index:int,char_start:int,char_end:int,first_unit:int,last_unit:int,starts_unit:boolean,ends_unit:boolean"
    names = [f.split(":")[0] for f in fields.split(",")]

    @F.pandas_udf(f"array<struct<{fields}>>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(names, (k, *row), strict=True)) for k, row in enumerate(chunk_rows(x, setting, discourse))] if isinstance(x, str) else [] for x in texts])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("source_id"), F.explode(chunks.asNondeterministic()(F.col(text_col))).alias("c"))
    return rows.select("source_id", "c.*")


def chunk_table(
    df: DataFrame,
    config: ChunkConfig | None = None,
    id_col: str = "passage_id",
    text_col: str = "text",
    keep: tuple[str, ...] = ("title",),
    discourse: bool = False,
    spans: Callable[[str | None], list[tuple[int, int]]] | None = None,
) -> DataFrame:
    """Chunk rows of every text of ``df``. ``spans`` replaces the built-in chunker. Rows without an id are left out."""
    setting = config or ChunkConfig()
    cut = spans or (lambda text: chunk_spans(text, setting, discourse))

    @F.pandas_udf("array<struct<chunk_index:int,char_start:int,char_end:int,text:string>>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [
                    [{"chunk_index": k, "char_start": a, "char_end": b, "text": x[a:b]} for k, (a, b) in enumerate(cut(x))]
                    if isinstance(x, str)
                    else []
                    for x in texts
                ]
            )

    chunks = chunks.asNondeterministic()  # else the filter that explode implies runs it once more
    keep = tuple(c for c in keep if c in df.columns)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("source_id"), chunks(F.col(text_col)).alias("_chunks"), *keep)
    rows = rows.withColumn("chunk_count", F.size("_chunks")).withColumn("_chunk", F.explode("_chunks"))
    index = F.col("_chunk.chunk_index")
    return rows.select(
        chunk_id(F.col("source_id"), index).alias("passage_id"),
        "source_id",
        index.alias("chunk_index"),
        "chunk_count",
        F.col("_chunk.char_start").alias("char_start"),
        F.col("_chunk.char_end").alias("char_end"),
        F.col("_chunk.text").alias("text"),
        *keep,
    )


def token_windows(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(id, window, tokens): fixed windows of words, without Python."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    rows = df.select(F.col(id_col).alias("id"), words(text_col).alias("tokens")).where(F.size("tokens") > 0)
    last = F.greatest(F.ceil((F.size("tokens") - size) / step), F.lit(0)).cast("int")
    rows = rows.withColumn("window", F.explode(F.sequence(F.lit(0), last)))
    return rows.select(F.col("id").alias(id_col), "window", F.slice("tokens", F.col("window") * step + 1, F.lit(size)).alias("tokens"))


def unit_table(df: DataFrame, id_col: str, text_col: str, unit: str) -> DataFrame:
    """(id, unit_index, unit): paragraphs or lines of every text, trimmed, without Python."""
    ws = r"[\t\n\x0B\f\r \x85\p{Z}]"
    pattern = {"paragraph": rf"\n{ws}*\n+", "line": r"\n+"}[unit]
    parts = F.filter(F.transform(F.split(text_col, pattern), lambda x: F.regexp_replace(x, f"^{ws}+|{ws}+$", "")), lambda x: x != "")
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(parts).alias("unit_index", "unit"))
    return rows
