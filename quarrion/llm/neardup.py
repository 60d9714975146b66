"""Near-duplicate records with small edits, by covering locality-sensitive hashing of token sets.

Two sets with a Jaccard index of at least J, the smaller of at most m tokens, differ in at most
r = floor(m (1/J - 1)) tokens, so the tables can be built for that radius and miss no pair:

* Sets are put into bands of sizes, each band 1/J times as wide as the one before; a pair lies in one band or in
  two neighbours, so every set enters the tables of its own band and, as the larger one, of the band below.
* The token universe of a band is parted at random into ceil((r+1)/(RADIUS+1)) parts. In one of them the pair
  differs in at most RADIUS tokens.
* In every part each token has a random code of RADIUS+1 bits; the table of mask v keeps the tokens whose code has
  an odd parity with v. Of the 2^(RADIUS+1)-1 masks at least one keeps none of RADIUS differing tokens, so
  both sets have the same key there.

Equal token sets are one representative before, with its members beside; buckets hold representatives only.

A key that keeps few or only frequent tokens says little: a bucket of it would hold sets by chance, and the more the
more sets there are. The information of a key is the sum of -log2(share of the sets with the token) over the tokens
it keeps; both sets of a pair that agree on it see the same sum. Below log2(number of sets), where a bucket would hold
more than one set by chance, the key is not used. Pairs that agree on such poor keys only, or in a bucket of more than
``BUCKET`` sets, are found by another table: sets of the wanted similarity share one of their first tokens in any
common order, rarest first; its rows carry size, place and a 128-bit sketch, which rule out nearly all of its chance
pairs within the join. Candidates of both are verified on the whole sets.

Null texts and sets of fewer than ``least`` tokens are in no pair. Nothing is capped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.operators.components import connected_components
from quarrion.session import checkpointed, parallelism

JACCARD, LEAST = 0.7, 12
#: Radius that the masks of one part cover; 2 ** (RADIUS + 1) - 1 tables a part.
RADIUS = 3
#: Sets in a bucket from which its pairs are left to the table of first tokens.
BUCKET = 64
#: Tokens whose frequency is known to the tasks, at most; rarer ones count as frequent as the rarest of these.
MOST_COMMON = 65_536
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


_TOKEN = re.compile("[a-z0-9]+")


def _sketches(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Both halves of the 128-bit map of each set: a token sets the bit of its last seven bits."""
    if not sets:
        return [np.zeros(0, dtype=np.int64)] * 2
    token, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    bit, upper = np.uint64(1) << (token & 63).astype(np.uint64), (token & 64).astype(bool)
    begin = np.cumsum(sizes) - sizes
    return [np.bitwise_or.reduceat(np.where(half, bit, np.uint64(0)), begin).view(np.int64) for half in (~upper, upper)]


def token_sets(texts: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, tokens, digest, s0, s1): hashes of the different runs ``[a-z0-9]+`` of each lower-cased text, ascending, a
    128-bit digest and a sketch of them, two 64-bit maps. Null ids, null texts and smaller sets are left out."""
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, tokens, digests = [], [], []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                words = set(_TOKEN.findall(text.lower()))
                if len(words) < least:
                    continue
                hashes = np.array(list(map(xxhash.xxh64_intdigest, words)), dtype=np.uint64)
                hashes.sort()
                ids.append(key), tokens.append(hashes.view(np.int64)), digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            s0, s1 = _sketches(tokens)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=batch["id"].dtype), "tokens": tokens, "digest": digests, "s0": s0, "s1": s1})

    return rows.mapInPandas(tokenize, f"id {rows.schema['id'].dataType.simpleString()}, tokens array<bigint>, digest binary, s0 bigint, s1 bigint")


def band(size: np.ndarray, jaccard: float, least: int) -> np.ndarray:
    """Band of a set size. Band g has the sizes from ``lower(g)`` on, see there."""
    edges = band_edges(int(size.max(initial=least)), jaccard, least)
    return np.searchsorted(edges, size, "right") - 1


def band_edges(largest: int, jaccard: float, least: int) -> np.ndarray:
    """Least sizes of the bands up to that of ``largest``. A pair's sizes lie in one band or two neighbours."""
    edges = [least]
    while edges[-1] <= largest:
        edges.append(math.floor(edges[-1] / jaccard + 1e-9) + 1)
    return np.array(edges)


def radius(smaller: int, jaccard: float) -> int:
    """Most tokens in which a pair of the wanted similarity differs if its smaller set has ``smaller``."""
    return math.floor(smaller * (1 / jaccard - 1) + 1e-9)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Scrambled 64-bit values (the finalizer of a well-known generator)."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covering_keys(
    row: np.ndarray, token: np.ndarray, bits: np.ndarray, sizes: np.ndarray, jaccard: float, least: int, width: int = RADIUS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, key, bits kept) of all tables, for sets given as (row, token, bits) and their sizes."""
    masks = np.arange(1, 1 << (width + 1))
    parity = np.array([[bin(v & c).count("1") & 1 for v in masks] for c in range(1 << (width + 1))], dtype=bool)
    bands = band(sizes, jaccard, least)
    edges = band_edges(int(sizes.max(initial=least)), jaccard, least)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    own = bands[row]
    for g in np.unique(np.concatenate((bands, bands - 1))):
        if g < 0:
            continue
        members = np.flatnonzero((bands == g) | (bands == g + 1))
        inside = (own == g) | (own == g + 1)
        r, t, b = row[inside], token[inside], bits[inside]
        top = int(edges[g + 1]) - 1 if g + 1 < len(edges) else math.floor(edges[g] / jaccard + 1e-9)
        parts = -(-(radius(top, jaccard) + 1) // (width + 1))
        mixed = _mix(t, 11 + int(g))
        part = (mixed % np.uint64(parts)).astype(np.int64)
        code = ((mixed >> np.uint64(40)) & np.uint64((1 << (width + 1)) - 1)).astype(np.int64)
        weight = _mix(t, 97)
        cell = np.searchsorted(members, r) * parts + part
        grid = np.zeros((len(members) * parts, len(masks)), dtype=np.uint64)
        worth = np.zeros((len(members) * parts, len(masks)), dtype=np.float32)
        if len(r):
            order = np.argsort(cell, kind="stable")
            cells, first = np.unique(cell[order], return_index=True)
            kept = parity[code[order]]
            values = np.where(kept, weight[order][:, None], np.uint64(0))
            with np.errstate(over="ignore"):
                grid[cells] = np.add.reduceat(values, first, axis=0)
            worth[cells] = np.add.reduceat(np.where(kept, b[order][:, None], np.float32(0)), first, axis=0)
        table = (np.arange(len(members) * parts) % parts)[:, None] * len(masks) + np.arange(len(masks))[None, :]
        with np.errstate(over="ignore"):
            keys = _mix(grid + table.astype(np.uint64) * _GOLDEN + np.uint64(g) * np.uint64(0xD6E8FEB86659FD93), 5)
        out.append((np.repeat(members, parts * len(masks)), keys.ravel(), worth.ravel()))
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty.astype(np.uint64), empty.astype(np.float32)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def representatives(texts: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Sets (rep, tokens, size, s0, s1), one of each token set, and members (id, rep). Both are checkpointed, as they are
    read several times and ``rep`` is a number given once."""
    sets = checkpointed(token_sets(texts, id_col, text_col, least))
    reps = sets.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("tokens", "s0", "s1")))
    reps = checkpointed(reps.select("digest", F.monotonically_increasing_id().alias("rep"), "tokens", "s0", "s1"))
    members = sets.select("id", "digest").join(reps.select("digest", "rep"), "digest").select("id", "rep")
    return reps.select("rep", "tokens", F.size("tokens").alias("size"), "s0", "s1"), checkpointed(members)


@dataclass(frozen=True)
class Frequencies:
    """Information of tokens in ``sets`` token sets: ``tokens`` ascending, with the ``bits`` and ``rank`` of each (the
    most frequent has the highest), and the bits of any other token."""

    sets: int
    tokens: np.ndarray
    bits: np.ndarray
    rank: np.ndarray
    rest: float

    def lookup(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits and rank of each token; rank -1 of those that aren't listed."""
        if not len(self.tokens):
            return np.full(len(token), self.rest, dtype=np.float32), np.full(len(token), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, token), len(self.tokens) - 1)
        known = self.tokens[at] == token
        return np.where(known, self.bits[at], np.float32(self.rest)), np.where(known, self.rank[at], -1)


def frequencies(reps: DataFrame, most: int = MOST_COMMON) -> Frequencies:
    """How often tokens occur, of the ``most`` most frequent ones; that bounds what comes to the driver."""
    total = reps.count()
    counted = reps.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rows = counted.where("df > 1").orderBy(F.desc("df"), "token").limit(most).toPandas()
    token, df = rows["token"].to_numpy(dtype=np.int64), rows["df"].to_numpy(dtype=np.float64)
    order = np.argsort(token)
    bits = (math.log2(max(total, 2)) - np.log2(df)).astype(np.float32)
    rest = float(bits[-1]) if len(rows) == most else math.log2(max(total, 2))
    return Frequencies(total, token[order], bits[order], (len(rows) - np.arange(len(rows)))[order], rest)


def _chunks(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the batches with (row, token) pairs of their sets, and the sets' sizes."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            chunk = batch.iloc[lo : lo + rows]
            sizes = chunk["size"].to_numpy(dtype=np.int64)
            yield chunk, np.repeat(np.arange(len(chunk)), sizes), np.concatenate([np.asarray(x, dtype=np.int64) for x in chunk["tokens"]]), sizes


def shared_buckets(reps: DataFrame, known: Frequencies, jaccard: float, least: int) -> DataFrame:
    """(key, rep, n): the buckets of all tables that hold more than one set, n sets each. Checkpointed."""
    needed = math.log2(max(known.sets, 2))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, row, token, sizes in _chunks(batches):
            member, key, worth = covering_keys(row, token.view(np.uint64), known.lookup(token)[0], sizes, jaccard, least)
            rich = worth >= needed - 1e-3
            yield pd.DataFrame({"key": key[rich].view(np.int64), "rep": chunk["rep"].to_numpy()[member[rich]]})

    keyed = reps.select("rep", "tokens", "size").mapInPandas(tables, "key bigint, rep bigint")
    sized = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    return checkpointed(sized.select("key", "rep", "n"))


def first_tokens(reps: DataFrame, known: Frequencies, jaccard: float) -> DataFrame:
    """(token, rep, size, place, s0, s1, short): the first tokens of each set, rarest first, with the set's sketch.

    Two sets of the wanted similarity share one of them, and for the smaller set it is a ``short`` one: beside a set
    that isn't smaller fewer tokens suffice. Two sketches differ in no more bits than the sets in tokens. Checkpointed.
    """
    most = lambda sizes, share: sizes - np.ceil(sizes * share - 1e-9).astype(np.int64) + 1

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, row, token, sizes in _chunks(batches):
            order = np.lexsort((token, known.lookup(token)[1], row))
            begin = np.cumsum(sizes) - sizes
            place = np.arange(len(token)) - begin[row] + 1
            taken = place <= most(sizes, jaccard)[row]
            at, place = row[taken], place[taken]
            short = place <= most(sizes, 2 * jaccard / (1 + jaccard))[at]
            s0, s1 = (chunk[s].to_numpy()[at] for s in ("s0", "s1"))
            yield pd.DataFrame({"token": token[order][taken], "rep": chunk["rep"].to_numpy()[at], "size": sizes[at], "place": place, "s0": s0, "s1": s1, "short": short})

    schema = "token bigint, rep bigint, size int, place int, s0 bigint, s1 bigint, short boolean"
    return checkpointed(reps.mapInPandas(firsts, schema))


def covering_pairs(reps: DataFrame, known: Frequencies, jaccard: float, least: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: pairs of sets that meet in a bucket of at most ``bucket`` sets."""
    shared = shared_buckets(reps, known, jaccard, least).where(F.col("n") <= bucket)
    left, right = shared.select("key", F.col("rep").alias("a")), shared.select("key", F.col("rep").alias("b"))
    return left.join(right, "key").where("a < b").select("a", "b")


def crowded_pairs(reps: DataFrame, known: Frequencies, jaccard: float) -> DataFrame:
    """(a, b), a < b: pairs that share a first token, but for those that sizes, places or sketches rule out."""
    rows = first_tokens(reps, known, jaccard)
    a, b = (rows.select("token", "short", *(F.col(c).alias(f"{c}_{side}") for c in ("rep", "size", "place", "s0", "s1"))) for side in "ab")
    both = F.col("size_a") + F.col("size_b")
    common = F.least("place_a", "place_b") + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    met = a.where("short").drop("short").join(b.drop("short"), "token").where("size_a < size_b OR size_a = size_b AND rep_a < rep_b")
    met = met.where(_sketches_allow(jaccard)).where(F.col("size_a") >= F.col("size_b") * F.lit(jaccard) - 1e-9)
    met = met.where(common >= both * F.lit(jaccard / (1 + jaccard)) - 1e-9)
    return met.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))


def _sketches_allow(jaccard: float) -> Column:
    """Whether two sets (s0_a, s1_a, size_a and so on) differ in few enough bits of their sketches."""
    differ = sum(F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in ("s0", "s1"))
    return differ <= (F.col("size_a") + F.col("size_b")) * F.lit((1 - jaccard) / (1 + jaccard)) + 1e-9


def candidate_pairs(reps: DataFrame, jaccard: float, least: int, bucket: int = BUCKET, most: int = MOST_COMMON) -> DataFrame:
    """(a, b), a < b: pairs of sets that may have the wanted similarity; every pair that has it is among them."""
    spread = reps.repartition(parallelism(reps.sparkSession), "rep")
    known = frequencies(spread, most)
    # sizes and sketches, a few bytes a set, go first: nearly all chance pairs end here and never meet their tokens
    covered = covering_pairs(spread, known, jaccard, least, bucket).distinct()
    a, b = (reps.select(F.col("rep").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("size", "s0", "s1"))) for side in "ab")
    sizes = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(jaccard) - 1e-9
    covered = covered.join(a, "a").join(b, "b").where(sizes & _sketches_allow(jaccard)).select("a", "b")
    return covered.unionByName(crowded_pairs(spread, known, jaccard)).distinct()


def similar_sets(reps: DataFrame, jaccard: float = JACCARD, least: int = LEAST, **options: float) -> DataFrame:
    """(a, b, jaccard), a < b: pairs of different token sets of at least the wanted similarity."""
    pairs = candidate_pairs(reps, jaccard, least, **options)
    a, b = (reps.select(F.col("rep").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("tokens", "size"))) for side in "ab")
    joined = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    joined = joined.select("a", "b", (shared / (F.col("size_a") + F.col("size_b") - shared)).alias("jaccard"))
    return joined.where(F.col("jaccard") >= F.lit(jaccard) - 1e-12)


def latest_texts(passages: DataFrame) -> DataFrame:
    """(passage_id, text) of the latest delivery of each passage."""
    return passages.groupBy("passage_id").agg(F.max_by("text", F.struct("ingested_at", F.xxhash64("text"))).alias("text"))


def found(passages: DataFrame) -> DataFrame:
    """p2_found: (passage_id_a, passage_id_b), a < b, of every pair; pairs of copies follow from their class."""
    reps, members = representatives(latest_texts(passages), "passage_id", "text")
    pairs = similar_sets(reps)
    left, right = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    copies = members.join(copies, "rep", "left_semi")
    within = copies.select("rep", F.col("id").alias("x")).join(copies.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("passage_id_a"), F.greatest("x", "y").alias("passage_id_b"))


def groups(passages: DataFrame) -> DataFrame:
    """(passage_id, group_id, copies, links): the class of every passage that is similar to another one.

    ``copies`` counts the passages of an equal token set, itself included; ``links`` the different token sets that
    it is similar to. ``group_id`` is the least passage_id of the component.
    """
    reps, members = representatives(latest_texts(passages), "passage_id", "text")
    pairs = checkpointed(similar_sets(reps))
    both = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))
    links = both.groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("links"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
    component = connected_components(pairs).withColumnRenamed("node", "rep")
    classes = copies.join(links, "rep", "left").join(component, "rep", "left").where("copies > 1 OR links IS NOT NULL")
    classes = classes.withColumn("component", F.coalesce("component", "rep"))
    names = classes.groupBy("component").agg(F.min("first_id").alias("group_id"))
    classes = classes.join(names, "component").select("rep", "group_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(classes, "rep").select(F.col("id").alias("passage_id"), "group_id", "copies", "links")
