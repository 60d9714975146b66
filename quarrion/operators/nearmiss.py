"""Confusable labels: similar pairs within and across categories, maps and ontologies, and their confusion report."""

from __future__ import annotations

import difflib
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.functions.text import label_tokens
from quarrion.operators.metrics import ndcg
from quarrion.operators.retrieval import row_ranks
from quarrion.session import parallelism

#: Weights of Jaccard index, overlap coefficient and sequence ratio in a pair's score (fixed values).
W_JACCARD, W_OVERLAP, W_RATIO = 0.4, 0.3, 0.3


@F.pandas_udf(T.DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratio of matching characters of two texts (not symmetric)."""
    for left, right in batches:
        yield pd.Series(
            [difflib.SequenceMatcher(None, a, b).ratio() if isinstance(a, str) and isinstance(b, str) else None for a, b in zip(left, right, strict=True)]
        )


sequence_ratio = sequence_ratio.asNondeterministic()  # else a filter on its result runs it once more


def set_scores(a: Column, b: Column) -> Column:
    """struct(jaccard, overlap) of two distinct token arrays; 0 if one is empty."""
    both, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    whole = F.size(a) + F.size(b) - both
    return F.struct(
        F.when(whole > 0, both / whole).otherwise(0.0).alias("jaccard"), F.when(least > 0, both / least).otherwise(0.0).alias("overlap")
    )


def label_sets(labels: DataFrame, id_col: str, text_col: str, category: Column) -> DataFrame:
    """(id, category, label, tokens) with blank categories as ``uncategorized``; texts lower-cased."""
    name = F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("uncategorized"))
    return labels.select(
        F.col(id_col).alias("id"), name.alias("category"), F.lower(text_col).alias("label"), F.array_distinct(label_tokens(text_col)).alias("tokens")
    ).where("id IS NOT NULL")


#: Sets of one token in a join key; a commoner token's sets are divided.
TOKEN_BLOCK = 2000


def token_rows(sets: DataFrame) -> DataFrame:
    """(id, category, label, n, c, ts, bits, p, token, df, blocks): a row for each token of each set, its place p counted from
    the rarest; all tokens in that order, a bit map of them, and the sets and the number of blocks of the token."""
    exploded = sets.where(F.size("tokens") > 0).select("id", F.explode("tokens").alias("token"))
    df = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ordered = exploded.join(df, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
    rows = ordered.join(sets.select("id", "category", "label"), "id").withColumn("n", F.size("own"))
    rows = rows.select("*", F.length("label").alias("c"), F.transform("own", lambda x: x["token"]).alias("ts"))
    rows = rows.withColumn("bits", F.expr("aggregate(ts, 0L, (m, t) -> m | shiftleft(1L, cast(pmod(xxhash64(t), 64) AS int)))"))
    rows = rows.select("*", F.posexplode("own").alias("p", "t"))
    blocks = F.ceil(F.col("t.df") / TOKEN_BLOCK).cast("int").alias("blocks")
    return rows.select("id", "category", "label", "n", "c", "ts", "bits", (F.col("p") + 1).alias("p"), "t.token", "t.df", blocks)


def meeting(small: DataFrame, large: DataFrame, carried: tuple[str, ...], within: bool | None = None) -> DataFrame:
    """Pairs of a set and a larger one (of equal ones, of a larger id) that have a token in common, columns named s_ and
    l_; ``large`` has ``most``, the size of a partner. Both are of ``token_rows``; a pair comes once a common token."""
    key = ["token", "block", *(["category"] if within else [])]
    kept = dict.fromkeys(("id", *([] if within else ["category"]), *carried, "n", "ts", "bits", "p"))
    side = lambda x: [F.col(k).alias(f"{x}_{k}") for k in kept]
    left = small.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select(*key, *side("s"))
    right = large.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, *side("l"), "most")
    parts = 8 * parallelism(small.sparkSession)  # named, since the work is in the pairs and not in the bytes
    # the right side of a merge join is held for each key: the one that is divided
    meet = right.repartition(parts, *key).join(left.repartition(parts, *key).hint("shuffle_merge"), key)
    meet = meet.where("s_n <= l_n AND s_n <= most AND (s_n < l_n OR s_id < l_id) AND s_id <> l_id")
    return meet.where("s_category <> l_category") if within is False else meet


def sharing(meet: DataFrame, need: Column) -> DataFrame:
    """Pairs of ``meeting`` that share at least ``need`` tokens (``shared``), each once."""
    sn, ln = F.col("s_n"), F.col("l_n")
    # what is before the rarest common token, and tokens whose bit the other set lacks, are not shared
    fits = (F.col("s_p") <= sn - need + 1) & (F.col("l_p") <= ln - need + 1) & (sn >= need)
    fits &= F.bit_count(F.col("s_bits").bitwiseAND(F.bitwise_not("l_bits"))) <= sn - need
    both = meet.where(fits).withColumn("shared", F.array_intersect("s_ts", "l_ts"))
    return both.where((F.get("shared", F.lit(0)) == F.col("token")) & (F.size("shared") >= need))


#: Pairs, and tokens of pairs, that are compared at once.
PAIR_SLICE, TOKEN_SLICE = 1 << 18, 1 << 22
#: Words of the bit map of a set.
MAP_WORDS = 4


def slices(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose counts sum up to ``most`` or less, or of one row."""
    upto, at = np.cumsum(counts), 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(upto, most + (upto[at - 1] if at else 0), "right")))
        yield at, end
        at = end


def expanded(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows and of what each has: ``counts`` numbers from ``first`` on."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def compared_rows(rows: pa.Table, jaccard: float, across: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y, shared, nx, ny) of whole groups of rows of one token each, see ``shared_term_pairs``.

    Positions, sizes and bit maps leave few pairs whose tokens have to be compared.
    """
    rows = rows.combine_chunks()
    ids, lists = rows["id"].chunk(0), rows["ts"].chunk(0)
    p, i, j, side = (rows[c].to_numpy().astype(np.int64) for c in ("p", "i", "j", "side"))
    category = rows["category"].chunk(0).dictionary_encode().indices.to_numpy() if across else None
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    starts = np.cumsum(n) - n
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64)
    known = np.repeat(np.arange(len(n)) * len(encoded.dictionary), n) + codes
    at_sets, known = known - codes, np.sort(known)
    bit = np.uint64(1) << (codes % 64).astype(np.uint64)
    maps = [np.bitwise_or.reduceat(np.where(codes // 64 % MAP_WORDS == w, bit, np.uint64(0)), starts) for w in range(MAP_WORDS)]
    # a set of n and one of m tokens need share * (n + m) common ones; what is before the key is not shared
    need = n * (jaccard / (1 + jaccard))
    spare = n - need + 1e-6
    left = spare - (p - 1)
    begins = group_begins(rows)
    ends = np.append(np.flatnonzero(begins)[1:], len(n))[np.cumsum(begins) - 1]
    runs = begins | np.append(True, side[1:] != side[:-1])
    run_ends = np.append(np.flatnonzero(runs)[1:], len(n))[np.cumsum(runs) - 1]
    first = np.where(i == j, np.arange(len(n)) + 1, run_ends)  # two blocks meet each other, one meets itself
    for lo, hi in slices(ends - first, PAIR_SLICE):
        x, y = expanded(first[lo:hi], (ends - first)[lo:hi])
        x += lo
        keep = (need[y] <= left[x]) & (need[x] <= left[y])
        if category is not None:
            keep &= category[x] != category[y]
        x, y = x[keep], y[keep]
        less_x, less_y = spare[x] - need[y], spare[y] - need[x]  # tokens that the other may lack
        for m in maps:
            mx, my = m[x], m[y]
            less_x, less_y = less_x - np.bitwise_count(mx & ~my), less_y - np.bitwise_count(my & ~mx)
            keep = (less_x >= 0) & (less_y >= 0)
            x, y, less_x, less_y = x[keep], y[keep], less_x[keep], less_y[keep]
        for lo2, hi2 in slices(n[x], TOKEN_SLICE):
            u, v = x[lo2:hi2], y[lo2:hi2]
            pair, place = expanded(starts[u], n[u])
            wanted = codes[place] + at_sets[starts[v]][pair]
            found = np.append(0, np.cumsum(known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted))
            own = np.cumsum(n[u]) - n[u]
            shared = found[own + n[u]] - found[own]
            # once a pair: where the key is the rarest common token
            keep = (found[own + p[u] - 1] == found[own]) & (shared / (n[u] + n[v] - shared) >= jaccard - 1e-12)
            u, v, shared = u[keep], v[keep], shared[keep]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(u)), ids.take(pa.array(v)), *map(pa.array, (shared, n[u], n[v]))], ["x", "y", "shared", "nx", "ny"])


def group_begins(rows: pa.Table) -> np.ndarray:
    """Whether each of the sorted rows has another key than the one before."""
    begins = np.zeros(rows.num_rows, dtype=bool)
    begins[:1] = True
    for key in ("token", "i", "j", *(["category"] if "within" in rows.column_names else [])):
        column = rows[key].combine_chunks()
        begins[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return begins


def shared_term_pairs(sets: DataFrame, jaccard: float, within: bool | None = None) -> DataFrame:
    """(a, b, jaccard, overlap), a < b, of at least the given Jaccard index; within a category, across, or both.

    Pairs meet on their rarest tokens only (the index leaves a least number of shared tokens by both sizes, and the rarest
    is among the first n - shared + 1 of each), so common tokens build no large groups. A commoner token's sets are divided
    into blocks of which any two meet. Groups are compared in arrays: no row is built of a pair that is not one.
    """
    n, p = F.col("n"), F.col("p")
    rows = token_rows(sets if within is None else sets.where("category IS NOT NULL"))
    rows = rows.where((F.col("df") > 1) & (p <= n - F.greatest(F.lit(1), F.ceil(n * F.lit(jaccard) - 1e-6)) + 1))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    kept = ["token", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "id", "p", "ts"]
    kept += [] if within is None else ["category", *([F.lit(1).alias("within")] if within else [])]
    key = ["token", "i", "j", *(["category"] if within else [])]
    parts = 4 * parallelism(sets.sparkSession)  # named, since the work is in the pairs and not in the bytes
    rows = rows.select(*kept).repartition(parts, *key).sortWithinPartitions(*key, "side")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            last = int(np.flatnonzero(group_begins(table))[-1]) if table.num_rows else 0
            if last:
                yield from compared_rows(table.slice(0, last), jaccard, within is False)
            held = table.slice(last).to_batches()
        if held:
            yield from compared_rows(pa.Table.from_batches(held), jaccard, within is False)

    name = sets.schema["id"].dataType.simpleString()
    pairs = rows.mapInArrow(compared, f"x {name}, y {name}, shared long, nx long, ny long").where("x <> y")
    both, nx, ny = F.col("shared"), F.col("nx"), F.col("ny")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (both / (nx + ny - both)).alias("jaccard"), (both / F.least(nx, ny)).alias("overlap"))


def least_shared(small: Column, large: Column, rest: Column) -> Column:
    """Least number of shared tokens at which two sets of these sizes have 0.4 jaccard + 0.3 overlap of ``rest``."""
    both = small + large
    b = W_JACCARD * small + W_OVERLAP * both + rest * small
    root = (b - F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * W_OVERLAP * rest * small * both))) / (2 * W_OVERLAP)
    return F.when(rest > 0, F.greatest(F.lit(1), F.ceil(root - 1e-6))).otherwise(F.lit(1))


#: Characters from which on ``difflib`` leaves out common ones of its second text.
LONG_TEXT = 200


def places_of(b: str) -> dict[str, bytes]:
    """Places of each character of ``b`` as bits, with a blank one at the end."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    return {c: m.to_bytes(len(b) // 8 + 1, "little") for c, m in places.items()}


@functools.lru_cache(4096)
def _first_column(rows: int, width: int) -> int:
    return sum(1 << width * i for i in range(rows))


def matching_length(a: str, b: str, places: dict[str, bytes]) -> int:
    """Characters in the matching blocks that ``difflib`` finds, for ``b`` of under ``LONG_TEXT`` characters.

    Equal characters are the bits of one number, a row for each of ``a``; runs along its diagonals are what is left after
    shifts by one row and one place, so the longest run takes a few operations. Ties go to the least bit.
    """
    width = 8 * (len(b) // 8 + 1)
    blank = bytes(width // 8)
    column = _first_column(len(a), width)
    todo = [int.from_bytes(b"".join([places.get(c, blank) for c in a]), "little")]
    total = 0
    while todo:
        if not (cells := todo.pop()):
            continue
        powers, size = [cells], 1
        while longer := powers[-1] & powers[-1] >> (width + 1) * size:
            powers.append(longer)
            size *= 2
        starts = powers.pop()
        for k in range(len(powers) - 1, -1, -1):
            if longer := starts & powers[k] >> (width + 1) * size:
                starts, size = longer, size + (1 << k)
        row, place = divmod((starts & -starts).bit_length() - 1, width)
        total += size
        if row and place and (before := cells & (1 << row * width) - 1):
            todo.append(before & (column & (1 << row * width) - 1) * ((1 << place) - 1))
        if after := cells >> (row + size) * width:
            todo.append(after & column * ((1 << width) - (1 << place + size)))
    return total


def bounded_ratio(least: float) -> Callable[..., Column]:
    """Sequence ratio of (a, b) where base + 0.3 ratio can reach ``least``, else null.

    Shared character counts bound the matching blocks.
    """

    @F.pandas_udf(T.DoubleType())
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right, base in batches:
            out = np.full(len(left), np.nan)
            want = (least - 1e-6 - base.to_numpy()) / W_RATIO
            codes, texts = pd.factorize(pd.concat([left, right]))
            lengths = np.array([len(text) for text in texts], dtype=np.int64)
            # characters of one class count as equal: still a bound
            classes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) % 64
            counts = np.bincount(np.repeat(np.arange(len(texts)), lengths) * 64 + classes, minlength=64 * len(texts)).reshape(-1, 64).astype(np.int32)
            l, r = codes[: len(left)], codes[len(left) :]
            total = np.maximum(lengths[l] + lengths[r], 1)
            at = np.flatnonzero(2 * np.minimum(counts[l], counts[r]).sum(axis=1) / total >= want)
            places: dict[int, dict[str, bytes]] = {}
            for i in at.tolist():
                a, b = texts[l[i]], texts[r[i]]
                if len(b) >= LONG_TEXT:
                    out[i] = difflib.SequenceMatcher(None, a, b).ratio()
                    continue
                if (m := places.get(r[i])) is None:
                    m = places[r[i]] = places_of(b)
                out[i] = 2.0 * matching_length(a, b, m) / (len(a) + len(b)) if a or b else 1.0
            yield pd.Series(out).where(~np.isnan(out), None).astype("float64")

    return ratio.asNondeterministic()


def scored_over(sets: DataFrame, least: float, within: bool | None = None, both: bool = False) -> DataFrame:
    """(a, b, score, jaccard, overlap, seq_ratio) of all pairs a < b that share a token and score ``least`` or more.

    The filter follows from ``least`` alone: the ratio is 2 min / (sum of lengths) at most, which leaves a least number
    of shared tokens by the sizes of both sets, and the rarest shared token is among the first n - shared + 1 of each.
    With ``both`` each pair comes in both directions where that one's score is enough (the ratio is not symmetric).
    ``least`` has to be over 0.3.
    """
    if least <= W_RATIO:
        raise ValueError("pairs are bounded only for a least score over 0.3")
    rest = F.lit(least - 1e-6 - W_RATIO)
    rows = token_rows(sets)
    small = rows.where(F.col("p") <= F.col("n") - least_shared(F.col("n"), F.col("n"), rest) + 1)
    sizes = F.sequence(F.lit(1), F.col("n"))
    most = F.array_max(F.filter(sizes, lambda k: F.col("p") <= F.col("n") - least_shared(k, F.col("n"), rest) + 1))
    large = rows.withColumn("most", most).where("most IS NOT NULL")
    sn, ln = F.col("s_n"), F.col("l_n")
    meet = meeting(small, large, ("label", "c"), within)
    ratio = 2 * F.least("s_c", "l_c") / F.greatest(F.lit(1), F.col("s_c") + F.col("l_c"))
    meet = sharing(meet, least_shared(sn, ln, F.lit(least - 1e-6) - W_RATIO * ratio))
    n = F.size("shared")
    meet = meet.select("*", (n / (sn + ln - n)).alias("jaccard"), (n / sn).alias("overlap"))
    ends = [F.struct(F.col(f"{x}_id").alias("a"), F.col(f"{y}_id").alias("b"), F.col(f"{x}_label").alias("la"), F.col(f"{y}_label").alias("lb")) for x, y in ("sl", "ls")]
    one = F.explode(F.array(*ends)) if both else F.when(F.col("s_id") < F.col("l_id"), ends[0]).otherwise(ends[1])
    pairs = meet.select(one.alias("e"), "jaccard", "overlap").select("e.*", "jaccard", "overlap")
    base = W_JACCARD * F.col("jaccard") + W_OVERLAP * F.col("overlap")
    scored = pairs.withColumn("seq_ratio", bounded_ratio(least)("la", "lb", base))
    scored = scored.withColumn("score", F.round(base + W_RATIO * F.col("seq_ratio"), 6))
    return scored.where(F.col("score") >= least).select("a", "b", "score", "jaccard", "overlap", "seq_ratio")


def score_pairs(pairs: DataFrame, labels: DataFrame, least: float = 0.0) -> DataFrame:
    """``pairs`` (a, b, jaccard, overlap) with seq_ratio and score; pairs whose score can't reach ``least`` skip the ratio."""
    hopeful = pairs.where(W_JACCARD * F.col("jaccard") + W_OVERLAP * F.col("overlap") + W_RATIO >= least)
    texts = labels.select("id", "label")
    joined = hopeful.join(texts.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b"
    )
    scored = joined.withColumn("seq_ratio", sequence_ratio("la", "lb"))
    score = W_JACCARD * F.col("jaccard") + W_OVERLAP * F.col("overlap") + W_RATIO * F.col("seq_ratio")
    return scored.withColumn("score", F.round(score, 6)).where(F.col("score") >= least).select("a", "b", "score", "jaccard", "overlap", "seq_ratio")


def top_pairs(pairs: DataFrame, n: int, left: str = "a", right: str = "b", score: str = "score") -> DataFrame:
    """The n best partners of each left id, then one row a canonical pair, its best score."""
    best = row_ranks(pairs, left, score, right, n)
    keyed = best.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), F.col(score).alias("score")).where("a <> b")
    return keyed.groupBy("a", "b").agg(F.max("score").alias("score"))


def category_index(labels: DataFrame) -> DataFrame:
    """(category, id) of every label: what siblings are read from, a row an id."""
    return labels.select("category", "id").distinct()


def siblings_of(labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, sibling): the other labels of the category of each id of ``wanted``, a stated query set; the whole map
    grows with the square of a category, so it is kept as ``category_index``."""
    index = category_index(labels)
    asked = index.join(wanted.select("id").distinct(), "id")
    return asked.join(index.withColumnRenamed("id", "sibling"), "category").where("id <> sibling").select("id", "sibling")


@dataclass(frozen=True)
class Ontology:
    """Labels, the index of their categories, their near misses, and pairs that name no label."""

    labels: DataFrame
    categories: DataFrame
    near_misses: DataFrame
    unknown: DataFrame


def ontology(labels: DataFrame, pairs: DataFrame) -> Ontology:
    """The bundle that the other operators take their maps from."""
    known, unknown = near_miss_map(pairs, labels)
    return Ontology(labels, category_index(labels), known, unknown)


def top_confused(pairs: DataFrame, n: int, hits: str = "hits") -> DataFrame:
    """The ``n`` pairs of most hits; ties go to the smaller ids. Whoever asks for tricks on them starts here."""
    return pairs.orderBy(F.desc(hits), "query_id", "neighbour").limit(n)


def near_miss_map(pairs: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both directions of each pair (id, neighbour) with known ends, and the unknown ids. Self pairs are dropped."""
    ends = [F.struct(F.col(x).alias("id"), F.col(y).alias("neighbour")) for x, y in ("ab", "ba")]  # both from one pass over the pairs
    both = pairs.select(F.explode(F.array(*ends)).alias("e")).select("e.*").where("id <> neighbour").distinct()
    known = catalog.select("id").distinct()
    unknown = both.select("id").distinct().join(known, "id", "left_anti")
    mapped = both.join(known, "id", "left_semi").join(known.withColumnRenamed("id", "neighbour"), "neighbour", "left_semi")
    return mapped.select("id", "neighbour"), unknown


def sibling_counts(catalog: DataFrame) -> DataFrame:
    """(id, category, siblings): how many other ids share the category. Siblings themselves are a join on it."""
    sizes = catalog.groupBy("category").agg(F.count(F.lit(1)).alias("size"))
    return catalog.join(sizes, "category").select("id", "category", (F.col("size") - 1).alias("siblings"))


def ontology_summary(catalog: DataFrame, mapped: DataFrame) -> DataFrame:
    """Per category: labels, labels with a near miss, and directed near-miss links."""
    links = mapped.groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    joined = catalog.join(links, "id", "left")
    return joined.groupBy("category").agg(
        F.count(F.lit(1)).alias("labels"), F.count("links").alias("labels_with_near_miss"), F.coalesce(F.sum("links"), F.lit(0)).alias("links")
    )


def confusions(top: DataFrame, positives: DataFrame, mapped: DataFrame) -> DataFrame:
    """(query_id, doc_id, neighbour): retrieved documents that are no positive of the query but one of a near miss.

    ``top`` has (query_id, doc_id) within the top k, ``positives`` (query_id, doc_id), ``mapped`` (id, neighbour).
    """
    wrong = top.join(positives, ["query_id", "doc_id"], "left_anti")
    theirs = positives.select(F.col("query_id").alias("neighbour"), "doc_id")
    near = wrong.join(mapped.withColumnRenamed("id", "query_id"), "query_id")
    return near.join(theirs, ["neighbour", "doc_id"], "left_semi").select("query_id", "doc_id", "neighbour")


def confusions_of_sets(top: DataFrame, positives: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """``confusions`` with the map of all ``sets`` (as of ``label_sets``) of at least that Jaccard index, which is not
    built: only queries whose positives were retrieved can be confused, so only those pairs are compared.
    """
    wrong = top.join(positives, ["query_id", "doc_id"], "left_anti")
    theirs = positives.select(F.col("query_id").alias("neighbour"), "doc_id")
    met = wrong.join(theirs, "doc_id").where("query_id <> neighbour")
    tokens = lambda key, name: sets.select(F.col("id").alias(key), F.col("tokens").alias(name))
    met = met.join(tokens("query_id", "_q"), "query_id").join(tokens("neighbour", "_n"), "neighbour")
    near = met.where(set_scores(F.col("_q"), F.col("_n"))["jaccard"] >= F.lit(jaccard) - 1e-12)
    return near.select("query_id", "doc_id", "neighbour")


def pair_confusion(confused: DataFrame, k: int) -> DataFrame:
    """(query_id, neighbour, hits, hit_rate) of each confused pair."""
    return confused.groupBy("query_id", "neighbour").agg(
        F.count(F.lit(1)).alias("hits"), F.round(F.count(F.lit(1)) / k, 6).alias("hit_rate")
    )


def confusion_report(ranked: DataFrame, positives: DataFrame, mapped: DataFrame, k: int) -> DataFrame:
    """One row: queries, mean nDCG, mean nDCG at k, confused documents and queries, and their rates.

    ``ranked`` has (query_id, doc_id, rank, rel) of all candidates.
    """
    top = ranked.where(F.col("rank") <= k)
    confused = confusions(top.select("query_id", "doc_id"), positives, mapped)
    at_k = ndcg(ranked, "query_id", "rank", "rel", k).withColumnRenamed("ndcg", "ndcg_at_k")
    return confusion_summary(ndcg(ranked, "query_id", "rank", "rel").join(at_k, "query_id"), top, confused)


def confusion_summary(gains: DataFrame, top: DataFrame, confused: DataFrame) -> DataFrame:
    """``confusion_report`` from (query_id, ndcg, ndcg_at_k) of each query, the top k rows, and their ``confusions``."""
    mean = lambda name: F.round(F.avg(name), 6).alias(f"mean_{name}")
    whole = gains.agg(F.count(F.lit(1)).alias("queries"), mean("ndcg"), mean("ndcg_at_k"))
    slots = top.agg(F.count(F.lit(1)).alias("slots"))
    docs = confused.select("query_id", "doc_id").distinct().agg(F.count(F.lit(1)).alias("confused_docs"), F.countDistinct("query_id").alias("confused_queries"))
    one = whole.join(slots, F.lit(True)).join(docs, F.lit(True))
    return one.select(
        "*",
        F.round(F.coalesce(F.try_divide("confused_docs", "slots"), F.lit(0.0)), 6).alias("ccr_docs"),
        F.round(F.coalesce(F.try_divide("confused_queries", "queries"), F.lit(0.0)), 6).alias("ccr_queries"),
    )


# Templates of trick queries: the label they aim at, and the text (fixed values).
TRICK_TEMPLATES = [
    ("A", "Clause that addresses {a} but explicitly not {b}."),
    ("B", "Clause that addresses {b} but explicitly not {a}."),
    ("A", "Provision focused on {a}, excluding any {b} language."),
    ("B", "Provision focused on {b}, excluding any {a} language."),
    ("A", "Only {a}; do not include {b}."),
    ("B", "Only {b}; do not include {a}."),
    ("A", "Clause about {a} (not {b})."),
    ("B", "Clause about {b} (not {a})."),
]


def trick_queries(pairs: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """``pairs`` with n trick queries each: (ordinal, target, trick), the templates in turn."""
    rows = []
    for i in range(n):
        target, text = TRICK_TEMPLATES[i % len(TRICK_TEMPLATES)]
        filled = F.replace(F.replace(F.lit(text), F.lit("{a}"), F.col(a)), F.lit("{b}"), F.col(b))
        rows.append(F.struct(F.lit(i).alias("ordinal"), F.lit(target).alias("target"), filled.alias("trick")))
    return pairs.withColumn("_t", F.explode(F.array(*rows))).select(*pairs.columns, "_t.*")
