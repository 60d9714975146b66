"""Ranking of documents for queries: token overlap, BM25 over keyword sets, dense inner product, hybrid, and ranks.

Scores join on terms, so no query is paired with a document that shares none; only where the semantics need every
document (the sparse pool with zeros) are they ranked after the scored ones, by id. Ties go to the smaller id.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.session import parallelism

K1, B = 1.5, 0.75


def row_ranks(df: DataFrame, group: str, score: str | tuple[str, ...], tie: str, k: int | None = None, name: str = "rank") -> DataFrame:
    """``df`` with the rank of each row within its group, best score first (by several, the first decides); only the
    first ``k`` if given."""
    scores = (score,) if isinstance(score, str) else score
    window = Window.partitionBy(group).orderBy(*(F.desc(s) for s in scores), F.asc(tie))
    ranked = df.withColumn(name, F.row_number().over(window))
    return ranked if k is None else ranked.where(F.col(name) <= k)


def ranks_of(wanted: DataFrame, scored: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """``wanted`` (few rows of each group, with their score) with ``rank``: one more than the rows of ``scored`` that
    come before, those of a better score or of the same one and a smaller item.

    Rows are counted, not sorted, so a group of any size is spread over tasks and summed up in parts.
    """
    names = wanted.columns
    rows = scored.select(group, F.col(item).alias("_item"), F.col(score).alias("_score"))
    before = (F.col("_score") > F.col(score)) | (F.col("_score") == F.col(score)) & (F.col("_item") < F.col(item))
    counted = rows.join(wanted, group).groupBy(*names).agg(F.sum(before.cast("int")).alias("_before"))
    return counted.select(*names, (F.col("_before") + 1).cast("int").alias("rank"))


def token_overlap(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): distinct tokens shared by both. ``tokens`` of either side are distinct."""
    q = queries.select("query_id", F.explode("tokens").alias("token"))
    d = documents.select("doc_id", F.explode("tokens").alias("token"))
    d = d.join(q.select("token").distinct(), "token", "left_semi")
    return q.join(d, "token").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("score"))


#: Queries and documents in a tile of ``overlap_tiles``, at most.
OVERLAP_QUERIES, OVERLAP_DOCUMENTS = 8192, 32768


def overlap_tiles(queries: DataFrame, documents: DataFrame, k: int, hits: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, before): the ``k`` best of each query in each block of documents by ``token_overlap``,
    with null ``before``; and ``hits`` (query_id, doc_id, score) with how many documents of the block come before.

    The best of all blocks' best are a query's best, and one more than the sum of ``before`` is a hit's rank, while no
    pair of query and document leaves its tile: queries and documents are dealt out to blocks of a fixed size.
    """
    asked = queries.select(F.col("query_id").alias("id"), "tokens")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    if hits is None:
        asked = asked.withColumn("hits", F.array().cast(f"array<struct<doc_id:{id_type},score:int>>"))
    else:
        listed = hits.groupBy(F.col("query_id").alias("id")).agg(F.collect_list(F.struct("doc_id", F.col("score").cast("int").alias("score"))).alias("hits"))
        asked = asked.join(listed, "id", "left")
    docs = documents.select(F.col("doc_id").alias("id"), "tokens")
    cores = parallelism(documents.sparkSession)
    n_asked, n_docs = (-(-side.select("id").count() // size) or 1 for side, size in ((asked, OVERLAP_QUERIES), (docs, OVERLAP_DOCUMENTS)))
    n_docs = max(n_docs, -(-cores // n_asked))

    def dealt(side: DataFrame, name: str, blocks: int, other: str, others: int) -> DataFrame:
        placed = side.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left, right = dealt(asked, "qb", n_asked, "db", n_docs), dealt(docs, "db", n_docs, "qb", n_asked)
    parts = n_asked * n_docs
    met = left.repartition(parts, "qb", "db").groupBy("qb", "db").cogroup(right.repartition(parts, "qb", "db").groupBy("qb", "db"))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {id_type}, score int, before bigint"
    return met.applyInArrow(_overlaps_of_tile(k), schema)


def _overlaps_of_tile(k: int):
    def tile(asked: pa.Table, docs: pa.Table) -> pa.Table:
        names, numbers = docs["id"].combine_chunks(), []
        ids = names.take(order := pc.sort_indices(names))
        lists = docs["tokens"].combine_chunks().take(order)
        q_lists = asked["tokens"].combine_chunks()
        words = pc.list_flatten(q_lists)
        known = words.unique()
        n, places = len(ids), ids.to_pylist()
        codes = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=known), -1).to_numpy(zero_copy_only=False)
        at = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[codes >= 0]
        codes = codes[codes >= 0]
        at = at[np.argsort(codes, kind="stable")]
        ends = np.cumsum(np.bincount(codes, minlength=len(known)))
        asks = pc.index_in(words, value_set=known).to_numpy(zero_copy_only=False)
        of = np.searchsorted(pc.list_parent_indices(q_lists).to_numpy(zero_copy_only=False), np.arange(len(asked) + 1))
        hits = asked["hits"].to_pylist()
        kind = np.uint8 if np.diff(of).max(initial=0) < 256 else np.int32
        common: dict[int, np.ndarray] = {}
        for q in range(len(asked)):
            scores = np.zeros(n, dtype=kind)
            for c in asks[of[q] : of[q + 1]].tolist():
                rows = at[ends[c - 1] if c else 0 : ends[c]]
                if 16 * len(rows) < n:
                    scores[rows] += 1  # a document has a token once
                    continue
                if (whole := common.get(c)) is None:
                    whole = common[c] = np.zeros(n, dtype=kind)
                    whole[rows] = 1
                scores += whole
            left, level = k, int(scores.max(initial=0))
            while left > 0 and level > 0:
                best = np.flatnonzero(scores == level)[:left]
                numbers += [(q, int(i), None, level, None) for i in best]
                left, level = left - len(best), level - 1
            for hit in hits[q] or ():
                s, upto = hit["score"], bisect.bisect_left(places, hit["doc_id"])
                numbers.append((q, -1, hit["doc_id"], s, int(np.count_nonzero(scores > s) + np.count_nonzero(scores[:upto] == s))))
        q_at, d_at, own, score, before = zip(*numbers, strict=True) if numbers else ((), (), (), (), ())
        found = ids.take(pa.array([i if i >= 0 else None for i in d_at], pa.int64()))
        return pa.table({
            "query_id": asked["id"].combine_chunks().take(pa.array(q_at, pa.int64())), "doc_id": pc.coalesce(found, pa.array(own, ids.type)),
            "score": pa.array(score, pa.int32()), "before": pa.array(before, pa.int64()),
        })

    return tile


def best_of_tiles(tiles: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of each query, of ``overlap_tiles`` with that k or more."""
    return row_ranks(tiles.where("before IS NULL").drop("before"), "query_id", "score", "doc_id", k)


def hits_of_tiles(tiles: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, rank) of the hits of ``overlap_tiles``."""
    sums = tiles.where("before IS NOT NULL").groupBy("query_id", "doc_id", "score").agg(F.sum("before").alias("n"))
    return sums.select("query_id", "doc_id", "score", (F.col("n") + 1).cast("int").alias("rank"))


def l2_normalise(vector: Column) -> Column:
    """A vector of unit length, as doubles; null for one that is null, zero or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    # held in a struct, so that the norm is not computed again for each element
    held = F.array(F.struct(wide.alias("v"), norm.alias("n")))
    scaled = F.transform(held, lambda s: F.when((s["n"] > 0) & (s["n"] < float("inf")), F.transform(s["v"], lambda x: x / s["n"])))
    return F.get(scaled, F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


#: Queries and documents in a tile of a dense search, at most.
QUERY_BLOCK, DOCUMENT_BLOCK = 1024, 8192


def dense_topk(queries: DataFrame, documents: DataFrame, k: int, decimals: int = 4) -> DataFrame:
    """(query_id, doc_id, score, rank) by inner product of unit vectors, rounded before it is ranked.

    ``queries`` has ``q_unit``, ``documents`` ``unit``; null vectors are left out. A stated query set is met with all
    documents in tiles: queries and documents are dealt out to blocks of a fixed size, every tile multiplies one block
    of each, and only the k best of a tile leave it. No vectors come to the driver.
    """
    asked = queries.where(F.col("q_unit").isNotNull()).select(F.col("query_id").alias("id"), F.col("q_unit").alias("unit"))
    docs = documents.where(F.col("unit").isNotNull()).select(F.col("doc_id").alias("id"), "unit")
    cores = parallelism(documents.sparkSession)
    n_asked, n_docs = (-(-side.count() // size) or 1 for side, size in ((asked, QUERY_BLOCK), (docs, DOCUMENT_BLOCK)))
    n_docs = max(n_docs, -(-cores // n_asked))

    def dealt(side: DataFrame, name: str, blocks: int, other: str, others: int) -> DataFrame:
        placed = side.select("id", "unit", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(name))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left, right = dealt(asked, "qb", n_asked, "db", n_docs), dealt(docs, "db", n_docs, "qb", n_asked)
    types = {n: f.schema["id"].dataType.simpleString() for n, f in (("query_id", asked), ("doc_id", docs))}
    schema = f"query_id {types['query_id']}, doc_id {types['doc_id']}, score double"
    parts = n_asked * n_docs
    met = left.repartition(parts, "qb", "db").groupBy("qb", "db").cogroup(right.repartition(parts, "qb", "db").groupBy("qb", "db"))
    return row_ranks(met.applyInPandas(_best_of_tile(k, decimals), schema), "query_id", "score", "doc_id", k)


def _best_of_tile(k: int, decimals: int):
    def best(asked: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(docs):
            return pd.DataFrame({"query_id": asked["id"][:0], "doc_id": docs["id"][:0], "score": np.zeros(0)})
        docs = docs.sort_values("id", kind="stable")
        ids, queries = docs["id"].to_numpy(), asked["id"].to_numpy()
        scores = np.round(np.stack(asked["unit"].to_list()) @ np.stack(docs["unit"].to_list()).T, decimals)
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(queries, top.shape[1]), "doc_id": ids[top.ravel()], "score": np.take_along_axis(scores, top, 1).ravel()})

    return best


def bm25_statistics(keywords: DataFrame, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and one row (n_docs, avgdl) over keyword sets (doc_id, keywords); ``where`` filters before."""
    docs = keywords if where is None else keywords.where(where)
    corpus = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg(F.size("keywords")), F.lit(0.0)).alias("avgdl"))
    terms = docs.select(F.explode("keywords").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.join(F.broadcast(corpus), F.lit(True)).select("term", "df", idf.alias("idf")), corpus


def bm25_scores(queries: DataFrame, keywords: DataFrame, where: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score) of documents that share a term; each set counts a term once."""
    docs = keywords if where is None else keywords.where(where)
    terms, corpus = bm25_statistics(keywords, where)
    q = queries.select("query_id", F.explode("keywords").alias("term")).distinct()
    wanted = q.join(terms.select("term", "idf"), "term")
    postings = docs.select("doc_id", F.size("keywords").alias("dl"), F.explode("keywords").alias("term"))
    joined = postings.join(wanted, "term").join(F.broadcast(corpus), F.lit(True)).where("avgdl > 0")
    weight = F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"))


def sparse_topk(queries: DataFrame, keywords: DataFrame, k: int, decimals: int = 4, where: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): every document counts, those without a shared term with 0, ties by id.

    Documents of score 0 can only be the k of least id that have no score, so the others never meet the query.
    """
    docs = keywords if where is None else keywords.where(where)
    scored = bm25_scores(queries, keywords, where).withColumn("score", F.bround("score", decimals))
    best = row_ranks(scored, "query_id", "score", "doc_id", k).drop("rank")
    # k + (number of best) least ids hold at least k without a score among the best
    fill = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    pairs = queries.select("query_id").join(F.broadcast(fill), F.lit(True))
    zeros = pairs.join(scored.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return row_ranks(best.unionByName(zeros), "query_id", "score", "doc_id", k)


def min_max(score: str, group: str) -> Column:
    """A score as a share of its group's range; 0 where all are equal. For groups of a bounded size."""
    window = Window.partitionBy(group)
    low, high = F.min(score).over(window), F.max(score).over(window)
    return F.when(high == low, 0.0).otherwise((F.col(score) - low) / (high - low))


def shares_of_range(df: DataFrame, score: str, group: str, name: str) -> DataFrame:
    """``df`` with ``name``, what ``min_max`` gives, for groups of any size: ranges are aggregated in parts and joined."""
    spans = df.groupBy(group).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    share = F.when(F.col("_high") == F.col("_low"), 0.0).otherwise((F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return df.join(spans, group).withColumn(name, share).drop("_low", "_high")


def hybrid_topk(queries: DataFrame, documents: DataFrame, k: int, alpha: float = 0.5, decimals: int = 4, pool: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank) of ``alpha`` x dense + (1 - alpha) x sparse, each as a share of its range.

    Candidates are the ``pool * k`` best dense and the k best sparse documents. The dense range is that of the dense
    pool, the sparse one that of all candidates; a candidate outside the dense pool has dense score 0. A query
    without keywords is ranked by the dense score alone. The blend is rounded before it is ranked.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")
    dense = dense_topk(queries.where(F.col("q_unit").isNotNull()), documents, pool * k, decimals=12)
    dense = dense.select("query_id", "doc_id", min_max("score", "query_id").alias("dense"))
    sets = documents.select("doc_id", "keywords")
    asked = queries.where(F.size("keywords") > 0)
    sparse = sparse_topk(asked, sets, k).select("query_id", "doc_id")
    pairs = dense.join(sparse, ["query_id", "doc_id"], "full_outer")
    scored = bm25_scores(asked, sets)
    pairs = pairs.join(scored, ["query_id", "doc_id"], "left").withColumn("bm25", F.coalesce("score", F.lit(0.0))).drop("score")
    pairs = pairs.withColumn("sparse", min_max("bm25", "query_id")).fillna(0.0, ["dense"])
    pairs = pairs.join(queries.select("query_id", (F.size("keywords") > 0).alias("worded")), "query_id")
    blend = F.when(F.col("worded"), alpha * F.col("dense") + (1 - alpha) * F.col("sparse")).otherwise(F.col("dense"))
    blended = pairs.select("query_id", "doc_id", F.bround(blend, decimals).alias("score"))
    return row_ranks(blended, "query_id", "score", "doc_id", k)


def retrieve(queries: DataFrame, documents: DataFrame, k: int, retriever: str, alpha: float = 0.5) -> DataFrame:
    """Top k by the named retriever: dense, sparse or hybrid."""
    if retriever == "dense":
        return dense_topk(queries, documents, k)
    if retriever == "sparse":
        return sparse_topk(queries, documents.select("doc_id", "keywords"), k)
    if retriever == "hybrid":
        return hybrid_topk(queries, documents, k, alpha)
    raise ValueError(f"unknown retriever {retriever!r}")


def node_similarity(queries: DataFrame, documents: DataFrame, pairs: DataFrame, alpha: float = 0.5, decimals: int = 4) -> DataFrame:
    """(query_id, doc_id, similarity) of the given pairs: ``alpha`` x inner product + (1 - alpha) x BM25, not normalised.

    This is how a walk rates the nodes that it visits; a null vector has product 0.
    """
    wanted = pairs.select("query_id", "doc_id").distinct()
    joined = wanted.join(queries.select("query_id", "q_unit"), "query_id").join(documents.select("doc_id", "unit"), "doc_id")
    scored = bm25_scores(queries.where(F.size("keywords") > 0), documents.select("doc_id", "keywords"))
    joined = joined.join(scored, ["query_id", "doc_id"], "left")
    cosine = F.coalesce(dot(F.col("q_unit"), F.col("unit")), F.lit(0.0))
    return joined.select("query_id", "doc_id", F.bround(alpha * cosine + (1 - alpha) * F.coalesce("score", F.lit(0.0)), decimals).alias("similarity"))


def select_seeds(queries: DataFrame, documents: DataFrame, k: int = 20, alpha: float = 0.5) -> DataFrame:
    """Seeds of a traversal: the hybrid top k."""
    return hybrid_topk(queries, documents, k, alpha)
