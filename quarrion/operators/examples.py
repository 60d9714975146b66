"""Training tables for retrievers and sentence scorers: relevance bands, negatives with precedence, splits, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.functions.text import parse_labelled, relevance_band, strip
from quarrion.operators.ordinals import with_group_ranks, with_row_numbers
from quarrion.session import checkpointed, parallelism

#: Label types, the first of which wins a document.
PRECEDENCE = ["pos", "easy", "hard", "near_miss", "sibling"]


def mixed_order(number: Column, seed: int) -> Column:
    """A pseudo-random order of integers that any SQL engine can compute; of any size, since the remainder is multiplied."""
    return F.pmod(F.pmod(number, F.lit(1000003)) * F.lit(2654435761) + F.lit(seed), F.lit(1000003))


def best_judgements(qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the best score of each pair; null ids and scores are left out."""
    known = qrels.where("query_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL")
    return known.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def training_packages(judged: DataFrame, cap: int | None = None) -> DataFrame:
    """(query_id, pos, hard_neg, neg): arrays of (doc_id, score), best first; queries without a positive are left out.

    With ``cap`` the arrays are bounded before they are collected; without it a query's lists must fit into one row,
    else ``package_blocks`` gives them in parts.
    """
    rows = judged.select("query_id", "doc_id", "score", relevance_band("score").alias("band")).where("band IS NOT NULL")
    if cap is not None:
        order = Window.partitionBy("query_id", "band").orderBy(F.desc("score"), "doc_id")
        rows = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap)

    def listed(band: str) -> Column:
        found = F.collect_list(F.when(F.col("band") == band, F.struct((-F.col("score")).alias("s"), "doc_id")))
        return F.transform(F.array_sort(found), lambda x: F.struct(x["doc_id"].alias("doc_id"), (-x["s"]).alias("score")))

    out = rows.groupBy("query_id").agg(listed("pos").alias("pos"), listed("hard").alias("hard_neg"), listed("neg").alias("neg"))
    return out.where(F.size("pos") > 0)


def package_rows(judged: DataFrame) -> DataFrame:
    """(query_id, band, rank, doc_id, score): all of ``training_packages`` as rows, however long a list is.

    No list is collected, so a query with any number of judged documents fits; ranks are from 1 in each band.
    """
    rows = judged.select("query_id", "doc_id", "score", relevance_band("score").alias("band")).where("band IS NOT NULL")
    kept = rows.join(rows.where("band = 'pos'").select("query_id").distinct(), "query_id", "left_semi")
    ranked = with_group_ranks(kept, ["query_id", "band"], [F.desc("score"), F.asc("doc_id")], "rank")
    return ranked.select("query_id", "band", "rank", "doc_id", "score")


#: Documents in one list of ``package_blocks``.
PACKAGE_BLOCK = 1000


def package_blocks(judged: DataFrame, size: int = PACKAGE_BLOCK) -> DataFrame:
    """(query_id, band, block, docs): all of ``training_packages`` in lists of ``size``, the best first; block 0 has the
    best ones. A query has as many blocks of a band as it needs."""
    rows = package_rows(judged).withColumn("block", F.floor((F.col("rank") - 1) / size).cast("int"))
    lists = rows.groupBy("query_id", "band", "block").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("x"))
    return lists.select("query_id", "band", "block", F.transform("x", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score"))).alias("docs"))


#: Sibling negatives in one array of ``example_blocks``, on average.
SIBLING_BLOCK = 512


def positives_of(judged: DataFrame) -> DataFrame:
    """(query_id, doc_id): the positives among ``judged``, whether or not pairs are repeated there."""
    rows = judged.where((relevance_band("score") == "pos") & F.col("query_id").isNotNull() & F.col("doc_id").isNotNull())
    return rows.select("query_id", "doc_id").distinct()


def labelled(judged: DataFrame, mapped: DataFrame, positives: DataFrame, queries: DataFrame) -> DataFrame:
    """``retriever_examples`` (query_id, doc_id, label_type) with all columns of ``queries``, a row a query with positives.

    ``judged`` may repeat pairs: scores and near misses meet in one aggregation, and no pair of queries comes to it of which
    one has no positive.
    """
    more = [c for c in queries.columns if c != "query_id"]
    own = judged.where("query_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL").join(queries, "query_id")
    near = mapped.withColumnRenamed("id", "query_id").join(queries, "query_id").join(positives.withColumnRenamed("query_id", "neighbour"), "neighbour")
    keys = ["query_id", "doc_id", *more]
    none = F.lit(None).cast(judged.schema["score"].dataType)
    rows = own.select(*keys, "score", F.lit(False).alias("near")).unionByName(near.select(*keys, none.alias("score"), F.lit(True).alias("near")))
    best = rows.groupBy(*keys).agg(F.max("score").alias("score"), F.max("near").alias("near"))
    kinds = {"pos": "pos", "neg": "easy", "hard": "hard"}
    band = relevance_band("score")
    label = F.coalesce(*[F.when(band == b, k) for b, k in kinds.items()], F.when(F.col("near"), "near_miss"))
    return best.select(*keys, label.alias("label_type")).where("label_type IS NOT NULL")


def retriever_examples(judged: DataFrame, mapped: DataFrame, categories: DataFrame | None = None, positives: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, label_type, label): judged documents by the band of their best score, and positives of near-miss
    (and same-category) queries that the query has not judged. Each document has one label, the first of ``PRECEDENCE``.

    ``positives`` are those of ``positives_of``, where they are known already.
    """
    if categories is not None:
        blocks = example_blocks(judged, mapped, categories, positives)
        return blocks.select("query_id", F.explode("docs").alias("doc_id"), "label_type", "label")
    positives = positives_of(judged) if positives is None else positives
    rows = labelled(judged, mapped, positives, positives.select("query_id").distinct())
    return rows.withColumn("label", (F.col("label_type") == "pos").cast("int"))


def _categorized(positives: DataFrame, categories: DataFrame) -> DataFrame:
    """(query_id, category): queries with positives; category null if it isn't known."""
    return positives.select("query_id").distinct().join(categories.select(F.col("id").alias("query_id"), "category"), "query_id", "left")


def example_counts(judged: DataFrame, mapped: DataFrame, categories: DataFrame, positives: DataFrame | None = None) -> DataFrame:
    """(label_type, n) of ``retriever_examples`` with siblings, which are not listed.

    A query's siblings are the positives of its category but those that it has a label for: counts by category and document
    hold both.
    """
    positives = positives_of(judged) if positives is None else positives
    queries = _categorized(positives, categories)
    kinds = [k for k in PRECEDENCE if k != "sibling"]
    docs = labelled(judged, mapped, positives, queries).groupBy("category", "doc_id").agg(*[F.count_if(F.col("label_type") == k).alias(k) for k in kinds])
    pooled = F.when(F.col("pos") > 0, sum(F.col(k) for k in kinds))
    whole = docs.groupBy("category").agg(F.count(pooled).alias("pool"), F.sum(pooled).alias("known"), *[F.sum(k).alias(k) for k in kinds])
    asked = queries.groupBy("category").agg(F.count(F.lit(1)).alias("queries"))
    whole = whole.join(asked, "category", "left").withColumn("sibling", F.col("queries") * F.col("pool") - F.col("known"))  # null without a category
    rows = whole.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label_type"), F.col(k).alias("n")) for k in PRECEDENCE])).alias("e"))
    return rows.groupBy("e.label_type").agg(F.sum("e.n").alias("n")).where("n > 0")


def example_blocks(judged: DataFrame, mapped: DataFrame, categories: DataFrame, positives: DataFrame | None = None) -> DataFrame:
    """(query_id, label_type, label, docs): ``retriever_examples`` with its siblings, which come many to an array.

    A query's siblings are the positives of its category without the documents that have a label already (its own
    positives are among those), so no queries are paired: each meets the blocks of its category's positives.
    ``categories`` has (id, category), one row an id.
    """
    positives = checkpointed(positives_of(judged)) if positives is None else positives
    everyone = _categorized(positives, categories)
    queries = everyone.where("category IS NOT NULL")
    chosen = labelled(judged, mapped, positives, everyone)
    pool = positives.join(queries, "query_id").select("category", "doc_id").distinct()
    sizes = checkpointed(pool.groupBy("category").agg(F.ceil(F.count(F.lit(1)) / SIBLING_BLOCK).cast("int").alias("blocks")))
    pool = checkpointed(pool.join(sizes, "category").select("category", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block")))
    known = chosen.join(pool, ["category", "doc_id"]).groupBy("query_id", "block").agg(F.collect_list("doc_id").alias("labelled"))
    wanted = queries.join(sizes, "category").select("query_id", "category", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    wanted = wanted.join(known, ["query_id", "block"], "left")
    lists = pool.groupBy("category", "block").agg(F.collect_list("doc_id").alias("all"))
    parts = 4 * parallelism(judged.sparkSession)
    met = wanted.repartition(parts, "category", "block").join(lists, ["category", "block"])
    met = met.where("labelled IS NULL OR size(labelled) < size(all)")  # a filter on the result would build it twice
    docs = F.when(F.col("labelled").isNull(), F.col("all")).otherwise(F.array_except("all", "labelled"))
    siblings = met.select("query_id", F.lit("sibling").alias("label_type"), F.lit(0).alias("label"), docs.alias("docs"))
    label = (F.col("label_type") == "pos").cast("int").alias("label")
    return chosen.select("query_id", "label_type", label, F.array("doc_id").alias("docs")).unionByName(siblings)


def parse_tricks(pairs: DataFrame) -> DataFrame:
    """(query_id, near_miss_id, target, target_query_id, text) of the ``trick_queries`` (array of strings) of pairs.

    An item is a labelled text, or a JSON object of text and target. One row a target query and text: of the least pair.
    """
    known = pairs.select(strip("query_id").alias("query_id"), strip("near_miss_id").alias("near_miss_id"), "trick_queries").where("query_id <> '' AND near_miss_id <> ''")
    items = known.select("query_id", "near_miss_id", F.posexplode("trick_queries").alias("place", "item"))
    keys = ("text", "query", "trick_query", "target", "label", "target_query_id")
    o = F.from_json("item", ", ".join(f"{k} string" for k in keys))
    first = lambda *names: F.coalesce(*[F.nullif(strip(o[k]), F.lit("")) for k in names])
    owner = F.when(o["target_query_id"] == F.col("query_id"), "A").when(o["target_query_id"] == F.col("near_miss_id"), "B")
    plain, is_object = parse_labelled("item"), strip("item").startswith("{")
    rows = items.select("*", F.when(is_object, F.coalesce(F.upper(first("target", "label")), owner)).otherwise(plain["target"]).alias("target"), F.when(is_object, first("text", "query", "trick_query")).otherwise(plain["text"]).alias("text"))
    rows = rows.where("target IN ('A', 'B') AND text IS NOT NULL").withColumn("target_query_id", F.when(F.col("target") == "A", F.col("query_id")).otherwise(F.col("near_miss_id")))
    chosen = rows.groupBy("target_query_id", "text").agg(F.min(F.struct("query_id", "near_miss_id", "place", "target")).alias("x"))
    return chosen.select("x.query_id", "x.near_miss_id", "x.target", "target_query_id", "text")


def trick_examples(tricks: DataFrame, examples: DataFrame) -> DataFrame:
    """Rows of ``parse_tricks`` with each row of ``retriever_examples`` of their target query."""
    return tricks.join(examples.withColumnRenamed("query_id", "target_query_id"), "target_query_id")


def difficulty(label_type: Column) -> Column:
    """pos, easy, or hard for everything else."""
    return F.when(label_type == "pos", "pos").when(label_type == "easy", "easy").otherwise("hard")


def curriculum(examples: DataFrame, epoch: int, hard_from: int, mixed: bool = True) -> DataFrame:
    """Examples of an epoch: positives and easy ones before ``hard_from``, then all, or positives and hard ones."""
    if epoch < hard_from:
        return examples.where("difficulty IN ('pos', 'easy')")
    return examples if mixed else examples.where("difficulty IN ('pos', 'hard')")


def carve_validation(ids: DataFrame, id_col: str, number: Column, ratio: float, seed: int) -> DataFrame:
    """(id, part): the first ``round(n * ratio)`` ids of the seeded order are ``val``, the others ``train``.

    The cut is found from counts per value of the order, of which there are about a million at most, and only ids at
    the cut itself are ranked: no global sort.
    """
    rows = ids.select(F.col(id_col), mixed_order(number, seed).alias("_o")).where(F.col(id_col).isNotNull() & F.col("_o").isNotNull()).distinct()
    counts = rows.groupBy("_o").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, 0))
    want = F.bround(F.sum("n").over(Window.partitionBy(F.lit(1))) * F.lit(ratio), 0)
    table = counts.select("_o", upto.alias("upto"), (upto - F.col("n")).alias("before"), want.alias("want"))
    joined = rows.join(table, "_o")
    tied = F.row_number().over(Window.partitionBy("_o").orderBy(id_col))
    return joined.withColumn("_t", tied).select(id_col, F.when(F.col("before") + F.col("_t") <= F.col("want"), "val").otherwise("train").alias("part"))


def seeded_sample(df: DataFrame, number: Column, tie: str, n: int | None, seed: int, group: str | None = None) -> DataFrame:
    """``n`` rows (of each group) without replacement, in seeded order; all rows if n is None or large, none if 0."""
    if n is None:
        return df
    keyed = df.withColumn("_o", mixed_order(number, seed))
    if group is None:
        return keyed.orderBy("_o", tie).limit(max(n, 0)).drop("_o")
    order = Window.partitionBy(group).orderBy("_o", tie)
    return keyed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_o", "_r")


def shards(df: DataFrame, order: str, parts: int) -> DataFrame:
    """``df`` with ``shard`` from 0: contiguous parts by ``order``, the first ones larger by one where it doesn't go up."""
    keyed = with_row_numbers(df, order, "_at", "_total")
    small, extra = F.floor(F.col("_total") / parts), F.pmod(F.col("_total"), F.lit(parts))
    large = extra * (small + 1)
    shard = F.when(F.col("_at") < large, F.floor(F.col("_at") / (small + 1))).otherwise(extra + F.floor((F.col("_at") - large) / F.greatest(small, F.lit(1))))
    return keyed.withColumn("shard", shard.cast("int")).drop("_at", "_total")


def minibatches(df: DataFrame, label: Column, number: Column, tie: str, size: int, seed: int) -> DataFrame:
    """``df`` with ``batch``: positives are dealt out evenly so that each batch has one while they last."""
    key = F.struct((~F.coalesce(label, F.lit(False))).alias("other"), mixed_order(number, seed).alias("order"), F.col(tie).alias("tie"))
    numbered = with_row_numbers(df.withColumn("_key", key), "_key", "_n", "_all")  # positives first
    batches = F.greatest(F.ceil(F.col("_all") / size), F.lit(1))
    return numbered.withColumn("batch", F.pmod("_n", batches).cast("int")).drop("_key", "_n", "_all")


def sentence_examples(questions: DataFrame, sentences: DataFrame, n_hard: int, n_random: int, seed: int) -> DataFrame:
    """(question_id, sentence_id, label, label_type): gold sentences, others of the same question, and others.

    ``questions`` has (question_id, number, gold array), ``sentences`` (sentence_id, question_id, number). Random
    negatives are those of the next questions in a seeded ring, so no question meets all sentences.
    """
    gold = questions.select("question_id", F.explode(F.array_distinct("gold")).alias("sentence_id"))
    known = sentences.select("sentence_id", F.col("number").alias("s_number"), F.col("question_id").alias("owner"))
    positive = gold.join(known, "sentence_id").select("question_id", "sentence_id", F.lit("pos").alias("label_type"))
    same = sentences.select("question_id", "sentence_id", "number").join(gold, ["question_id", "sentence_id"], "left_anti")
    same = same.join(questions.select("question_id"), "question_id", "left_semi")
    hard = seeded_sample(same, F.col("number"), "sentence_id", n_hard, seed, "question_id").select("question_id", "sentence_id", F.lit("hard").alias("label_type"))
    size = max(1, questions.count())
    ring = questions.select("question_id", F.pmod(mixed_order(F.col("number"), seed), F.lit(size)).alias("cell"))
    reach = ring.withColumn("cell", F.explode(F.array(*[F.pmod(F.col("cell") + i, F.lit(size)) for i in range(1, 2 * n_random + 2)])))
    others = reach.join(ring.withColumnRenamed("question_id", "owner"), "cell").where("owner <> question_id").select("question_id", "owner").distinct()
    pool = others.join(known, "owner").join(gold, ["question_id", "sentence_id"], "left_anti")
    random = seeded_sample(pool, F.col("s_number"), "sentence_id", n_random, seed + 1, "question_id").select("question_id", "sentence_id", F.lit("random").alias("label_type"))
    rows = positive.unionByName(hard).unionByName(random)
    return rows.withColumn("label", (F.col("label_type") == "pos").cast("int"))
