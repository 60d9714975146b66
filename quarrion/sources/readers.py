"""Readers: line and array JSON, CSV, TSV judgements, wiki pages, YAML pairs, metric files, run summaries, vectors, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.functions.text import clean_text, strip, truncating_int
from quarrion.operators.ordinals import with_row_numbers
from quarrion.schemas import schema


def read_jsonl(spark: SparkSession, path: str, fields: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; blank and malformed lines are skipped."""
    return spark.read.schema(fields).option("mode", "DROPMALFORMED").json(path)


def count_malformed(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    """One row: lines read and lines skipped."""
    marked = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(marked).option("columnNameOfCorruptRecord", "_corrupt").json(path).select("_corrupt", F.lit(1).alias("one"))
    return rows.agg(F.count("one").alias("lines"), F.count("_corrupt").alias("skipped"))


def read_json_array(spark: SparkSession, path: str, fields: T.StructType | str, most: int | None = None) -> DataFrame:
    """Rows of a JSON array document, with ``ordinal``; the first ``most`` of them if given."""
    return _numbered(spark.read.schema(fields).option("multiLine", True).json(path), most)


def read_csv(spark: SparkSession, path: str, fields: T.StructType | str, most: int | None = None) -> DataFrame:
    """Rows of a CSV with a header and quoted line breaks, with ``ordinal``; the first ``most`` if given."""
    rows = spark.read.schema(fields).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return _numbered(rows, most)


def _numbered(rows: DataFrame, most: int | None) -> DataFrame:
    """``rows`` with ``ordinal``, the number of a row from 0 without gaps, in the order of files and of rows in them."""
    placed = with_row_numbers(rows.withColumn("_at", F.monotonically_increasing_id()), "_at", "ordinal").drop("_at")
    return placed if most is None else placed.where(F.col("ordinal") < most)


def read_confusion_report(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, neighbour, hits, hit_rate) of the confused pairs of a report written as one JSON document."""
    pairs = "array<struct<query_id:string,near_miss_id:string,hits:bigint,hit_rate:double>>"
    rows = spark.read.schema(f"pairs {pairs}").option("multiLine", True).json(path).select(F.explode("pairs").alias("p"))
    return rows.select("p.query_id", F.col("p.near_miss_id").alias("neighbour"), "p.hits", "p.hit_rate").where("query_id IS NOT NULL AND neighbour IS NOT NULL")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, score) of a TSV; blank ids and unreadable scores are dropped, fractions cut off."""
    rows = spark.read.schema(schema("qrels")).option("sep", "\t").option("header", True).csv(path)
    rows = rows.select(strip("`query-id`").alias("query_id"), strip("`corpus-id`").alias("doc_id"), truncating_int("score").alias("score"))
    return rows.where("query_id <> '' AND doc_id <> '' AND score IS NOT NULL")


def clause_queries(raw: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """(query_id, text, category, split, type, parent_query_id): trimmed ids, the last row of an id, text defaulting to it."""
    rows = raw.select(strip("_id").alias("query_id"), strip("text").alias("text"), "metadata", F.col(ordinal).alias("_o")).where("query_id <> ''")
    last = rows.groupBy("query_id").agg(F.max_by(F.struct("text", "metadata"), "_o").alias("r"))
    return last.select("query_id", F.coalesce(F.nullif("r.text", F.lit("")), F.col("query_id")).alias("text"), "r.metadata.*")


def clause_corpus(raw: DataFrame) -> DataFrame:
    """(doc_id, text) with clean, non-blank texts."""
    return raw.select(strip("_id").alias("doc_id"), clean_text("text").alias("text")).where("doc_id <> '' AND text <> ''")


def wiki_sentences(pages: DataFrame) -> DataFrame:
    """(page, sentence_no, sentence) of pages whose ``lines`` hold a number, a tab and a sentence each."""
    rows = pages.select(F.col("id").alias("page"), F.explode(F.split("lines", "\n")).alias("line"))
    parts = F.split("line", "\t")
    rows = rows.select("page", F.get(parts, F.lit(0)).try_cast("int").alias("sentence_no"), strip(F.get(parts, F.lit(1))).alias("sentence"))
    return rows.where("sentence_no IS NOT NULL AND sentence <> ''")


def flat_evidence(claims: DataFrame) -> DataFrame:
    """(id, claim, label, gold array): distinct page_sent ids of the nested evidence, in order; short tuples are left out."""
    flat = F.filter(F.flatten("evidence"), lambda e: (F.size(e) >= 4) & F.get(e, F.lit(2)).isNotNull())
    ids = F.transform(flat, lambda e: F.concat(F.get(e, F.lit(2)), F.lit("_sent"), F.coalesce(F.get(e, F.lit(3)), F.lit("0"))))
    return claims.select("id", "claim", "label", F.array_distinct(ids).alias("gold"))


def parse_pairs(document: object) -> list[tuple[str, str]]:
    """Pairs of a parsed YAML document: a list of pairs, of mappings, a mapping to lists, or any under ``pairs``."""
    if isinstance(document, dict) and "pairs" in document:
        return parse_pairs(document["pairs"])
    found: list[tuple] = []
    if isinstance(document, dict):
        for key, value in document.items():
            found += [(key, x) for x in (value if isinstance(value, list) else [value])]
    elif isinstance(document, list):
        for item in document:
            if isinstance(item, dict):
                values = [item.get(k) for k in ("a", "b")] if "a" in item else list(item.values())
                found.append(tuple(values[:2]))
            elif isinstance(item, (list, tuple)):
                found.append(tuple(item[:2]))
    out: dict[tuple[str, str], None] = {}
    for pair in found:
        ends = [str(x).strip() for x in pair if x is not None]
        if len(ends) == 2 and all(ends) and ends[0] != ends[1]:
            out[(ends[0], ends[1])] = None
    return list(out)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) of a YAML file of near-miss pairs, without blank, self and repeated ones. The file is a small hand-written one."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(parse_pairs(yaml.safe_load(text)), schema("near_miss"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a file with one number a line; other lines are skipped."""
    return spark.read.text(path).select(F.col("value").try_cast("double").alias("value")).where("value IS NOT NULL")


def read_summaries(spark: SparkSession, root: str, fields: T.StructType) -> DataFrame:
    """Run summaries of any depth below a folder, with ``dataset`` and ``split`` from the two folders above each."""
    rows = spark.read.schema(fields).option("recursiveFileLookup", True).option("pathGlobFilter", "summary_metrics_*.json").option("multiLine", True).json(root)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.select("*", F.try_element_at(parts, F.lit(-3)).alias("dataset"), F.try_element_at(parts, F.lit(-2)).alias("split"))


def flatten_sections(df: DataFrame, sections: list[str]) -> DataFrame:
    """Fields of the sections at top level, beside what is no section; of a repeated name the last one counts."""
    fields: dict[str, Column] = {c: F.col(c) for c in df.columns if c not in sections}
    for section in sections:
        if section in df.columns:
            fields |= {f.name: F.col(f"{section}.{f.name}") for f in df.schema[section].dataType.fields}
    return df.select(*[c.alias(n) for n, c in fields.items()])


def read_vectors(spark: SparkSession, vectors: str, metadata: str) -> DataFrame:
    """Vectors joined with their metadata by vec_id; raises if either side has an id that the other lacks."""
    left, right = spark.read.parquet(vectors), spark.read.parquet(metadata)
    odd = left.select("vec_id").join(right.select("vec_id"), "vec_id", "left_anti").unionByName(right.select("vec_id").join(left.select("vec_id"), "vec_id", "left_anti"))
    if not odd.isEmpty():
        raise ValueError("vectors and metadata have different ids")
    return left.join(right, "vec_id")


def check_vec_ids(df: DataFrame, size: int) -> DataFrame:
    """``df``; raises if a vec_id is null or not from 0 to ``size`` - 1."""
    if not df.where(F.col("vec_id").isNull() | (F.col("vec_id") < 0) | (F.col("vec_id") >= size)).isEmpty():
        raise ValueError("vec_id out of range")
    return df


def read_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a passage graph kept as two tables."""
    return spark.read.parquet(nodes), spark.read.parquet(edges)


def field_map_context(df: DataFrame) -> DataFrame:
    """(question_id, title, sent_idx, sentence, gold) of records with nested titled sentence lists."""
    rows = df.select(F.col("_id").alias("question_id"), "supporting_facts", F.explode("context").alias("c"))
    rows = rows.select("question_id", "supporting_facts", F.col("c.title").alias("title"), F.posexplode("c.sents").alias("sent_idx", "sentence"))
    gold = F.exists("supporting_facts", lambda f: (f["title"] == F.col("title")) & (f["idx"] == F.col("sent_idx")))
    return rows.select("question_id", "title", "sent_idx", "sentence", F.coalesce(gold, F.lit(False)).alias("gold"))


def field_map_paragraphs(df: DataFrame) -> DataFrame:
    """(passage_id, question_id, title, text, gold) of records with numbered paragraphs; the place stands in for a null number."""
    rows = df.select(F.col("id").alias("question_id"), F.posexplode("paragraphs").alias("place", "p"))
    number = F.coalesce("p.idx", "place")
    return rows.select(
        F.concat("question_id", F.lit("_sent"), number.cast("string")).alias("passage_id"),
        "question_id",
        F.col("p.title").alias("title"),
        F.col("p.paragraph_text").alias("text"),
        F.coalesce("p.is_supporting", F.lit(False)).alias("gold"),
    )


def unaliased(gold: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """(key, gold array): gold ids replaced by the ids kept for them, distinct, in order."""
    rows = gold.select(key, F.posexplode("gold").alias("place", "dropped_id"))
    joined = rows.join(aliases, "dropped_id", "left").withColumn("id", F.coalesce("kept_id", "dropped_id"))
    firsts = joined.groupBy(key, "id").agg(F.min("place").alias("place"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("gold"))


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    window = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(window)).where("_r = 1").drop("_r")
