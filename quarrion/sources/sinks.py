"""Writers, resume by key, versions and table paths."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def next_version(spark: SparkSession, path: str) -> str:
    """``path``, or ``path.v2``, ``.v3``, ... the first that is free."""
    free, number = path, 2
    while _exists(spark, free):
        free, number = f"{path}.v{number}", number + 1
    return free


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write JSON lines; ``mode`` overwrite, append or versioned. Returns the path written."""
    if mode == "versioned":
        path, mode = next_version(df.sparkSession, path), "errorifexists"
    df.write.mode(mode).json(path)
    return path


def unprocessed(df: DataFrame, done: DataFrame, key: str, required: str | None = None) -> DataFrame:
    """Rows whose key is not in ``done`` (there with a value of ``required`` if one is named): resume as an anti-join."""
    known = done if required is None else done.where(F.col(required).isNotNull())
    return df.join(known.select(key).distinct(), key, "left_anti")


def append_unprocessed(df: DataFrame, path: str, key: str) -> int:
    """Append what ``path`` does not have yet; returns how many rows. A repeated call appends nothing."""
    spark = df.sparkSession
    fresh = unprocessed(df, spark.read.schema(df.schema).parquet(path), key) if _exists(spark, path) else df
    fresh = fresh.dropDuplicates([key]).persist()
    count = fresh.count()
    if count:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return count


def concat_shards(shards: list[DataFrame]) -> DataFrame:
    """Shards one after another, columns by name."""
    out = shards[0]
    for shard in shards[1:]:
        out = out.unionByName(shard, allowMissingColumns=True)
    return out


def model_shards(model: str) -> int:
    """Shards by a model's size in its name: four up to 8 billion parameters, two up to 20, else one."""
    found = re.search(r"(\d+(?:\.\d+)?)\s*b\b", model.lower())
    size = float(found.group(1)) if found else float("inf")
    return 4 if size <= 8 else 2 if size <= 20 else 1


def write_packages(packages: DataFrame, root: str) -> None:
    """Training packages: all, those with positives and easy negatives, those with positives and hard ones."""
    packages.write.mode("overwrite").json(f"{root}/all")
    packages.where(F.size("neg") > 0).drop("hard_neg").write.mode("overwrite").json(f"{root}/pos_easy")
    packages.where(F.size("hard_neg") > 0).drop("neg").write.mode("overwrite").json(f"{root}/pos_hard")


def write_examples(examples: DataFrame, root: str) -> None:
    """Retriever examples (query_id, doc_id, label_type, label) as JSON lines in a folder of each label type."""
    examples.write.mode("overwrite").partitionBy("label_type").json(root)


def read_examples(spark: SparkSession, root: str) -> DataFrame:
    """What ``write_examples`` wrote."""
    return spark.read.schema("query_id string, doc_id string, label int, label_type string").json(root)


def ontology_summary(labels: DataFrame, near_misses: DataFrame, unknown: DataFrame) -> str:
    """Counts of an ontology as one JSON document; nothing of the size of the data is collected."""
    sizes = labels.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.count(F.lit(1)).alias("categories"), F.sum("n").alias("labels"), F.max("n").alias("largest_category")).first()
    more = {"near_miss_pairs": near_misses.count(), "unknown_ids": unknown.count()}
    return json.dumps({**{k: v or 0 for k, v in top.asDict().items()}, **more}, indent=2)


def write_tricks(tricks: DataFrame, path: str) -> None:
    """Trick queries as JSON lines, one document a pair: its texts in order, labelled by their target."""
    labelled = F.concat(F.col("target"), F.lit(": "), F.col("text"))
    pairs = tricks.groupBy("query_id", "near_miss_id").agg(F.array_sort(F.collect_list(labelled)).alias("trick_queries"))
    pairs.write.mode("overwrite").json(path)


def markdown_report(title: str, rows: DataFrame, most: int = 200) -> str:
    """A Markdown table of at most ``most`` rows, for people; it says how many rows are left out."""
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
    shown = rows.limit(most + 1).collect()
    lines += ["| " + " | ".join(str(v) for v in r) + " |" for r in shown[:most]]
    if len(shown) > most:
        lines += ["", f"{rows.count() - most} more rows are not shown."]
    return "\n".join(lines) + "\n"


def pairs_yaml(pairs: DataFrame, most: int = 100_000) -> str:
    """Near-miss pairs as YAML text; a table for hand editing, so its size is checked."""
    rows = pairs.select("a", "b").orderBy("a", "b").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many pairs for a hand-edited file")
    return "pairs:\n" + "".join(f"  - [{r['a']!r}, {r['b']!r}]\n" for r in rows)


@dataclass(frozen=True)
class Catalog:
    """Where tables lie: ``root/kind/dataset/split/name``, so that readers prune by folder."""

    root: str

    @staticmethod
    def dataset_name(name: str) -> str:
        """Canonical form of a dataset's name."""
        return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")

    def path(self, kind: str, dataset: str, split: str, name: str) -> str:
        """Path of a table."""
        return f"{self.root}/{kind}/{self.dataset_name(dataset)}/{split.strip().lower()}/{name}"

    def representations(self, dataset: str, split: str) -> dict[str, str]:
        """Paths of a split's vectors and their metadata."""
        return {n: self.path("representations", dataset, split, n) for n in ("passages", "passages_emb", "index")}
