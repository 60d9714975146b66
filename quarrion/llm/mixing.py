"""Mixing sources to target shares with hash-threshold histograms.

Each source gets whole passes over all its rows, as far as its quota goes, and for the rest the rows whose hash
is below a threshold. The threshold is found from histograms of tokens by source and hash bucket: the bucket in
which the quota falls is the only one refined, by the next bits of the hash, until it holds one row. What that row
is too large for is filled in the same way from the rows above the threshold that are much smaller, ``FILLS`` times.
Nothing is sorted and nothing but the histograms (sources x buckets) comes to the driver.

Shares come first: the mix is as large as the scarcest source allows when repeated ``max_repeats`` times, unless
``total_tokens`` asks for less. Targets of sources that have no tokens can't be met; the others are scaled up to
a sum of 1, and the report names them all. Sources are compared after trim and lower case; a null source, and one
without a target, is in no mix. Rows of no tokens are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.llm.tokens import VOCABULARY, with_token_counts
from quarrion.session import checkpointed, spread

#: Bits of the hash per histogram, and in all. 2 ** BITS x sources rows come to the driver at once.
BITS, HASH_BITS = 12, 60
#: Thresholds per source, and how much smaller than what is missing the rows of the next one are.
FILLS, FINER = 5, 3
#: Most sources that a target table may have.
MAX_SOURCES = 4096


@dataclass
class Quota:
    """What one source gives: ``passes`` times all its rows, and once more those that a (below, size) of
    ``thresholds`` admits: of a hash below it and of no more tokens."""

    source: str
    target: float
    share: float
    max_repeats: float
    available: int
    passes: int = 0
    rest: float = 0.0
    thresholds: list[tuple[int, int]] = field(default_factory=list)


def source_name(column: str) -> Column:
    """The name by which sources are compared."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def sized_sources(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, hash) of every document, a few bytes a row, checkpointed."""
    rows = spread(documents).select("doc_id", source_name("source").alias("source"), "text")
    sized = with_token_counts(rows, "text", vocabulary)
    return checkpointed(sized.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - HASH_BITS)))


def quotas(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> list[Quota]:
    """The quota of every source of the target table, before thresholds."""
    wanted = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    names = wanted.limit(MAX_SOURCES + 1).collect()
    if len(names) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums = sized.join(F.broadcast(wanted.select("source")), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t"))
    tokens = {r["source"]: r["t"] for r in sums.collect()}
    met = sum(r["target_share"] or 0 for r in names if tokens.get(r["source"], 0) > 0)
    plan = []
    for r in sorted(names):
        have, target = tokens.get(r["source"], 0), float(r["target_share"] or 0)
        share = target / met if have > 0 and met > 0 else 0.0
        plan.append(Quota(r["source"], target, share, float(r["max_repeats"] or 0), have))
    limits = [q.available * q.max_repeats / q.share for q in plan if q.share > 0]
    size = min(limits, default=0.0)
    if total_tokens is not None:
        size = min(size, total_tokens)
    for q in plan:
        if q.share > 0:
            want = min(size * q.share, q.available * q.max_repeats)
            q.passes = math.floor(want / q.available + 1e-9)
            q.rest = max(0.0, want - q.passes * q.available)
    return plan


def _by_source(values: dict[str, int], default: int) -> Column:
    """A value per source, as a literal map; its size is that of the target table."""
    if not values:
        return F.lit(default).cast("bigint")
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(default).cast("bigint"))


def find_thresholds(sized: DataFrame, plan: list[Quota]) -> None:
    """Set ``thresholds`` of each quota so that the rows admitted hold ``rest`` tokens as nearly as whole rows can."""
    most = (1 << 31) - 1
    left = {q.source: q.rest for q in plan if q.rest > 0}
    caps = dict.fromkeys(left, most)
    starts = dict.fromkeys(left, 0)
    quotas_by_name = {q.source: q for q in plan}
    for fill in range(FILLS):
        ends = _threshold(sized, left, caps, starts, fill == FILLS - 1)
        for name, end in ends.items():
            quotas_by_name[name].thresholds.append((end, caps[name]))
            caps[name] = int(left[name] / FINER)
        left = {name: left[name] for name in ends if caps[name] > 0 and left[name] > 0}
        starts = {name: ends[name] for name in left}
        if not left:
            return


def _threshold(sized: DataFrame, left: dict[str, float], caps: dict[str, int], starts: dict[str, int], nearest: bool) -> dict[str, int]:
    """The hash up to which rows from ``starts`` on, of at most ``caps`` tokens, hold no more than ``left``; that is
    reduced by what they hold. With ``nearest`` the next row is taken too if that comes nearer."""
    ends, open_ = dict(starts), set(left)
    prefix = dict.fromkeys(open_, 0)
    rows = sized.where(F.col("source").isin(*left)).where("n_tokens > 0")
    rows = rows.where((F.col("n_tokens") <= _by_source(caps, 0)) & (F.col("hash") >= _by_source(starts, 0)))
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        if not open_:
            break
        inside = rows.where(F.col("source").isin(*open_))
        inside = inside.where(F.expr(f"shiftright(hash, {shift + BITS})") == _by_source({k: prefix[k] for k in open_}, -1))
        bucket = F.expr(f"shiftright(hash, {shift}) & {(1 << BITS) - 1}").cast("int")
        counted = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
        histograms: dict[str, list] = {}
        for r in counted:
            histograms.setdefault(r["source"], []).append((r["bucket"], r["t"], r["n"]))
        for name in list(open_):
            base = prefix[name] << BITS
            for bucket_no, tokens, count in sorted(histograms.get(name, [])):
                if tokens <= left[name]:
                    left[name] -= tokens
                    ends[name] = max(ends[name], (base + bucket_no + 1) << shift)
                    continue
                if count > 1 and shift > 0:
                    ends[name] = max(ends[name], (base + bucket_no) << shift)
                    prefix[name] = base + bucket_no
                else:
                    if nearest and left[name] * 2 >= tokens:
                        ends[name] = max(ends[name], (base + bucket_no + 1) << shift)
                        left[name] = 0.0
                    open_.discard(name)
                break
            else:
                open_.discard(name)
    return ends


def apply_quotas(sized: DataFrame, plan: list[Quota]) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the rows in the mix: one filter over the rows, no shuffle."""
    passes = _by_source({q.source: q.passes for q in plan}, 0)
    admitted = F.lit(False)
    for fill in range(FILLS):
        given = {q.source: q.thresholds[fill] for q in plan if len(q.thresholds) > fill}
        if given:
            below, size = (_by_source({k: v[i] for k, v in given.items()}, 0) for i in (0, 1))
            admitted = admitted | ((F.col("hash") < below) & (F.col("n_tokens") <= size))
    copies = (passes + admitted.cast("int")).cast("int")
    return sized.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0 AND n_tokens > 0")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The mix of ``documents`` by ``targets`` (source, target_share, max_repeats)."""
    sized = sized_sources(documents, vocabulary)
    plan = quotas(sized, targets, total_tokens)
    find_thresholds(sized, plan)
    return apply_quotas(sized, plan)


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per source of the targets: shares asked for and reached, tokens, and how often its tokens are repeated."""
    sized = sized_sources(documents, vocabulary)
    plan = quotas(sized, targets, total_tokens)
    find_thresholds(sized, plan)
    got = apply_quotas(sized, plan).groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents")
    )
    rows = [(q.source, q.target, q.share, q.max_repeats, int(q.available)) for q in plan]
    asked = documents.sparkSession.createDataFrame(
        rows, "source string, target_share double, feasible_share double, max_repeats double, available_tokens bigint"
    )
    total = got.agg(F.sum("tokens").alias("total"))
    out = asked.join(F.broadcast(got), "source", "left").join(F.broadcast(total), F.lit(True), "left")
    return out.select(
        "source",
        "target_share",
        F.round("feasible_share", 9).alias("feasible_share"),
        "max_repeats",
        "available_tokens",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("tokens", F.lit(0)).alias("mix_tokens"),
        F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 9).alias("actual_share"),
        F.round(F.coalesce(F.try_divide("tokens", "available_tokens"), F.lit(0.0)), 9).alias("repeats"),
    )


def audit(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per source of the targets: share and cap asked for, documents that aren't empty, and whether its tokens in the mix
    exceed the cap times those at hand."""
    report = mix_report(documents, targets, None, vocabulary)
    held = documents.where(F.length("text") > 0).groupBy(source_name("source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    over = F.col("mix_tokens") > F.col("available_tokens") * F.col("max_repeats") + 1e-6
    return report.join(held, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("n", F.lit(0)).alias("documents"), over.alias("over_repeated"))
