"""Filling fixed-capacity containers: shortest-pack-first over the length histogram.

Only the histogram of item lengths comes to the driver; it has at most ``capacity`` entries, however many items
there are. Lengths are placed longest first, each item into the open pack that is filled least; if it does not fit
there it fits nowhere, and a new pack is opened. Equal packs are one pattern with a count, so whole groups of packs
are updated at once. The plan says, for every length, which ranks go to which containers; items get their rank within
their length from counts of salted slices, so a length that a third of all items have is spread over many tasks; plan
and items meet in an equi-join on (limit, length, block of ranks). All capacities go through one such join.

An item longer than the capacity is cut into full containers and one rest, which is packed like an item. Items of
no tokens take no room and get no container (``container`` null). Null texts are such items.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrion.llm.tokens import VOCABULARY, with_token_counts
from quarrion.session import checkpointed, parallelism, spread

#: Ranks of one length in a join key, so no key holds more rows than this.
BLOCK = 1 << 16
#: Least number of slices in which ranks within a length are counted; more where the session has more partitions.
SLICES = 64


def plan_packs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go: (length, first_rank, packs, per_pack, first_container, offset).

    Ranks first_rank, first_rank + 1, ... fill the containers first_container, ... in turn, ``per_pack`` items
    each, beginning ``offset`` tokens from the container's start. ``packs`` counts the containers.
    """
    # tokens left -> groups of equal packs (count, pattern); a pattern is (pattern before, length, per_pack)
    room: dict[int, list[tuple[int, tuple | None]]] = defaultdict(list)
    lefts: list[int] = []

    def put(left: int, count: int, pattern: tuple | None) -> None:
        if not room[left]:
            bisect.insort(lefts, left)
        room[left].append((count, pattern))

    for length in sorted((n for n in histogram if 0 < n <= capacity), reverse=True):
        count = histogram[length]
        while count:
            if lefts and lefts[-1] >= length:  # the pack filled least
                left, each = lefts[-1], 1
                held, pattern = room[left].pop()
                if not room[left]:
                    lefts.pop()
            else:  # a new pack is filled least until the next item does not fit into it
                left, each, pattern = capacity, min(capacity // length, count), None
                held = count // each
            packs = min(held, count)
            if packs < held:
                put(left, held - packs, pattern)
            put(left - each * length, packs, (pattern, length, each))
            count -= packs * each
    rows, ranks, container = [], defaultdict(int), 0
    for left in sorted(room):
        for packs, pattern in room[left]:
            parts = []
            while pattern:
                parts.append(pattern[1:])
                pattern = pattern[0]
            offset = 0
            for length, each in reversed(parts):
                rows.append((length, ranks[length], packs, each, container, offset))
                ranks[length] += packs * each
                offset += length * each
            container += packs
    return rows


def slice_ranks(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``items`` with ``rank``, from 0 within each of ``keys``: salted slices are ranked apart and their counts added up."""
    slices = max(SLICES, 2 * parallelism(items.sparkSession))
    salted = items.withColumn("slice", F.pmod(F.xxhash64(order), F.lit(slices)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    within = Window.partitionBy(*keys, "slice").orderBy(order)
    ranked = salted.withColumn("within", F.row_number().over(within) - 1)
    return ranked.join(sizes, [*keys, "slice"]).withColumn("rank", F.col("base") + F.col("within")).drop("base", "within", "slice")


def pack(sized: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """(limit_id, item, part, length, container, offset) of ``sized`` (item bigint unique, n_tokens int) for every
    (limit_id, capacity).

    ``part`` counts the pieces of an item that exceeds the capacity; part 0 is the only one of any other. Items
    in one container keep the order of ``offset``.
    """
    spark = sized.sparkSession
    limits = F.explode(F.array(*(F.struct(F.lit(i).alias("limit_id"), F.lit(c).alias("capacity")) for i, c in capacities)))
    each = sized.select("item", "n_tokens", limits.alias("l")).select("item", "n_tokens", "l.*")
    each = each.withColumn("full", F.greatest(F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int"), F.lit(0)))
    length = F.greatest(F.col("n_tokens") - F.col("full") * F.col("capacity"), F.lit(0)).cast("int")
    rest = each.select("limit_id", "item", F.col("full").alias("part"), length.alias("length"))
    histograms: dict[int, dict[int, int]] = {limit: {} for limit, _ in capacities}
    for r in rest.groupBy("limit_id", "length").agg(F.count(F.lit(1)).alias("size")).collect():
        histograms[r["limit_id"]][r["length"]] = r["size"]
    rows = [(limit, *row) for limit, capacity in capacities for row in plan_packs(histograms[limit], capacity)]
    used = {limit: sum(r[3] for r in rows if r[0] == limit and r[6] == 0) for limit, _ in capacities}
    plan = spark.createDataFrame(
        rows, "limit_id int, length int, first_rank bigint, packs bigint, per_pack int, first_container bigint, base int"
    )
    last = F.col("first_rank") + F.col("packs") * F.col("per_pack") - 1
    plan = plan.withColumn("last_rank", last).withColumn("block", F.explode(F.sequence(F.floor(F.col("first_rank") / BLOCK), F.floor(last / BLOCK))))

    ranked = slice_ranks(rest.where("length > 0"), ["limit_id", "length"], "item").withColumn("block", F.floor(F.col("rank") / BLOCK))
    placed = ranked.join(plan, ["limit_id", "length", "block"]).where(F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    turn = F.col("rank") - F.col("first_rank")
    placed = placed.select(
        "limit_id",
        "item",
        "part",
        "length",
        (F.col("first_container") + F.floor(turn / F.col("per_pack"))).alias("container"),
        (F.col("base") + F.pmod(turn, F.col("per_pack")) * F.col("length")).cast("int").alias("offset"),
    )
    empty = rest.where("length <= 0").select("limit_id", "item", "part", "length", F.lit(None).cast("bigint").alias("container"), F.lit(0).alias("offset"))

    over = each.where("full > 0").select("limit_id", "capacity", "item", F.col("full").alias("n"))
    bases = over.groupBy("limit_id", "n").agg(F.count(F.lit(1)).alias("size"))
    running = Window.partitionBy("limit_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    first = F.create_map(*(F.lit(x) for pair in used.items() for x in pair)) if used else F.create_map()
    bases = bases.select("limit_id", "n", (first[F.col("limit_id")] + F.coalesce(F.sum(F.col("size") * F.col("n")).over(running), F.lit(0))).alias("base"))
    cut = slice_ranks(over, ["limit_id", "n"], "item").join(bases, ["limit_id", "n"]).select(
        "limit_id",
        "item",
        F.posexplode(F.array_repeat("capacity", F.col("n"))).alias("part", "length"),
        (F.col("base") + F.col("rank") * F.col("n")).alias("first"),
    )
    cut = cut.select("limit_id", "item", "part", "length", (F.col("first") + F.col("part")).alias("container"), F.lit(0).alias("offset"))
    return placed.unionByName(empty).unionByName(cut)


def pack_documents(documents: DataFrame, capacities: list[tuple[int, int]], vocabulary: str = VOCABULARY) -> DataFrame:
    """(limit_id, doc_id, part, n_tokens, container, offset) of every document for every (limit_id, capacity).

    The few-byte table (doc_id, n_tokens) is checkpointed, so texts are read and tokenized once for all limits.
    Every doc_id must be unique. A row without one can't be told from another: it is in no container, and
    ``documents`` of the test data have none.
    """
    sized = with_token_counts(spread(documents).select(F.col("doc_id").cast("bigint").alias("item"), "text"), "text", vocabulary)
    sized = checkpointed(sized.where("item IS NOT NULL"))
    return pack(sized, capacities).withColumnsRenamed({"item": "doc_id", "length": "n_tokens"})


def container_limits(size_limits: DataFrame) -> list[tuple[int, int]]:
    """(limit_id, max_tokens) of the fixed table's container sizes."""
    rows = size_limits.where("purpose = 'container' AND max_tokens > 0").select("limit_id", "max_tokens").orderBy("limit_id")
    return [(r[0], r[1]) for r in rows.collect()]


def fill_report(packed: DataFrame, size_limits: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, share of the space that is used, items, and items cut."""
    containers = packed.where("container IS NOT NULL").groupBy("limit_id", "container").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"), F.sum((F.col("part") > 0).cast("int")).alias("later_parts")
    )
    report = containers.groupBy("limit_id").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
        F.sum("items").alias("pieces"),
        F.sum("later_parts").alias("later_parts"),
    )
    sizes = size_limits.select("limit_id", "max_tokens")
    return report.join(sizes, "limit_id").withColumn(
        "used_share", F.round(F.col("tokens") / (F.col("containers") * F.col("max_tokens")), 6)
    )


def audit(packed: DataFrame, size_limits: DataFrame) -> DataFrame:
    """Per limit: different documents, containers over it, containers whose items overlap or leave gaps, and documents
    that were divided though they fit."""
    sizes = size_limits.where("purpose = 'container'").select("limit_id", "max_tokens")
    boxes = packed.where("container IS NOT NULL").groupBy("limit_id", "container").agg(F.sum("n_tokens").alias("n"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"), F.countDistinct("offset").alias("places"), F.count(F.lit(1)).alias("items"))
    boxes = boxes.join(sizes, "limit_id").groupBy("limit_id").agg(
        F.sum((F.col("n") > F.col("max_tokens")).cast("int")).alias("overfull"), F.sum(((F.col("n") != F.col("end")) | (F.col("places") != F.col("items"))).cast("int")).alias("colliding")
    )
    items = packed.groupBy("limit_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max("part").alias("parts")).join(sizes, "limit_id")
    items = items.groupBy("limit_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(((F.col("parts") > 0) & (F.col("n") <= F.col("max_tokens"))).cast("int")).alias("divided"))
    return items.join(boxes, "limit_id").select("limit_id", "documents", "overfull", "colliding", "divided")
