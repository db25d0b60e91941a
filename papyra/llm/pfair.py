"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Rows of a source, in order of id, form blocks. The target is the fluid mix: every source that still has blocks is served
in proportion to its integer weight w. In virtual time v a source of b blocks has had min(w * v, b) of them, so its block j
runs from v = j / w to (j + 1) / w, and R(v), the sum over all sources, is the slot that v falls on. Block j is released
at slot floor(R(j / w)) and due by slot ceil(R((j + 1) / w)); each slot goes to the released block with the earliest
deadline (then the smaller weight). Blocks inside any stretch of slots are no more than its slots, so every deadline is
met, and after any number of slots every source has had less than one block more or less than its target. When a source
ends, the others go on in proportion to their weights, without a restart, so the bound holds up to the last slot.

Sources of equal weight are served as one class with the sum of their rates; the class's slots go to its members layer by
layer (layer j holds block j of every member that has it, larger members first). With m members left, a member is within
(m - 1) / m of its share of the class and the class within one block of its own, so the bound stays below one, and a
schedule has as many competitors as there are different weights, whatever the number of sources.

At whole v all blocks before it are due and none after it is released, so the stretches between (rounds) are scheduled
alone, and rounds in which no source ends are alike: each kind of round is scheduled once. Rows find their slot from their
ordinal, by arithmetic and one join. Ordinals come from counts by (source, range of ids), ranges being quantiles of the
ids, so a source with a third of all rows is spread over many tasks. Work: a step for each slot of each kind of round,
never more than there are blocks; a kind of round is scheduled in one row, kinds are spread.

Defined results: a null source is a source of its own, a null id comes first; ids are numbers; repeated rows take slots of
their own (rows of one source and one id are ordered in one task); an empty table gives an empty table; columns of the
input pass through, those named like ours are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.shared import Stored, ordered_key

#: Rows of a range of ids, and ranges at most.
RANGE_ROWS, MOST_RANGES = 2_000, 4096
#: Slots whose picks are gathered before they join the others of their round.
RUN = 1024
#: Rows up to which the table of places is broadcast (it is counted first); beyond, places are joined by merge over SALTS.
BROADCAST_PLACES, SALTS = 200_000, 16
#: Sources up to which their few rounds are scheduled in one task, without an exchange.
FEW_SOURCES = 64
NULL_SOURCE = "null"


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(NULL_SOURCE))


def weight_of(key: Column, weights: Mapping[str | None, int], default: int) -> Column:
    known = F.create_map(*[x for s, w in sorted(weights.items(), key=str) for x in (F.lit(NULL_SOURCE if s is None else f"={s}"), F.lit(w))]) if weights else None
    return (F.lit(default) if known is None else F.coalesce(F.try_element_at(known, key), F.lit(default))).cast("long")


def last_not_above(value: Column, ordered: Sequence[int]) -> Column:
    """Place in ``ordered`` (ascending) of its last member not above ``value``, or -1: a search in two steps."""
    step = max(1, int(len(ordered) ** 0.5))
    heads = F.array(*[F.lit(x).cast("long") for x in ordered[::step]])
    below = lambda list_: F.size(F.filter(list_, lambda x: x <= value))
    head = below(heads) - 1
    chunks = F.array(*[F.array(*[F.lit(x).cast("long") for x in ordered[i : i + step]]) for i in range(0, len(ordered), step)])
    return F.when(head < 0, -1).otherwise(head * step + below(F.get(chunks, head)) - 1).cast("int")


def id_ranges(rows: DataFrame, n: int) -> list[int]:
    """Lower ends of ranges of about RANGE_ROWS rows each; they only spread work."""
    count = min(MOST_RANGES, n // RANGE_ROWS)
    if count < 2:
        return []
    found = rows.agg(F.percentile_approx("id", F.array(*[F.lit(i / count) for i in range(1, count)]), F.lit(10 * count))).first()[0]
    return sorted(set(found or []))


def round_layers(sources: DataFrame, weights: Sequence[int], few: bool = False) -> DataFrame:
    """From rows (w, blocks) of sources: (first, w, layer, members), the members of each weight with a block in each layer of each kind of round.

    ``few``: all of it in one task.
    """
    sizes = sources.groupBy("w", "blocks").agg(F.count("*").alias("members"))
    start = F.lit(0).cast("long")
    firsts = sizes.select(F.explode(F.array(start, _div(F.col("blocks"), F.col("w")), _div(F.col("blocks") + F.col("w") - 1, F.col("w")))).alias("first")).distinct()
    asked = firsts.select("first", F.explode(F.array(*[F.lit(w).cast("long") for w in weights])).alias("w"))
    asked = asked.select("first", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)).alias("layer"))
    asked = asked.select("w", (F.col("first") * F.col("w") + F.col("layer")).alias("at"), start.alias("members"), "first", "layer")
    ends = sizes.select("w", (F.col("blocks") - 1).alias("at"), "members", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("layer"))
    here = Window.partitionBy("w").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each different end
    both = asked.union(ends)
    return (both.coalesce(1) if few else both).withColumn("members", F.sum("members").over(here)).where("first is not null and members > 0").select("first", "w", "layer", "members")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _fluid(classes: Column, p: Column, q: Column) -> tuple[Column, Column]:
    """R at p / q of a round: a whole part and q times the rest. ``classes``: struct(w, members and slots before of each layer)."""
    def add(s: Column, c: Column) -> Column:
        layer = _div(p * c["w"], q).cast("int")
        inside = F.coalesce(F.get(c["members"], layer), F.lit(0).cast("long")) * (p * c["w"] % q)
        return F.struct((s["whole"] + F.coalesce(F.get(c["before"], layer), c["all"])).alias("whole"), (s["rest"] + inside).alias("rest"))

    none = F.lit(0).cast("long")
    total = F.aggregate(classes, F.struct(none.alias("whole"), none.alias("rest")), add)
    return total["whole"], total["rest"]


def round_jobs(layers: DataFrame) -> DataFrame:
    """(first, slots, base, jobs): for each weight the blocks of a round in order, each with release, due, layer and rank of its member; base: slots before."""
    byclass = layers.groupBy("first", "w").agg(F.array_sort(F.collect_list(F.struct("layer", "members"))).alias("l"), F.sum("members").alias("all"))
    members = F.transform("l", lambda x: x["members"])  # members never grow from layer to layer, so the layers kept are the first ones
    before = F.transform("l", lambda x, i: F.aggregate(F.slice(members, F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b))
    kinds = byclass.groupBy("first").agg(F.array_sort(F.collect_list(F.struct("w", members.alias("members"), before.alias("before"), "all"))).alias("classes"), F.sum("all").alias("slots"))
    order = Window.orderBy("first")  # one row for each different end of a source
    kinds = kinds.withColumn("span", (F.lead("first").over(order) - F.col("first")) * F.col("slots"))
    kinds = kinds.withColumn("base", F.coalesce(F.sum("span").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = kinds.select("first", "slots", "base", "classes", F.explode("classes").alias("c")).select("*", F.col("c.w").alias("w"), F.posexplode("c.members").alias("layer", "members"))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("members") - 1)).alias("rank"))
    q, p = F.col("members") * F.col("w"), F.col("layer") * F.col("members") + F.col("rank")
    (whole, rest), (whole_end, rest_end) = _fluid(F.col("classes"), p, q), _fluid(F.col("classes"), p + 1, q)
    keys = ("first", "slots", "base")
    windows = blocks.select(*keys, "w", F.col("layer").cast("long").alias("layer"), "rank", (whole + _div(rest, q)).alias("release"), (whole_end + _div(rest_end + q - 1, q)).alias("due"))
    lists = windows.groupBy(*keys, "w").agg(F.array_sort(F.collect_list(F.struct("layer", "rank", "release", "due"))).alias("blocks"))
    return lists.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("w", "blocks"))).alias("jobs"))


def earliest_deadlines(jobs: Column, slots: Column) -> Column:
    """For each slot of a round the class served and which of its blocks: array of struct(i, n)."""
    def slot(state: Column, t: Column) -> Column:
        def due(job: Column, done: Column) -> Column:
            block = F.get(job["blocks"], done)
            return F.when(block["release"] <= t, block["due"])

        waiting = F.zip_with(jobs, state["done"], due)
        first = F.array_min(F.transform(waiting, lambda d, i: F.when(d.isNotNull(), F.struct(d.alias("due"), i.alias("i")))))["i"]
        return F.struct(
            F.transform(state["done"], lambda n, i: F.when(i == first, n + 1).otherwise(n)).alias("done"),
            F.concat(state["order"], F.array(F.struct(first.alias("i"), F.get(state["done"], first).alias("n")))).alias("order"),
        )

    none = F.array().cast("array<struct<i: int, n: int>>")

    def run(state: Column, k: Column) -> Column:
        last = F.least((k + 1) * RUN, slots) - 1
        part = F.aggregate(F.sequence(k * RUN, last), F.struct(state["done"].alias("done"), none.alias("order")), slot)
        return F.struct(part["done"].alias("done"), F.concat(state["runs"], F.array(part["order"])).alias("runs"))

    start = F.struct(F.transform(jobs, lambda j: F.lit(0)).alias("done"), F.array().cast("array<array<struct<i: int, n: int>>>").alias("runs"))
    return F.flatten(F.aggregate(F.sequence(F.lit(0).cast("long"), _div(slots - 1, F.lit(RUN).cast("long"))), start, run, lambda s: s["runs"]))


def round_places(sources: DataFrame, weights: Sequence[int], few: bool = False) -> DataFrame:
    """(first, w, layer, rank, at, slots, base): the slot of every block of every kind of round; base counts the slots before its first round."""
    kinds = round_jobs(round_layers(sources.coalesce(1) if few else sources, weights, few))
    # the list is a row's own value from here on, not an expression that the fold would evaluate for each slot
    kinds = kinds.select("first", "slots", "base", F.explode(F.array("jobs")).alias("jobs"))
    placed = kinds.select("first", "slots", "base", "jobs", F.posexplode(earliest_deadlines(F.col("jobs"), F.col("slots"))).alias("at", "served"))
    job = F.get("jobs", F.col("served.i"))
    block = F.get(job["blocks"], F.col("served.n"))
    return placed.select("first", "slots", "base", "at", job["w"].alias("w"), block["layer"].alias("layer"), block["rank"].alias("rank"))


def interleave(df: DataFrame, weights: Mapping[str | None, int], default: int = 1, block_rows: int = 1, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``df`` with ``ordinal`` (in its source), ``slot`` (of its block, from 0) and ``in_block``."""
    ours = ("ordinal", "slot", "in_block")
    if min([default, *weights.values()]) < 1 or block_rows < 1:
        raise ValueError("weights and block_rows must be 1 or more")
    df = df.drop(*ours)
    passed = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in passed]).alias("row"), source_key(F.col(f"`{source}`").cast("string")).alias("key"), F.col(f"`{doc_id}`").alias("id"))
    bounds = id_ranges(rows, rows.count())
    rows = rows.withColumn("range", last_not_above(F.col("id"), bounds) if bounds else F.lit(0)).withColumn("id", ordered_key("id"))
    counts = rows.groupBy("key", "range").agg(F.count("*").alias("n"))
    across = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = Stored(counts.select("key", "range", "n", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("start")), "source-starts")
    sources = starts.read().groupBy("key").agg(F.sum("n").alias("n")).select("key", weight_of(F.col("key"), weights, default).alias("w"), F.ceil(F.col("n") / block_rows).alias("blocks"))
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("blocks"), "key")).cast("long") - 1  # one row for each source
    ranked = Stored(sources.withColumn("rank", rank), "source-ranks")
    few = ranked.read().count() <= FEW_SOURCES
    places = Stored(round_places(ranked.read(), sorted({default, *weights.values()}), few), "places")
    kinds = places.read().groupBy("first").agg(F.count("*")).collect()  # one row for each different end of a source, twice at most
    cuts, n_places = sorted(r[0] for r in kinds), sum(r[1] for r in kinds)

    inside = Window.partitionBy("key", "range").orderBy("id", *[F.xxhash64("row")])
    placed = rows.withColumn("nth", F.row_number().over(inside)).join(starts.read().drop("n").join(ranked.read().drop("blocks"), "key"), ["key", "range"])
    placed = placed.withColumn("ordinal", F.col("start") + F.col("nth") - 1).withColumn("block", F.floor(F.col("ordinal") / block_rows))
    placed = placed.withColumn("round", _div(F.col("block"), F.col("w"))).withColumn("layer", F.col("block") % F.col("w"))
    first = F.get(F.array(*[F.lit(c).cast("long") for c in cuts]), last_not_above(F.col("round"), cuts)) if cuts else F.lit(0).cast("long")
    placed = placed.withColumn("first", first)
    keys, where = ["first", "w", "layer", "rank"], places.read()
    if n_places <= BROADCAST_PLACES:
        placed = placed.join(F.broadcast(where), keys)
    else:
        where = where.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = placed.withColumn("salt", F.pmod(F.xxhash64("ordinal"), F.lit(SALTS)).cast("int")).join(where, [*keys, "salt"])
    slot = F.col("base") + (F.col("round") - F.col("first")) * F.col("slots") + F.col("at")
    return placed.select("row.*", F.col("ordinal"), slot.alias("slot"), (F.col("ordinal") % block_rows).cast("int").alias("in_block"))


def in_mixed_order(df: DataFrame, weights: Mapping[str | None, int], default: int = 1, block_rows: int = 1) -> DataFrame:
    """The rows of ``df``, its columns only, sorted by slot: files written from it hold the mix in order."""
    mixed = interleave(df, weights, default, block_rows)
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return mixed.repartitionByRange(parts, "slot", "in_block").sortWithinPartitions("slot", "in_block").select(*[F.col(f"`{c}`") for c in df.columns])
