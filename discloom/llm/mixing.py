"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations.

The rows of each source are numbered in id order and cut into blocks.  Target
weights are whole numbers; of W slots, W being their sum, source s with weight
w has exactly w.  Block i of source s is released at slot floor(i * W / w) and
due by slot ceil((i + 1) * W / w).  Running the released block with the earliest
deadline in every slot meets all deadlines, so after any number of slots each
source is less than one block away from its weight.  After W slots all lags are
zero and the schedule repeats: it is computed once, as far as there are blocks,
and the slot of any block follows from its number alone.

Sources of equal weight have equal releases and deadlines and take turns, so
the schedule is worked out for the distinct weights, of which there are at most
sqrt(2 * W), however many sources there are.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discloom.llm.support import cut, fresh

#: Sum of the weights that sources have by default, about.
PARTS = 1000
#: Parts of a source's default weight at least, on average, so that weights differ however many sources there are.
SOURCE_PARTS = 8
#: Slots that are worked out at once.
TURN = 1 << 18
#: Rows of one block of a source.
BLOCK_ROWS = 32


#: Greatest common divisor of the weights, by Euclid's steps: 92 do for any two long numbers.
COMMON = """
    aggregate(collect_set(weight), 0L, (g, w) -> aggregate(sequence(1, 92), named_struct('a', g, 'b', w),
        (p, i) -> if(p.b = 0, p, named_struct('a', p.b, 'b', p.a % p.b))).a)
"""


def whole_weights(weights: dict[str | None, float]) -> dict[str | None, int]:
    """The least whole numbers in exactly the proportions of ``weights``; 0.1 is taken as one tenth."""
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    if any(v < 0 for v in exact.values()):
        raise ValueError("weights can't be negative")
    unit = lcm(*(v.denominator for v in exact.values())) if exact else 1
    whole = {k: int(v * unit) for k, v in exact.items()}
    common = reduce(gcd, whole.values(), 0) or 1
    return {k: v // common for k, v in whole.items()}


def target_weights(counts: DataFrame, weights: dict[str | None, float] | DataFrame | None, parts: int = PARTS) -> DataFrame:
    """``source, rows, idx int, weight long`` of each source in ``counts (source, rows)``.

    ``weights`` maps sources to their weights, as a dict or as rows ``(source,
    weight long)`` with distinct sources; a source that it leaves out has weight
    0.  By default a source's weight is the square root of its rows in ``parts``
    parts of all, or in eight parts a source if these are more; a whole number
    and 1 at least.  Sources without rows take no part.  There is one row for
    each source, so the windows here are narrow.
    """
    every = Window.partitionBy(F.lit(0))
    counts = counts.withColumn("idx", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_first())) - 1).cast("int"))
    if weights is None:
        root = F.sqrt(F.col("rows").cast("double"))
        parts = F.greatest(F.lit(parts), F.count("*").over(every) * SOURCE_PARTS)
        weight = F.greatest(F.lit(1), F.floor(F.round(root * parts / F.sum(root).over(every), 6) + 0.5)).cast("long")
        return counts.select("source", "rows", "idx", weight.alias("weight"))
    if isinstance(weights, dict):
        weight = F.lit(0)
        for name, value in whole_weights(weights).items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(value)).otherwise(weight)
        return counts.select("source", "rows", "idx", weight.cast("long").alias("weight"))
    given = weights.select(F.col("source").alias("of"), F.col("weight").cast("long").alias("weight"))
    joined = counts.join(given, F.col("source").eqNullSafe(F.col("of")), "left")
    joined = joined.select("source", "rows", "idx", F.coalesce("weight", F.lit(0).cast("long")).alias("weight"))
    # Divided by what they have in common: the schedule is the same, its cycle shorter.
    joined = cut(joined)
    common = joined.agg(F.expr(COMMON)).first()[0] or 1
    return joined.withColumn("weight", F.expr(f"weight div {common}L"))


#: Slots from ``low`` to ``high``, one after another: of each distinct weight the next block's deadline, place, release and number
#: among all blocks of that weight.
FOLD = """
    transform(array(aggregate(sequence({low}L, {high}L - 1, 512L), named_struct('next', next, 'order', cast(array() AS array<array<int>>)),
        (o, low) -> transform(array(
            aggregate(sequence(low, least(low + 511, {high}L - 1)), named_struct('next', o.next, 'order', cast(array() AS array<int>)),
                (s, t) -> transform(array(array_min(transform(s.next, n -> if(n.release <= t, n, null)))), pick -> named_struct(
                    'next', transform(s.next, n -> if(n.j = pick.j, named_struct(
                        'due', ((((n.ran + 1) div kinds[n.j].m) + 1) * cycle + kinds[n.j].w - 1) div kinds[n.j].w, 'j', n.j,
                        'release', (((n.ran + 1) div kinds[n.j].m) * cycle) div kinds[n.j].w, 'ran', n.ran + 1), n)),
                    'order', concat(s.order, array(pick.j))))[0])
        ), r -> named_struct('next', r.next, 'order', concat(o.order, array(r.order))))[0])),
    o -> named_struct('next', o.next, 'order', flatten(o.order)))[0]
"""
FIRST = "transform(kinds, (k, j) -> named_struct('due', (cycle + k.w - 1) div k.w, 'j', j, 'release', 0L, 'ran', 0L))"


def schedule(shares: DataFrame, slots: int | None = None) -> DataFrame:
    """Earliest deadline first until all lags are zero: ``idx int, nth long, at long, cycle long``.

    ``at`` is the slot of the ``nth`` block of a source with a weight.  Of blocks
    with one deadline, that of the heavier source comes first, then that of the
    lesser ``idx``.  ``slots`` is how many are wanted where that is fewer.  One
    array of distinct weights is folded over the slots, in turns of ``TURN``
    slots that each write theirs and hand the array on: a task's memory is
    bounded by a turn and the weights, and the time is linear in the slots.
    """
    own = shares.filter("weight > 0").select("idx", "weight")
    turn = (F.row_number().over(Window.partitionBy("weight").orderBy("idx")) - 1).cast("long")
    members = own.select("idx", "weight", turn.alias("turn"))
    kinds = own.groupBy("weight").agg(F.count("*").alias("m"))
    one = kinds.groupBy().agg(F.expr("sort_array(collect_list(struct(weight AS w, m)), false)").alias("kinds"), F.sum(F.col("weight") * F.col("m")).alias("cycle"))
    one = cut(one.select("kinds", F.coalesce("cycle", F.lit(0).cast("long")).alias("cycle"), F.expr(FIRST).alias("next")))
    cycle = one.first()["cycle"]
    end, turns = cycle if slots is None else min(cycle, slots), []
    for low in range(0, max(end, 1), TURN):
        ran = one.filter(F.size("kinds") > 0)
        if low < end:
            ran = cut(ran.select("kinds", "cycle", F.expr(FOLD.format(low=low, high=min(low + TURN, end))).alias("r")))
            one = ran.select("kinds", "cycle", "r.next")
        else:
            ran = ran.select("kinds", "cycle", F.struct("next", F.expr("cast(array() AS array<int>)").alias("order")).alias("r"))
        turns.append(ran.select("kinds", "cycle", F.posexplode("r.order").alias("at", "j")).withColumn("at", F.col("at") + F.lit(low).cast("long")))
    ran = reduce(DataFrame.unionByName, turns)
    kind = F.get("kinds", F.col("j"))
    ran = ran.select("at", "cycle", kind["w"].alias("weight"), kind["m"].alias("m"))
    ran = ran.withColumn("k", F.row_number().over(Window.partitionBy("weight").orderBy("at")) - 1)
    ran = ran.select("at", "cycle", "weight", F.expr("k div m").alias("nth"), (F.col("k") % F.col("m")).alias("turn"))
    return ran.join(members, ["weight", "turn"]).select("idx", "nth", "at", "cycle")


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | DataFrame | None = None,
    source: str = "source",
    id_col: str = "doc_id",
    parts: int = PARTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The place of every row in the mixture.

    Returns ``id_col, source, block, in_block, release, deadline, slot,
    on_target``.  Ordering rows by ``slot, in_block`` gives the mixture.  Slots
    of sources that have run out stay unused; ``on_target`` is true before the
    first slot that a source could not fill, and up to there each source is less
    than one block away from its exact weight.  Sources of weight 0 follow after
    all others, without release and deadline.  No row is dropped or repeated.  A
    null source is a source of its own; rows with a null id come first in their
    source, and rows with equal ids are next to each other in any order.  Texts
    are not read.  Other columns of ``docs`` are ignored, whatever their names.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    keys = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.monotonically_increasing_id().alias("tie"))
    # Range partitions in id order; their bounds are sampled, so they are kept.  Many rows of one id are split by their tie.
    ranges = max(2, spark.sparkContext.defaultParallelism * 4)
    keys = cut(keys.repartitionByRange(ranges, "doc_id", F.xxhash64("source"), "tie").select("doc_id", "source", F.spark_partition_id().alias("part")))
    held = keys.groupBy("source", "part").agg(F.count("*").alias("n"))
    held = held.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n"))
    counts = held.groupBy("source").agg(F.sum("n").alias("rows"))
    shares = cut(target_weights(counts, weights, parts).withColumn("blocks", F.expr(f"(rows + {block_rows - 1}) div {block_rows}")))
    # No block that there is runs after its deadline, nor the first one that a source lacks; later slots of the cycle aren't needed.
    total = F.sum("weight").over(Window.partitionBy(F.lit(0))).cast("decimal(38,0)")
    ends = shares.filter("weight > 0").select(F.ceil((F.col("blocks") + 1) * total / F.col("weight")).alias("end"))
    wanted = ends.agg(F.max("end")).first()[0]
    plan = cut(schedule(shares, None if wanted is None else int(wanted)))

    # The first block that each source does not have (a part of one is not enough) bounds the mixture; its last block ends it.
    def slots_of(block: str) -> DataFrame:
        wanted = shares.filter("weight > 0").select("idx", "weight", F.expr(block).alias("b")).withColumn("nth", F.expr("b % weight"))
        return wanted.join(plan, ["idx", "nth"]).select((F.expr("b div weight") * F.col("cycle") + F.col("at")).alias("slot"))

    horizon = slots_of(f"rows div {block_rows}").agg(F.coalesce(F.min("slot"), F.lit(0))).first()[0]
    end = slots_of("blocks - 1").agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0]
    earlier = Window.partitionBy("weight").orderBy("idx")
    begins = shares.filter("weight = 0").select("idx", (F.sum("blocks").over(earlier) - F.col("blocks") + F.lit(end)).alias("begin"))
    shares = shares.join(begins, "idx", "left")

    within = F.row_number().over(Window.partitionBy("source", "part").orderBy(F.col("doc_id").asc_nulls_first())) - 1
    numbered = keys.withColumn("within", within)
    numbered = numbered.join(held.drop("n").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (numbered["part"] == held["part"]))
    numbered = numbered.select("doc_id", "source", (F.col("before") + F.col("within")).alias("nth_row"))
    numbered = numbered.join(shares.select(F.col("source").alias("s"), "idx", F.expr("nullif(weight, 0)").alias("weight"), "begin"), F.col("source").eqNullSafe(F.col("s")))
    numbered = numbered.withColumn("block", F.expr(f"nth_row div {block_rows}"))
    numbered = numbered.withColumn("nth", F.expr("block % weight"))
    placed = numbered.join(plan, ["idx", "nth"], "left")
    slot = F.coalesce(F.expr("block div weight * cycle + at"), F.expr("begin + block"))
    return placed.select(
        F.col("doc_id").alias(id_col),
        F.col("source").alias(source),
        "block",
        (F.col("nth_row") % block_rows).cast("int").alias("in_block"),
        F.expr("block * cycle div weight").alias("release"),
        F.expr("((block + 1) * cycle + weight - 1) div weight").alias("deadline"),
        slot.alias("slot"),
        (F.col("at").isNotNull() & (slot < F.lit(horizon))).alias("on_target"),
    )


def with_places(docs: DataFrame, place: str, source: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, and their place in the mixture as ``place``.

    Places are distinct, and in order they give the mixture; slots that stay
    unused leave gaps.  Rows that share id and source, or have no id, take that
    many places one after another, in any order; however many they are, they are
    numbered in parts.  Texts move once.
    """
    k, s, n, first, salt, nth = (fresh(docs, c) for c in ("plan_key", "plan_source", "plan_nth", "plan_first", "mix_salt", "mix_nth"))
    plan = mix(docs, None, source, id_col, block_rows=block_rows, **options)
    row, slot = (F.col(c) * block_rows + F.col("in_block") for c in ("block", "slot"))
    plan = cut(plan.select(F.col(id_col).alias(k), F.col(source).alias(s), row.alias(n), slot.alias(place)))
    same = F.col(id_col).eqNullSafe(F.col(k)) & F.col(source).eqNullSafe(F.col(s))
    several = plan.groupBy(k, s).agg(F.count("*").alias("n"), F.min(n).alias(first)).filter("n > 1")
    several = cut(several.select(k, s, first))
    if several.isEmpty():
        return docs.join(plan, same).select(*docs.columns, place)
    # Rows of one id and source have consecutive numbers in their source; so have their places.
    of, at = fresh(plan, "of"), fresh(plan, "at")
    those = several.withColumnsRenamed({k: of, s: at})
    planned = F.col(k).eqNullSafe(F.col(of)) & F.col(s).eqNullSafe(F.col(at))
    alone = docs.join(several, same, "left_anti").join(plan.join(those, planned, "left_anti"), same).select(*docs.columns, place)
    shared = cut(docs.join(several, same, "left_semi").withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(256))))
    parts = shared.groupBy(id_col, source, salt).agg(F.count("*").alias(nth))
    parts = parts.withColumn(nth, F.sum(nth).over(Window.partitionBy(id_col, source).orderBy(salt)) - F.col(nth))
    parts = cut(parts.withColumnsRenamed({id_col: k, source: s, salt: of, nth: first}))
    numbered = shared.withColumn(nth, F.row_number().over(Window.partitionBy(id_col, source, salt).orderBy(salt)))
    numbered = numbered.join(parts, same & (F.col(salt) == F.col(of))).withColumn(nth, F.col(nth) + F.col(first)).drop(k, s, of, first)
    places = plan.join(those, planned).select(k, s, (F.col(n) - F.col(first) + 1).alias(n), place)
    return alone.unionByName(numbered.join(places, same & (F.col(nth) == F.col(n))).select(*docs.columns, place))


def mixed(docs: DataFrame, source: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with their columns, in the order of the mixture.

    Partitions hold consecutive ranges of places and are sorted, so files written
    from the result and read one after another give the mixture.  No row is
    dropped or repeated, whatever its id, source or text; see :func:`mix`.
    """
    place = fresh(docs, "mix_place")
    return with_places(docs, place, source, id_col, **options).repartitionByRange(place).sortWithinPartitions(place).drop(place)
