"""Ordered automata over long sequences: sides of the street, tiny groups, spaced turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.operators.chains import ancestors
from umbra.shared import stash

#: Rows whose tables are composed in one step.
BLOCK = 256
#: Gain of comfort from which the side of the street is changed; length of groups that join a neighbour; angle and spacing of turns
#: that split a step (fixed values).
SIDE_GAIN, TINY_M, TURN_DEG, SPACING_M = 0.15, 8.0, 50.0, 15.0


def folded(rows: DataFrame, keys: list[str], position: str, table: str, start: int = 0) -> DataFrame:
    """``rows`` with ``before`` and ``after``: the state of an automaton before and after each row of its sequence.

    ``table`` is an array with the next state for each state from 0 on, ``position`` counts a sequence's rows from 0 without
    gaps. Tables of BLOCK rows are composed to one, those again, until one is left for each sequence; then states are handed down the same way. So no task
    needs more than BLOCK rows of a sequence, however long it is. A row without a table keeps the state.
    """
    levels = [stash(rows.select(*keys, F.col(position).alias("p"), F.col(table).alias("t")), "automaton")]
    while True:
        items = F.sort_array(F.collect_list(F.struct("p", "t")))
        grouped = levels[-1].groupBy(*keys, F.floor(F.col("p") / BLOCK).alias("p")).agg(items.alias("items"))
        known = F.filter("items", lambda i: i["t"].isNotNull())
        first = F.when(F.size(known) > 0, known[0]["t"])
        whole = F.aggregate(F.slice(known, 2, BLOCK), first, lambda done, i: F.transform(done, lambda s: F.get(i["t"], s)))
        levels.append(stash(grouped.select(*keys, "p", whole.alias("t"), "items"), "automaton"))
        if levels[-1].where("p > 0").isEmpty():
            break
    states = levels[-1].select(*keys, "p", F.lit(start).alias("before"))
    for level in reversed(levels[1:]):
        entered = level.join(states, [*keys, "p"]).select(*keys, "items", "before")
        step = lambda states, i: F.concat(states, F.array(F.coalesce(F.get(i["t"], F.element_at(states, -1)), F.element_at(states, -1))))
        run = F.aggregate("items", F.array("before"), step)
        opened = entered.select(*keys, F.posexplode(F.arrays_zip(F.transform("items", lambda i: i["p"]).alias("p"), F.slice(run, 1, F.size("items")).alias("before"), F.slice(run, 2, F.size("items")).alias("after"))))
        states = stash(opened.select(*keys, "col.p", "col.before", "col.after"), "automaton")
    return rows.join(states.withColumnRenamed("p", position), [*keys, position])


def chosen_sides(pieces: DataFrame, keys: list[str], position: str) -> DataFrame:
    """``pieces`` with side 'L', 'R' or null: where to walk on each piece of a route.

    ``pieces`` has left and right, the discomfort on either side (null: no walking there), and street, the name or number
    of its street. The less uncomfortable side is taken, the left one of equals; but on the street of the piece before, the side walked there is
    kept unless the other is better by more than SIDE_GAIN. A piece without sides ends a street; so does one whose street is null.
    """
    w = W.partitionBy(*keys).orderBy(position)
    goes_on = F.coalesce(F.lag("street").over(w) == F.col("street"), F.lit(False))
    left, right = F.col("left"), F.col("right")
    better = F.when(left.isNull() & right.isNull(), 0).when(right.isNull() | (left <= right), 1).otherwise(2)
    best = F.least(left, right)
    keep = lambda side, state: F.when(goes_on & side.isNotNull() & (side <= best + SIDE_GAIN), state).otherwise(better)
    whole = folded(pieces.withColumn("moves", F.array(better, keep(left, 1), keep(right, 2))), keys, position, "moves")
    return whole.withColumn("side", F.when(F.col("after") == 1, "L").when(F.col("after") == 2, "R")).drop("moves", "before", "after")


def absorbed(groups: DataFrame, keys: list[str], position: str) -> DataFrame:
    """keys, head, from_m, to_m, kind, name: groups of a route after tiny ones have joined their neighbours.

    ``groups`` has kind, name (with the side, if it matters), from_m and to_m. In a run of groups of kind 'walk' the first to reach
    TINY_M from the run's start heads a merged group that begins there, or the run's last if none does. Of
    the others, tiny ones and those named like the group before that is not tiny join it; the rest are heads of their own. Other
    kinds stay alone, and so does the only group of a route. ``head`` is the position of the group that gave its name.
    """
    w = W.partitionBy(*keys).orderBy(position)
    walks = F.col("kind") == "walk"
    runs = groups.withColumn("walks", walks).withColumn("change", ~walks | ~F.coalesce(F.lag("walks").over(w), F.lit(False)))
    runs = runs.withColumn("run", F.sum(F.col("change").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(*keys, "run").orderBy(position)
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    runs = runs.withColumns({"begun": F.first("from_m").over(whole), "last_of_run": F.last(position).over(whole)})
    reached = F.min(F.when(F.col("to_m") - F.col("begun") >= TINY_M, F.col(position))).over(whole)
    runs = runs.withColumn("first_head", F.coalesce(reached, F.col("last_of_run")))
    here, tiny = F.col(position), F.col("to_m") - F.col("from_m") < TINY_M
    counts = ~F.col("walks") | (here == F.col("first_head")) | ((here > F.col("first_head")) & ~tiny)
    # Of the groups that count, a head is one that is named unlike the one before.
    label = F.struct("name")
    before = F.last(F.when(counts, label), ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("heads", counts & (before.isNull() | ~before.eqNullSafe(label) | (here == F.col("first_head"))))
    own = F.last(F.when(F.col("heads"), here), ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, 0))
    runs = runs.withColumn("head", F.coalesce(own, F.col("first_head")))
    return runs.groupBy(*keys, "head").agg(
        F.min("from_m").alias("from_m"), F.max("to_m").alias("to_m"), F.max(F.when(here == F.col("head"), F.col("kind"))).alias("kind"), F.max(F.when(here == F.col("head"), F.col("name"))).alias("name")
    )


def spaced_cuts(turns: DataFrame, keys: list[str], position: str) -> DataFrame:
    """keys, position: points where a step of a route is split.

    ``turns`` has every point's at_m, its turn angle, and begin_m and end_m of its step. A point may split if its turn has TURN_DEG or more and it keeps SPACING_M
    from both ends. From the first such point on, the sharpest within less than SPACING_M ahead is taken (of equals the first), then the
    next candidate at least SPACING_M behind the taken one begins anew. What follows a candidate depends on it
    alone, so the chain from a step's first candidate is followed by pointer doubling.
    """
    sharp = F.abs("angle")
    near = turns.where((sharp >= TURN_DEG) & (F.col("at_m") - F.col("begin_m") >= SPACING_M) & (F.col("end_m") - F.col("at_m") >= SPACING_M))
    near = near.select(*keys, position, "at_m", "angle")
    by = W.partitionBy(*keys)
    # A frame's bounds are included, so its end is the next number below the spacing.
    ahead = F.expr(f"""max_by(struct({position} AS p, at_m), struct(abs(angle) AS a, -{position} AS q)) OVER (
        PARTITION BY {", ".join(keys)} ORDER BY at_m RANGE BETWEEN CURRENT ROW AND {SPACING_M - 1e-9}D FOLLOWING)""")
    found = stash(near.withColumn("best", ahead), "cuts")
    own = found.select(*keys, F.col("at_m").alias("m"), F.lit(0).alias("asks"), F.col(position).alias("p"))
    asks = found.select(*keys, (F.col("best.at_m") + SPACING_M).alias("m"), F.lit(-1).alias("asks"), F.col(position).alias("p"))
    # From the end on: a frame that reaches to the end is gone through again for every row.
    following = F.last(F.when(F.col("asks") == 0, F.col("p")), ignorenulls=True).over(by.orderBy(F.desc("m"), F.desc("asks"), F.desc("p")).rowsBetween(W.unboundedPreceding, -1))
    item = lambda c: F.struct(*keys, F.col(c).alias("p"))
    nexts = own.unionByName(asks).withColumn("then", following).where("asks < 0")
    links = nexts.select(item("p").alias("item"), F.when(F.col("then").isNotNull(), item("then")).alias("parent"))
    starts = found.groupBy(*keys).agg(F.min_by(position, "at_m").alias("p")).select(item("p").alias("item"))
    taken = ancestors(links, starts).select("item.*")
    return taken.join(found.select(*keys, F.col(position).alias("p"), F.col("best.p").alias(position)), [*keys, "p"]).select(*keys, position)
