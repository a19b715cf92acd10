"""Points met with the validity intervals that hold them, by equal dyadic nodes instead of a range condition.

Time is cut into steps that all interval bounds are multiples of. An interval is covered by dyadic nodes, stretches of 2**level steps that start at a
multiple of their length: at most two on each level. A point lies in one node of each level, so it shares just one node with each interval that
holds it and none with any other. The join is an equi-join on the keys and the node, and makes a row for each match only, however many intervals
a key has. A closed end is one node more, the instant itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.operators.joins import sized_join

#: Steps that are tried, in microseconds: a day, an hour, a minute, a second, a microsecond.
STEPS = [86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1]
INSTANT = -1


def _micros(at: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def _node(level: Column, index: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), index.cast("bigint").alias("node"))


def cover(begin: Column, end: Column, levels: int) -> Column:
    """The dyadic nodes (level, node) that make up the steps from ``begin`` up to before ``end``."""
    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        low, high = F.call_function("shiftright", begin + size - 1, k), F.call_function("shiftright", end, k)
        open_ = low < high
        return F.array(F.when(open_ & (low % 2 == 1), _node(k, low)), F.when(open_ & (high % 2 == 1), _node(k, high - 1)))
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda n: n.isNotNull())


def _step(bounds: DataFrame) -> tuple[int, int, int] | None:
    """The longest step that all bounds are multiples of, and the first and last bound; None without bounds."""
    fits = [F.bool_and((F.col("s") % step == 0) & (F.col("e").isNull() | (F.col("e") % step == 0))) for step in STEPS]
    row = bounds.agg(F.min("s").alias("low"), F.greatest(F.max("s"), F.max("e")).alias("high"), F.array(*fits).alias("fits")).first()
    return None if row.low is None else (next(step for step, ok in zip(STEPS, row.fits) if ok), row.low, row.high)


def interval_join(facts: DataFrame, row_id: str, keys: list[str], at: str, ranges: DataFrame, start: str, end: Column, closed: bool, **size) -> DataFrame:
    """Left join of facts with the ranges of their keys that hold the instant ``at``; ``row_id`` names a fact.

    From ``start`` up to before ``end``, or with ``closed`` up to it. A null end never comes, a null start is no range, a null instant
    or key meets nothing. The key columns of ``ranges`` are dropped. ``size`` goes to the join of facts and nodes, which
    broadcasts the nodes while a count shows that they are few, and salts heavy nodes otherwise.
    """
    timed = ranges.filter(F.col(start).isNotNull()).withColumn("__s", _micros(F.col(start))).withColumn("__e", _micros(end))
    found = _step(timed.select(F.col("__s").alias("s"), F.col("__e").alias("e")))
    values = [c for c in ranges.columns if c not in keys]
    if found is None:
        return facts.join(ranges.drop(*keys).limit(0), F.lit(False), "left")
    step, low, high = found
    levels = ((high - low) // step + 2).bit_length()
    last = F.lit(1 << levels).cast("bigint")  # behind every bound there is one step more, in which open ranges alone stand

    def steps(micros: Column) -> Column:
        past = micros - F.lit(low)
        return ((past - F.pmod(past, F.lit(step))) / F.lit(step)).cast("bigint")
    nodes = cover(steps(F.col("__s")), F.coalesce(steps(F.col("__e")), last), levels)
    if closed:
        nodes = F.concat(nodes, F.filter(F.array(F.when(F.col("__e") >= F.col("__s"), _node(F.lit(INSTANT), F.col("__e")))), lambda n: n.isNotNull()))
    held = timed.select(*keys, F.struct(*values).alias("__range"), F.inline(nodes))
    used = sorted(r[0] for r in held.select("level").distinct().collect())  # numbers of levels, a few dozen at most
    micros = _micros(F.col(at))
    step_of = F.least(steps(micros), last - 1)
    mine = [_node(F.lit(k), micros if k == INSTANT else F.shiftright(step_of, k)) for k in used]
    asked = facts.filter(micros >= low).select(F.col(row_id).alias("__row"), *keys, F.inline(F.array(*mine)))
    met = sized_join(asked, held, [*keys, "level", "node"], "inner", spread=F.xxhash64("__row"), **size)
    matches = met.select("__row", *[F.col("__range")[c].alias(c) for c in values])
    return facts.join(matches, facts[row_id] == F.col("__row"), "left").drop("__row")


def longest_list(ranges: DataFrame, keys: list[str]) -> int:
    """The number of ranges of the key that has most."""
    return ranges.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
