"""One ranking from several scores on unlike scales: the stationary order of a walk over their rankings.

From an item the walk picks one of the scores at random and jumps to an item strictly higher in it, all alike likely (it
stays where none is higher); with probability 1 - damping it jumps to any item of the group. Only ranks enter, so no
score prevails by its range. The power iteration needs no links: in the order of a score, what an item receives is the
sum of mass / number-above over all items strictly below, a suffix sum.

Groups of up to `group_rows` rows are iterated in numpy, many groups at once; the mass of larger groups lies in
DataFrames, summed by tie level and by blocks of levels, so that no task holds a whole group; rows of a level with more
than `LEVEL_ROWS` rows are spread over tasks. Both give the same result.

An item that leads all scores but one has a provable least mass. With damping d, n items and s scores it keeps
d (s - 1) / s of its own mass, gets (1 - d) / n by the free jumps, and d / s of mass / number-above from each item below
the top of a score that it leads, whose own mass is (1 - d) / n at least. `leaders` takes the items with that mass as
candidates, so that none is lost, and settles them by their exact ranks.

Defined results: null and NaN lie below every number; tied items share their ranks and stationarity, the order among
them is that of the item key; a single item has stationarity 1; rows repeated for one (group, item) count once, with the
largest of each score; rows with a null group or item are kept as a group or item of their own; other columns are
ignored; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import exists, materialize

DAMPING, TOLERANCE, MOST_STEPS = 0.85, 1e-9, 150
#: Rows of a group that one task may hold; larger groups are iterated over DataFrames.
GROUP_ROWS = 500_000
#: Rows of a tie level that may meet in one task; levels with more are few (rows / LEVEL_ROWS) and sent to every task up to BROADCAST_LEVELS.
LEVEL_ROWS, BROADCAST_LEVELS, SALTS = 100_000, 100_000, 256
#: By how much an iterated mass may lie below the exact one.
SLACK = 1e-8


class Order:
    """The descending order of one score in all groups of a batch, its tie ends and the numbers above."""

    def __init__(self, group: np.ndarray, score: np.ndarray):
        n = len(score)
        value = np.where(np.isnan(score), -np.inf, score)
        missing = np.isnan(score)
        self.order = np.lexsort((missing, -value, group))
        g, v, x = group[self.order], value[self.order], missing[self.order]
        new_group = np.append(True, g[1:] != g[:-1])
        new_level = new_group | np.append(True, (v[1:] != v[:-1]) | (x[1:] != x[:-1]))
        at = np.arange(n)
        begin = np.maximum.accumulate(np.where(new_group, at, 0))
        level = np.maximum.accumulate(np.where(new_level, at, 0))
        self.above = level - begin
        edges = np.append(np.flatnonzero(new_level), n)
        self.level_end = np.repeat(edges[1:], np.diff(edges))
        edges = np.append(np.flatnonzero(new_group), n)
        self.group_end = np.repeat(edges[1:], np.diff(edges))
        self.top = self.above == 0
        #: Of each group the sum of 1 / number above over the items below the top level.
        self.inflow = np.bincount(g, np.where(self.top, 0.0, 1.0 / np.maximum(self.above, 1)))

    def received(self, mass: np.ndarray) -> np.ndarray:
        own = mass[self.order]
        sums = np.append(0.0, np.cumsum(np.where(self.top, 0.0, own / np.maximum(self.above, 1))))
        out = np.empty_like(mass)
        out[self.order] = sums[self.group_end] - sums[self.level_end] + np.where(self.top, own, 0.0)
        return out

    def above_of(self) -> np.ndarray:
        out = np.empty(len(self.order), np.int64)
        out[self.order] = self.above
        return out


def leader_mass(size, inflows: list, damping: float, least=np.minimum.reduce):
    """Least mass of an item that leads all scores but one; inflows has of each score the sum of 1 / number above."""
    s = len(inflows)
    held = damping * (s - 1) / s
    others = least([sum(x for k, x in enumerate(inflows) if k != left) + 0.0 * inflows[left] for left in range(s)])
    return (1 - damping) / size * (1 + damping / s * others) / (1 - held)


def stationarity(group: np.ndarray, scores: list[np.ndarray], damping: float = DAMPING) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Stationary mass of every row, the least mass of its group's leaders, and its numbers above; rows of a group lie together, group ascends."""
    size = np.bincount(group)[group].astype(float)
    orders = [Order(group, s) for s in scores]
    mass = 1.0 / size
    for _ in range(MOST_STEPS):
        new = (1.0 - damping) / size + damping / len(orders) * sum(o.received(mass) for o in orders)
        moved = np.bincount(group, np.abs(new - mass)).max()
        mass = new
        if moved < TOLERANCE:
            break
    return mass, leader_mass(size, [o.inflow[group] for o in orders], damping), [o.above_of() for o in orders]


def _walk(table: pa.Table, number: np.ndarray, n_scores: int, damping: float) -> pa.RecordBatch:
    scores = [table.column(2 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(n_scores)]
    mass, least, above = stationarity(number, scores, damping)
    columns = [table.column(0), table.column(1), pa.array(mass), pa.array(least), *[pa.array(a, pa.int64()) for a in above]]
    return pa.Table.from_arrays(columns, ["g", "item", "stationarity", "leader_mass", *[f"above_{k}" for k in range(n_scores)]]).combine_chunks().to_batches()


def _batches(batches: Iterator[pa.RecordBatch], n_scores: int, damping: float, least: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Whole groups from batches ordered by group; the last, perhaps unfinished group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def number(table: pa.Table) -> np.ndarray:
        code = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        return np.cumsum(np.append(0, code[1:] != code[:-1])) if len(code) else code

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held)
            groups = number(table)
            whole = int(np.searchsorted(groups, groups[-1]))
            if whole:
                yield from _walk(table.slice(0, whole), groups[:whole], n_scores, damping)
            held, rows = table.slice(whole).to_batches(), table.num_rows - whole
    if rows:
        table = pa.Table.from_batches(held)
        yield from _walk(table, number(table), n_scores, damping)


def _large(items: DataFrame, n_scores: int, damping: float, steps: int, level_rows: int) -> DataFrame:
    """The same walk for groups of any size: mass by tie level, suffix sums by blocks of levels."""
    ks = range(n_scores)
    long = items.select("g", "item", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("v")) for k in ks])).alias("e"))
    long = long.select("g", "item", "e.k", "e.v")
    levels = long.groupBy("g", "k", "v").agg(F.count("*").alias("n"))
    # numbers above by two-step counting: levels are dealt to ordered range blocks, blocks are added up, then levels within a block
    levels = levels.repartitionByRange("g", "k", F.col("v").desc_nulls_last()).withColumn("b", F.spark_partition_id())
    levels = materialize(levels, "levels")
    blocks = levels.groupBy("g", "k", "b").agg(F.sum("n").alias("bn"))
    before = F.coalesce(F.sum("bn").over(W.partitionBy("g", "k").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("g").alias("bg"), F.col("k").alias("bk"), F.col("b").alias("bb"), before.alias("base"))
    inside = W.partitionBy("g", "k", "b").orderBy(F.col("v").desc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    ranked = levels.join(blocks, F.expr("g <=> bg AND k = bk AND b = bb"))
    ranked = ranked.select("g", "k", "v", "b", "n", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("above"))
    ranked = materialize(ranked, "ranked")
    sent = lambda df: F.broadcast(df) if df.count() <= BROADCAST_LEVELS else df
    big = ranked.filter(F.col("n") > level_rows).select(F.col("g").alias("bg"), F.col("k").alias("bk"), F.col("v").alias("bv"), F.col("above").alias("big"))
    seen = long.join(sent(big), F.expr("g <=> bg AND k = bk AND v <=> bv"), "left")
    # the rows of a big level have their place already; in the join they get salts that no level has
    salt = F.when(F.col("big").isNotNull(), 1 + F.pmod(F.xxhash64("item"), F.lit(SALTS))).otherwise(F.lit(0))
    seen = seen.withColumn("salt", salt.cast("bigint"))
    small = ranked.filter(F.col("n") <= level_rows).select(F.col("g").alias("rg"), F.col("k").alias("rk"), F.col("v").alias("rv"), F.col("above").alias("own"), F.lit(0).cast("bigint").alias("rs"))
    seen = seen.join(small, F.expr("g <=> rg AND k = rk AND v <=> rv AND salt = rs"), "left").select("g", "item", "k", F.coalesce("big", "own").alias("above"), F.col("big").isNotNull().alias("heavy"))
    wide = seen.groupBy("g", "item").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for k in ks for c in ("above", "heavy")])
    inflow = ranked.groupBy("g").agg(F.max(F.lit(1)).alias("one"), *[F.sum(F.when((F.col("k") == k) & (F.col("above") > 0), F.col("n") / F.col("above")).otherwise(0.0)).alias(f"i{k}") for k in ks])
    sizes = items.groupBy("g").agg(F.count("*").alias("size"))
    sizes = sizes.alias("z").join(inflow.alias("i"), F.expr("z.g <=> i.g")).select("z.g", "size", leader_mass(F.col("size"), [F.col(f"i{k}") for k in ks], damping, lambda x: F.least(*x) if len(x) > 1 else x[0]).alias("leader_mass"))
    # large groups are few: each has more than group_rows rows
    wide = wide.alias("w").join(sent(sizes).alias("z"), F.expr("w.g <=> z.g")).select("w.*", "size", "leader_mass").withColumn("mass", 1 / F.col("size"))
    state = materialize(wide, "walk")
    places = ranked.select("g", "k", "b", "above", (F.col("n") > level_rows).alias("large"))
    for step in range(steps):
        mass = state.select("g", "mass", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"above_{k}").alias("above")) for k in ks])).alias("e"))
        sums = mass.select("g", "e.k", "e.above", "mass").groupBy("g", "k", "above").agg((F.sum("mass") / F.greatest(F.col("above"), F.lit(1))).alias("c"))
        sums = sums.alias("m").join(places.alias("p"), F.expr("m.g <=> p.g AND m.k = p.k AND m.above = p.above")).select("p.*", F.when(F.col("p.above") > 0, F.col("c")).otherwise(F.lit(0.0)).alias("c"))
        below = F.coalesce(F.sum("bc").over(W.partitionBy("g", "k").orderBy(F.col("b").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        totals = sums.groupBy("g", "k", "b").agg(F.sum("c").alias("bc")).select(F.col("g").alias("tg"), F.col("k").alias("tk"), F.col("b").alias("tb"), below.alias("base"))
        rest = F.coalesce(F.sum("c").over(W.partitionBy("g", "k", "b").orderBy(F.col("above").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        got = materialize(sums.join(totals, F.expr("g <=> tg AND k = tk AND b = tb")).select("g", "k", "above", "large", (F.col("base") + rest).alias("received")), f"received{step}")
        new = state
        for k in ks:
            part = got.filter(F.col("k") == k).select(F.col("g").alias("pg"), F.col("above").alias("pa"), F.col("received").alias("r"), "large")
            whole = sent(part.filter("large").select("pg", "pa", F.col("r").alias("rb")))
            own = part.filter("NOT large").select(F.col("pg").alias("qg"), F.col("pa").alias("qa"), F.col("r").alias("ro"), F.lit(0).cast("bigint").alias("qs"))
            salt = F.when(F.col(f"heavy_{k}"), 1 + F.pmod(F.xxhash64("item"), F.lit(SALTS))).otherwise(F.lit(0)).cast("bigint")
            new = new.join(whole, F.col("g").eqNullSafe(F.col("pg")) & (F.col(f"above_{k}") == F.col("pa")), "left").withColumn("salt", salt)
            new = new.join(own, F.col("g").eqNullSafe(F.col("qg")) & (F.col(f"above_{k}") == F.col("qa")) & (F.col("salt") == F.col("qs")), "left")
            new = new.withColumn(f"r{k}", F.coalesce("rb", "ro")).drop("pg", "pa", "rb", "qg", "qa", "ro", "qs", "salt")
        flow = sum((F.col(f"r{k}") + F.when(F.col(f"above_{k}") == 0, F.col("mass")).otherwise(0.0) for k in ks), F.lit(0.0))
        new = new.select("g", "item", *[f"{c}_{k}" for k in ks for c in ("above", "heavy")], "size", "leader_mass", ((1 - damping) / F.col("size") + damping / n_scores * flow).alias("mass"), F.col("mass").alias("old"))
        new = materialize(new, f"walk{step}")
        moved = new.groupBy("g").agg(F.sum(F.abs(F.col("mass") - F.col("old"))).alias("d")).agg(F.max("d")).first()[0]
        state = new.drop("old")
        if moved is None or moved < TOLERANCE:
            break
    return state.select("g", "item", F.col("mass").alias("stationarity"), "leader_mass", *[f"above_{k}" for k in ks])


def rank_walk(df: DataFrame, group: str, item: str, scores: list[str], damping: float = DAMPING, group_rows: int = GROUP_ROWS, steps: int = MOST_STEPS, level_rows: int = LEVEL_ROWS) -> DataFrame:
    """(group, item, stationarity, leader_mass, above_<score>...): the number of items of the group strictly above by each score."""
    clean = [F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))).alias(f"s{k}") for k, s in enumerate(scores)]
    items = df.groupBy(F.col(group).alias("g"), F.col(item).alias("item")).agg(*clean)
    n = len(scores)
    sizes = df.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n")).filter(F.col("n") > group_rows).select("g")
    kinds = f"g {df.schema[group].dataType.simpleString()}, item {df.schema[item].dataType.simpleString()}"
    schema = f"{kinds}, stationarity double, leader_mass double, " + ", ".join(f"above_{k} bigint" for k in range(n))

    def small(part: DataFrame) -> DataFrame:
        return part.repartition("g").sortWithinPartitions("g").mapInArrow(lambda it: _batches(it, n, damping), schema)

    if exists(sizes):
        large = materialize(sizes, "large").withColumnRenamed("g", "lg")
        held = F.col("g").eqNullSafe(F.col("lg"))
        out = small(items.join(large, held, "left_anti")).unionByName(_large(materialize(items.join(large, held, "left_semi"), "hot"), n, damping, steps, level_rows))
    else:
        out = small(items)
    return out.select(F.col("g").alias(group), F.col("item").alias(item), "stationarity", "leader_mass", *[F.col(f"above_{k}").alias(f"above_{s}") for k, s in enumerate(scores)])


def leaders(walked: DataFrame, scores: list[str]) -> DataFrame:
    """The items that lead all scores but one at least and are at most second in the other: those with a leader's mass, then by their ranks."""
    above = [F.col(f"above_{s}") for s in scores]
    leads = sum((F.when(a == 0, 1).otherwise(0) for a in above), F.lit(0))
    candidates = walked.filter(F.col("stationarity") >= F.col("leader_mass") - SLACK)
    return candidates.filter((leads >= len(scores) - 1) & (F.greatest(*above) <= 1))


def ranking(walked: DataFrame, group: str, item: str, most: int | None = None) -> DataFrame:
    """Adds `place`, 1 for the best of its group; masses that differ by rounding only count as tied."""
    place = F.row_number().over(W.partitionBy(group).orderBy(F.round("stationarity", 12).desc(), F.col(item)))
    out = walked.withColumn("place", place)
    return out if most is None else out.filter(F.col("place") <= most)
