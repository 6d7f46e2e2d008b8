"""Lagrangian bounds: what a roster can reach at most if a price is put on salary in place of the cap.

At a price, the best filling of a composition takes each position's best players by points - price * salary, and
its value plus price * cap bounds every filling under the cap. A price whose best filling keeps to the cap gives a
roster, so its points are a floor for the optimum. Players, compositions and partial rosters whose bound is below the
floor are in no best roster. Points and prices are whole numbers, so bounds are exact and ties stay in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import POSITIONS

#: Prices in each octave, and octaves below the highest points per salary that a player has.
STEPS, OCTAVES = 2, 7


def prices(players: DataFrame) -> list[int]:
    """Prices common to all keys: 0, and a geometric grid up to the highest points per salary."""
    top = players.agg(F.max(F.ceil(F.col("points") / F.greatest(F.col("salary"), F.lit(1))))).first()[0] or 0
    return sorted({0, *(int(top * 2 ** (-i / STEPS)) for i in range(STEPS * OCTAVES))}) if top > 0 else [0]


def best_at(players: DataFrame, most: DataFrame, grid: list[int]) -> DataFrame:
    """sig, price, k, value, points, salary, edge: sums over the k best players of a set at a price, and the k-th's value.

    players: sig, idx, salary, points; most: sig, mx, the largest k that is asked of the set."""
    rows = players.join(most, "sig").withColumn("price", F.explode(F.array(*[F.lit(x).cast("long") for x in grid])))
    rows = rows.withColumn("edge", F.col("points") - F.col("price") * F.col("salary"))
    order = Window.partitionBy("sig", "price").orderBy(F.desc("edge"), "salary", "idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("k", F.row_number().over(order)).withColumns({n: F.sum(c).over(so_far) for n, c in (("value", "edge"), ("points", "points"), ("salary", "salary"))})
    return rows.where("k <= mx").select("sig", "price", "k", "value", "points", "salary", "edge")


def bounded(needs: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """The compositions that may hold an optimum: keys, comp, cap, price, bound, floor, and of each position sig_p, n_p,
    value_p (of its n_p best at the price) and edge_p (of the last of them).

    needs: keys, comp, cap, sig_p, n_p. A composition for which some position has too few players goes."""
    each = [F.struct(F.lit(p.lower()).alias("position"), F.col(f"sig_{p.lower()}").alias("sig"), F.col(f"n_{p.lower()}").alias("k")) for p in POSITIONS]
    asked = needs.select(*keys, "comp", "cap", F.explode(F.array(*each)).alias("x")).select(*keys, "comp", "cap", "x.*").where("k > 0")
    count = F.sum(F.when(F.col("k") > 0, 1).otherwise(0))
    wanted = needs.select(*keys, "comp", sum((F.when(F.col(f"n_{p.lower()}") > 0, 1).otherwise(0) for p in POSITIONS), F.lit(0)).alias("wanted"))
    parts = F.map_from_entries(F.collect_list(F.struct("position", F.struct("value", "edge"))))
    at_price = asked.join(best, ["sig", "k"]).groupBy(*keys, "comp", "cap", "price").agg(count.alias("n"), F.sum("value").alias("value"), F.sum("points").alias("points"), F.sum("salary").alias("salary"), parts.alias("parts"))
    at_price = at_price.join(wanted, [*keys, "comp"]).where("n = wanted").withColumn("bound", F.col("value") + F.col("price") * F.col("cap"))
    floor = F.max(F.when(F.col("salary") <= F.col("cap"), F.col("points")))
    comps = at_price.groupBy(*keys, "comp", "cap").agg(F.min_by(F.struct("price", "bound", "parts"), F.struct("bound", "price")).alias("at"), floor.alias("own_floor"))
    comps = comps.withColumn("floor", F.max("own_floor").over(Window.partitionBy(*keys)))
    comps = comps.select(*keys, "comp", "at.price", "at.bound", "at.parts", "floor").where("floor is null or bound >= floor")
    out = needs.join(comps, [*keys, "comp"])
    nothing = needs.where(" + ".join(f"n_{p.lower()}" for p in POSITIONS) + " = 0")  # all places are locked: nothing to bound
    out = out.unionByName(nothing.select("*", F.lit(0).cast("long").alias("price"), F.lit(0).cast("long").alias("bound"), F.lit(None).cast("long").alias("floor")), allowMissingColumns=True)
    own = [(p.lower(), F.try_element_at("parts", F.lit(p.lower()))) for p in POSITIONS]
    return out.select(*needs.columns, "price", "bound", "floor", *[F.coalesce(x["value"], F.lit(0).cast("long")).alias(f"value_{p}") for p, x in own], *[x["edge"].alias(f"edge_{p}") for p, x in own])


def worthwhile(players: DataFrame, comps: DataFrame) -> DataFrame:
    """The players of each set that a best roster of some composition may have.

    Forced in, a player takes the place of the last of the best, so the bound falls by how much that one is worth more."""
    each = [F.struct(*[F.col(f"{c}_{p.lower()}").alias(c) for c in ("sig", "n", "edge")]) for p in POSITIONS]
    uses = comps.select("price", "bound", "floor", F.explode(F.array(*each)).alias("x")).select("price", "bound", "floor", "x.*").where("n > 0")
    # Many requests share a set: what they allow is the least that some of them asks, per price.
    allowed = uses.groupBy("sig", "price").agg(F.min(F.when(F.col("floor").isNull(), F.lit(None)).otherwise(F.col("floor") - F.col("bound") + F.col("edge"))).alias("least"), F.max(F.col("floor").isNull()).alias("all"))
    value = F.col("points") - F.col("price") * F.col("salary")
    return players.join(allowed, "sig").where(F.col("all") | (value >= F.col("least"))).select(*players.columns).distinct()


def reachable(points: Column, salary: Column, after: list[str]) -> Column:
    """Whether a partial roster can still reach the floor with the best of the positions that follow."""
    rest = sum((F.col(f"a.value_{p.lower()}") for p in after), F.lit(0).cast("long"))
    return F.col("a.floor").isNull() | (points + F.col("a.price") * (F.col("a.cap") - salary) + rest >= F.col("a.floor"))
