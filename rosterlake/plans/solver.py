"""Exact roster optimisation as DataFrame operations.

For every key (slate, request, variant) at once: players of a position form a set, and sets with the same players are one,
whatever keys they come from, as are keys that ask the same of the same sets. Per set: drop players that enough others
dominate, and those that Lagrangian bounds rule out; form k-sets by self-joins; keep the frontier of salary against
points. Per problem: join the frontiers of the positions under the cap, dropping partial rosters that can't reach the
bounds' floor and keeping the frontier of the rest; take the best. Points are whole millionths, so sums are exact in any
order. Ties prefer less salary, then the smallest list of players in pool order: concatenation preserves that order,
so the smallest list of each (salary, points) is all that a frontier needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.locks import KEY
from ..schema import POSITIONS
from ..staging import staged
from .bounds import best_at, bounded, prices, reachable, worthwhile

SCALE = 1_000_000
PLAYER = ["idx", "salary", "points"]


def micro(points: Column) -> Column:
    return F.rint(points * SCALE).cast("long")


def dominance_prune(rows: DataFrame, most: DataFrame, keys: list[str]) -> DataFrame:
    """Drop a candidate if at least `mx` others of its keys cost no more and score no less (ties by idx).

    rows: keys, idx, salary, points; most: keys, mx. An exchange argument keeps the best roster, ties included."""
    a, b = rows.join(most, keys).where("mx > 0").alias("a"), rows.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    better = (F.col("b.salary") <= F.col("a.salary")) & (F.col("b.points") >= F.col("a.points"))
    strictly = (F.col("b.salary") < F.col("a.salary")) | (F.col("b.points") > F.col("a.points")) | (F.col("b.idx") < F.col("a.idx"))
    counted = a.join(b, same & better & strictly & (F.col("a.idx") != F.col("b.idx")), "left").groupBy(*[F.col(f"a.{c}") for c in [*keys, *PLAYER, "mx"]]).agg(F.count("b.idx").alias("over"))
    return counted.where("over < mx").drop("over")


def frontier(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of every key, the (salary, points, ids) that no other cheaper or equal one beats or equals. Other columns have to be
    the same all over a key."""
    rest = [c for c in rows.columns if c not in (*keys, "salary", "points", "ids")]
    best = rows.groupBy(*keys, "salary").agg(F.min(F.struct((-F.col("points")).alias("p"), "ids")).alias("best"), *[F.first(c).alias(c) for c in rest])
    best = best.select(*keys, *rest, "salary", (-F.col("best.p")).alias("points"), F.col("best.ids").alias("ids"))
    cheaper = Window.partitionBy(*keys).orderBy("salary").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_top", F.max("points").over(cheaper)).where("_top is null or points > _top").drop("_top")


def combinations(players: DataFrame, sizes: list[int], keys: list[str]) -> DataFrame:
    """keys, k, salary, points, ids: frontiers of the k-sets for every k in sizes. players: keys, mx, idx, salary, points."""
    sets = players.select(*keys, "mx", "salary", "points", F.array("idx").alias("ids"))
    parts = []
    for k in range(1, max([0, *sizes]) + 1):
        if k > 1:
            a, b = sets.alias("a"), players.alias("b")
            same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys])
            sets = a.join(b, same & (F.element_at("a.ids", -1) < F.col("b.idx")) & (F.col("a.mx") >= k)).select(*[F.col(f"a.{c}") for c in [*keys, "mx"]], (F.col("a.salary") + F.col("b.salary")).alias("salary"), (F.col("a.points") + F.col("b.points")).alias("points"), F.concat("a.ids", F.array("b.idx")).alias("ids"))
        if k in sizes:
            parts.append(sets.withColumn("k", F.lit(k)).drop("mx"))
    if not parts:
        return players.where(F.lit(False)).select(*keys, F.lit(0).alias("k"), "salary", "points", F.array("idx").alias("ids"))
    return frontier(reduce(DataFrame.unionByName, parts), [*keys, "k"])


NEEDS = [x for p in POSITIONS for x in (f"sig_{p.lower()}", f"n_{p.lower()}")]


def problems(rows: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(players of every distinct set, compositions of every distinct problem, the problem of every key).

    rows: KEY, position, idx, salary, points; comps: KEY, cap, comp, n_qb ... n_dst. A set is known by 128 hash bits of its
    players, a problem by those of its compositions and sets."""
    listed = F.array_sort(F.collect_list(F.struct(*PLAYER)))
    digest = lambda *c: F.concat(*[F.hex(F.xxhash64(F.lit(i), *c)) for i in (1, 2)])
    sets = staged(rows.groupBy(*KEY, "position").agg(listed.alias("players")).withColumn("sig", digest("position", "players")), "sets")
    players = sets.groupBy("sig").agg(F.first("players").alias("players")).select("sig", F.explode("players").alias("x")).select("sig", "x.*")
    of_key = sets.groupBy(*KEY).pivot("position", list(POSITIONS)).agg(F.first("sig"))
    of_key = of_key.select(*KEY, *[F.col(p).alias(f"sig_{p.lower()}") for p in POSITIONS])
    asked = comps.join(of_key, KEY, "left")
    # A position of which nothing is asked doesn't tell problems apart.
    used = [F.when(F.col(f"n_{p.lower()}") > 0, F.coalesce(f"sig_{p.lower()}", F.lit(""))).otherwise("").alias(f"sig_{p.lower()}") for p in POSITIONS]
    asked = asked.select(*KEY, "cap", "comp", *used, *[f"n_{p.lower()}" for p in POSITIONS])
    body = ["comp", "cap", *NEEDS]
    keyed = staged(asked.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*body))).alias("asked")).withColumn("problem", digest("asked")), "problems")
    distinct = keyed.groupBy("problem").agg(F.first("asked").alias("asked")).select("problem", F.explode("asked").alias("x")).select("problem", "x.*")
    return staged(players, "players"), staged(distinct, "compositions"), keyed.select(*KEY, "problem")


def most_of(comps: DataFrame) -> DataFrame:
    """sig, mx: the most players that any composition takes of a set."""
    each = F.explode(F.array(*[F.struct(F.col(f"sig_{p.lower()}").alias("sig"), F.col(f"n_{p.lower()}").alias("mx")) for p in POSITIONS]))
    return comps.select(each.alias("x")).select("x.*").where("mx > 0").groupBy("sig").agg(F.max("mx").alias("mx"))


def solve(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """KEY, salary, points, ids of the best filling of each key; keys without one are absent.

    rows: KEY, position, idx, salary (int), points (long) of the candidates that aren't locked. comps: KEY, cap, comp,
    n_qb ... n_dst. Only counts that occur in comps are formed."""
    players, needs, of_key = problems(rows, comps)
    players = staged(dominance_prune(players, most_of(needs), ["sig"]), "kept").drop("mx")
    best = best_at(players, most_of(needs), prices(players))
    needs = staged(bounded(needs, best, ["problem"]), "bounds")
    players = staged(worthwhile(players, needs).join(most_of(needs), "sig"), "worthwhile")
    counts = needs.agg(*[F.collect_set(f"n_{p.lower()}").alias(p) for p in POSITIONS]).first()  # a few numbers up to 9
    sizes = sorted({k for p in POSITIONS for k in counts[p] if k})
    sets = staged(combinations(players, sizes, ["sig"]), "frontiers")
    fixed = ["problem", "comp", "cap", "price", "floor", *[f"{c}_{p.lower()}" for p in POSITIONS for c in ("n", "value")]]
    state = needs.repartition("problem").select(*fixed, F.lit(0).alias("salary"), F.lit(0).cast("long").alias("points"), F.array().cast("array<int>").alias("ids"))
    for i, p in enumerate(POSITIONS):
        sig, n = f"sig_{p.lower()}", f"n_{p.lower()}"
        # Each problem's own copy of the frontiers it uses, parted like the state, which then stays where it is.
        own = needs.where(F.col(n) > 0).select("problem", F.col(sig).alias("sig"), F.col(n).alias("k")).distinct().join(sets, ["sig", "k"]).drop("sig")
        none = needs.where(F.col(n) == 0).select("problem", F.lit(0).alias("k"), F.lit(0).alias("salary"), F.lit(0).cast("long").alias("points"), F.array().cast("array<int>").alias("ids")).distinct()
        a, b = state.alias("a"), own.unionByName(none).repartition("problem").alias("b")
        salary, points = F.col("a.salary") + F.col("b.salary"), F.col("a.points") + F.col("b.points")
        # n = k as a difference: as a key it would have the state shuffled anew for every position.
        on = (F.col("a.problem") == F.col("b.problem")) & (F.col(f"a.{n}") - F.col("b.k") == 0) & (salary <= F.col("a.cap")) & reachable(points, salary, list(POSITIONS[i + 1 :]))
        joined = a.join(b, on).select(*[F.col(f"a.{c}") for c in fixed], salary.alias("salary"), points.alias("points"), F.concat("a.ids", "b.ids").alias("ids"))
        state = frontier(joined, ["problem", "comp"])
    pick = F.min(F.struct((-F.col("points")).alias("p"), F.col("salary"), F.array_sort("ids").alias("ids"))).alias("best")
    solved = state.groupBy("problem").agg(pick).select("problem", F.col("best.salary").alias("salary"), (-F.col("best.p")).alias("points"), F.col("best.ids").alias("ids"))
    return of_key.join(solved, "problem").drop("problem")
