"""Orientation: unshielded colliders, conflicts, and propagation to a completed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, temporary
from .skeleton import symmetric


def unshielded_triples(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < c, both adjacent to b and not to each other."""
    adj = symmetric(edges)
    wings = adj.select(F.col("i").alias("b"), F.col("j").alias("a")).join(adj.select(F.col("i").alias("b"), F.col("j").alias("c")), "b").where("a < c")
    return wings.join(edges.select(F.col("i").alias("a"), F.col("j").alias("c")), ["a", "c"], "left_anti").select("a", "b", "c")


def colliders(edges: DataFrame, sepset: DataFrame) -> DataFrame:
    """Triples whose middle is not in the set that separated the ends."""
    return unshielded_triples(edges).join(sepset.select(F.col("i").alias("a"), F.col("j").alias("c"), "s"), ["a", "c"]).where("not array_contains(s, b)").select("a", "b", "c")


def collider_arrows(edges: DataFrame, sepset: DataFrame) -> DataFrame:
    """(src, dst) of every collider, both directions of an edge if two colliders say so."""
    c = colliders(edges, sepset)
    return c.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(c.select(F.col("c").alias("src"), F.col("b").alias("dst"))).distinct()


def reverse(arrows: DataFrame) -> DataFrame:
    return arrows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def bidirected_pairs(arrows: DataFrame) -> DataFrame:
    """(i, j) with arrows both ways."""
    return arrows.intersect(reverse(arrows)).where("src < dst").select(F.col("src").alias("i"), F.col("dst").alias("j"))


def conflict_free(arrows: DataFrame) -> DataFrame:
    return arrows.join(reverse(arrows), ["src", "dst"], "left_anti")


def undirected(edges: DataFrame, arrows: DataFrame) -> DataFrame:
    """(i, j), both orders, of edges without an arrow."""
    either = arrows.union(reverse(arrows)).select(F.col("src").alias("i"), F.col("dst").alias("j"))
    return symmetric(edges).join(either, ["i", "j"], "left_anti")


def free_lines(edges: DataFrame, arrows: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """(i, j), both orders, of edges that have no arrow and aren't frozen."""
    free = undirected(edges, arrows)
    return free if frozen is None else free.join(symmetric(frozen), ["i", "j"], "left_anti")


def meek(edges: DataFrame, arrows: DataFrame, rule: int, frozen: DataFrame | None = None) -> DataFrame:
    """(src, dst) that one step of a rule adds. frozen: (i, j) that conflicts keep undirected."""
    return follows(symmetric(edges), free_lines(edges, arrows, frozen), arrows, arrows, rule).distinct()


def follows(adj: DataFrame, free: DataFrame, arrows: DataFrame, new: DataFrame, rule: int) -> DataFrame:
    """(src, dst) that a rule gives with at least one of the arrows `new`, which are among arrows. adj and free: (i, j), both
    orders, of all lines and of those that may still be turned."""
    to = lambda df, s, d: df.select(F.col("src").alias(s), F.col("dst").alias(d))
    line = lambda s, d: free.select(F.col("i").alias(s), F.col("j").alias(d))
    near = lambda s, d: adj.select(F.col("i").alias(s), F.col("j").alias(d))
    if rule == 1:  # a -> b, b - c, a and c apart: b -> c
        out = to(new, "a", "b").join(line("b", "c"), "b").where("a <> c").join(near("a", "c"), ["a", "c"], "left_anti").select("b", "c")
    elif rule == 2:  # a -> b -> c, a - c: a -> c
        chain = lambda x, y: to(x, "a", "b").join(to(y, "b", "c"), "b").join(line("a", "c"), ["a", "c"]).select("a", "c")
        out = chain(new, arrows) if new is arrows else chain(new, arrows).union(chain(arrows, new))
    else:  # a - b, a - c, a - d, c -> b, d -> b, c and d apart: a -> b; of c -> b and d -> b one is new
        wing = lambda x, c: to(x, c, "b").join(line("a", c), c)
        both = wing(new, "c").join(wing(arrows, "d"), ["a", "b"]).where("c <> d").join(near("c", "d"), ["c", "d"], "left_anti")
        out = both.join(line("a", "b"), ["a", "b"], "left_semi").select("a", "b")
    return out.toDF("src", "dst")


def _all_rules(adj: DataFrame, free: DataFrame, arrows: DataFrame, new: DataFrame) -> DataFrame:
    one, two, three = (follows(adj, free, arrows, new, rule) for rule in (1, 2, 3))
    return one.union(two).union(three)


#: Rounds after which the arrows of all rounds are written as one table.
TOGETHER = 8


def propagate(edges: DataFrame, arrows: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """arrows and all that the three rules add to them, round by round, until nothing is added.

    A round joins the arrows of the last one with all; those that it would turn both ways are turned neither way, and are asked
    for again, by all arrows, as long as they are open. A round leaves the lines it turned and those still free in the
    shared folder, and two numbers.
    """
    with temporary(edges.sparkSession):
        adj, known = cut(symmetric(edges), "lines"), cut(arrows.select("src", "dst").distinct(), "arrows")
        free = cut(free_lines(edges, known, frozen), "free")
        new, torn, turn = known, None, 0
        while True:
            found = _all_rules(adj, free, known, new)
            if torn is not None:
                found = found.union(_all_rules(adj, free, known, known).join(torn, ["src", "dst"], "left_semi"))
            ways = found.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.bool_or(F.col("src") < F.col("dst")).alias("up"), F.bool_or(F.col("src") > F.col("dst")).alias("down"))
            ways = cut(ways, "found")
            once, twice = ways.agg(F.count_if(~(F.col("up") & F.col("down"))), F.count_if(F.col("up") & F.col("down"))).first()
            if not once:
                return cut(known.coalesce(1), "propagated", keep=True)
            single, both = ways.where("not (up and down)"), ways.where("up and down")
            new = single.selectExpr("if(up, a, b) as src", "if(up, b, a) as dst")
            torn = both.selectExpr("a as src", "b as dst").union(both.selectExpr("b", "a")) if twice else None
            gone = single.selectExpr("a as i", "b as j").union(single.selectExpr("b", "a"))
            free, known, turn = cut(free.join(gone, ["i", "j"], "left_anti"), "free"), known.union(new), turn + 1
            if turn % TOGETHER == 0:
                known = cut(known, "arrows")


def cpdag(edges: DataFrame, sepset: DataFrame) -> DataFrame:
    """Conflict-free collider arrows, propagated by the three rules. An edge that two colliders turn both ways stays undirected."""
    with temporary(edges.sparkSession):
        raw = cut(collider_arrows(edges, sepset), "colliders")
        return cut(propagate(edges, conflict_free(raw), bidirected_pairs(raw)), "cpdag", keep=True)
