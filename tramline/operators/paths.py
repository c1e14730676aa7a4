"""What can be reached along directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoint import cut

C = F.col
#: Ways of 2, 4, 8 ... steps that are kept of a node, the least by hash; the edges themselves are all kept.
FAN = 8
#: Rounds along the edges alone, before ways are made.
PLAIN = 4


def reach(seeds: DataFrame, edges: DataFrame, by: str | None = None) -> DataFrame:
    """id: all that seeds(id) lead to along edges(src, dst), themselves included; within each value of `by`, if given.

    PLAIN rounds go along the edges; those to known nodes are dropped, so only the unknown part is left. In that, paths
    are doubled: a round takes ways of 2^k steps from all that was found there, and joins the ways with themselves for the next one, so a path of n
    edges takes some log n rounds. Of nodes with many ways only FAN are kept, so the ways stay as many as the nodes, times FAN. What these miss is found in rounds
    along the edges and then all ways, until nothing is new; so caps can't lose anything. What is known is kept in parts, of which none is written again."""
    return closure(seeds, edges, by)[0]


def closure(seeds: DataFrame, edges: DataFrame, by: str | None = None) -> tuple[DataFrame, int]:
    """reach(), and the number of rounds."""
    of = [by] if by else []
    # never broadcast: what is found may be small in many rounds, whose broadcasts would fill the driver
    nodes = lambda df, name: df.withColumnRenamed("id", name).hint("merge")

    def step(found: DataFrame, along: DataFrame) -> DataFrame:
        return along.join(nodes(found, "src"), [*of, "src"], "left_semi").select(*of, C("dst").alias("id")).distinct()

    def beyond(along: DataFrame, found: DataFrame) -> DataFrame:
        return cut(along.join(nodes(found, "dst"), [*of, "dst"], "left_anti").select(*of, "src", "dst"))

    known = fresh = cut(seeds.select(*of, "id").distinct())
    edges = beyond(cut(edges.select(*of, "src", "dst").where("src <> dst").distinct()), known)
    for rounds in range(1, PLAIN + 1):
        fresh = cut(step(known, edges))  # all new, as no edge that is left leads to a known node
        if fresh.isEmpty():
            return known, rounds
        known = known.unionByName(fresh)
        edges = beyond(edges, fresh)

    # from here on, nodes known before count no more: no edge that is left begins or ends there
    later = fresh
    ways, every, along = edges, edges, edges
    doubling = True
    while True:
        rounds += 1
        # once doubling ends, all is searched along the edges first: what no way has led to yet is next to it
        fresh = cut(step(later if doubling else fresh, ways if doubling else along).join(nodes(later, "id"), [*of, "id"], "left_anti"))
        if fresh.isEmpty():
            if not doubling:
                return known, rounds
            doubling, fresh = False, later
            continue
        known, later = known.unionByName(fresh), later.unionByName(fresh)
        if doubling:
            longer = ways.join(ways.select(*of, C("src").alias("dst"), C("dst").alias("far")), [*of, "dst"]).where("src <> far").select(*of, "src", C("far").alias("dst")).distinct()
            some = Window.partitionBy(*of, "src").orderBy(F.xxhash64("dst"))
            ways = cut(longer.withColumn("at", F.row_number().over(some)).where(C("at") <= FAN).drop("at"))
            every = every.unionByName(ways)
        else:
            along = every
