"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame and SQL functions only.

Targets share a budget by weight and stop at `max_epochs` times a source's size, the excess being reshared. The budget
is cut into blocks of `block` words. Blocks go to the sources by highest quotients target / (2 seats + 1), and a source's
blocks to its shards likewise. In a shard, documents stand in seeded order, end to end, and the quota takes
the blocks of whole passes and then the first ones of a last pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick, positional, word_count

BLOCK_WORDS = 64
SHARD_DOCS = 2048
SEED = 20_240_601
#: Sources, and bytes of their names, that are sent to all tasks.
SMALL_ROWS, SMALL_BYTES = 50_000, 4_000_000


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """sources(source, source_size) with its rank by code point (null last) and its target.

    Water-filling in closed form: sources fill up in the order of cap / weight. With the caps of those before it taken
    off the budget, the first source that the level of the rest does not fill sets the level of all after it.
    There is a row per source here, so the windows over all of them, in one task, are as small as the list of sources.
    """
    everyone = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("rank", F.row_number().over(everyone) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", max_epochs * F.col("source_size").cast("double"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("fill", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole))
    return s.withColumn("target", F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fill") * F.col("weight"))))


def sainte_lague(units: DataFrame, votes: str, house: Column, group: list[str], order: list[str]) -> DataFrame:
    """units with `seats`: the `house` seats of each group dealt by highest quotients votes / (2 seats + 1).

    With divisor d = votes / (house - units / 2), rounding votes / d gives a fair house of at most `house` seats, and a fair
    house only grows with its size; so those seats are sure, and only the few left, about one for each unit, are dealt by
    comparing quotients. Ties go by `order`.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    u = units.withColumn("_house", house.cast("double")).withColumn("_v", F.col(votes).cast("double"))
    u = u.withColumn("_n", F.count("*").over(w)).withColumn("_total", F.sum("_v").over(w))
    quota = lambda seats: F.when(F.col("_total") > 0, F.col("_v") * seats / F.col("_total")).otherwise(F.lit(0.0))
    u = u.withColumn("_sure", F.greatest(F.lit(0.0), F.ceil(quota(F.col("_house") - F.col("_n") / 2) - 0.5)).cast("long"))
    u = u.withColumn("_most", F.greatest(F.col("_sure"), F.ceil(quota(F.col("_house") + F.col("_n") / 2) + 0.5).cast("long")))
    u = u.withColumn("_left", F.greatest(F.lit(0).cast("long"), F.round("_house").cast("long") - F.sum("_sure").over(w)))
    tries = u.where((F.col("_v") > 0) & (F.col("_left") > 0)).select(*group, *order, "_v", "_left", F.explode(F.sequence("_sure", "_most")).alias("_seat"))
    ranked = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    tries = tries.withColumn("_at", F.row_number().over(ranked.orderBy((F.col("_v") / (2 * F.col("_seat") + 1)).desc(), *order)))
    won = tries.where(F.col("_at") <= F.col("_left")).groupBy(*group, *order).agg(F.count("*").alias("_won"))
    keys = [*group, *order]
    won = won.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_won")
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = one if same is None else same & one
    out = u.join(won, same, "left")
    return out.withColumn("seats", F.col("_sure") + F.coalesce("_won", F.lit(0).cast("long"))).select(*units.columns, "seats")


def if_small(plan: DataFrame) -> DataFrame:
    """plan, to be broadcast where its rows and the bytes of their names are within bounds; else joined by name like any table."""
    rows, names = plan.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    return F.broadcast(plan) if rows <= SMALL_ROWS and names <= SMALL_BYTES else plan


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, source, size, source_size, target, taken.

    size is the words of the text (null: 0), target the source's, taken the words that the mix takes of the row, repeats
    counted, at most max_epochs * size. A null source is a source of its own. Repeated rows are rows of their own. Without
    any words all targets are 0. The choice depends on the rows and the seed alone, never on their order. The shards of a source, one
    for `shard_docs` documents, are dealt seats in one task: a million of them stand for 2 * 10^9 documents.
    """
    rows = pick(docs, "doc_id", "text", "source").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = cut(rows.withColumn("lot", F.xxhash64("doc_id", F.lit(seed))))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = targets(per_source, weights, share, max_epochs)
    whole = Window.partitionBy(F.lit(0))
    plan = plan.withColumn("budget", F.round(F.sum("target").over(whole) / block))
    plan = sainte_lague(plan, "target", F.col("budget"), [], ["rank"])
    plan = plan.select("source", "source_size", "target", F.col("seats").alias("source_seats"), F.ceil(F.col("docs") / shard_docs).cast("long").alias("shards"))
    plan = cut(plan)
    plan = if_small(plan)
    some = plan.select(F.col("source").alias("_s"), "shards")
    rows = rows.join(some, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("lot", F.lit(1)), F.col("shards"))).drop("shards")
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.join(plan.withColumnRenamed("source", "_s").drop("shards"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    shards = sainte_lague(shards, "shard_size", F.col("source_seats"), ["source"], ["shard"])
    shards = shards.select(F.col("source").alias("_s"), F.col("shard").alias("_d"), "shard_size", "source_size", "target", (F.col("seats") * block).alias("quota"))
    laid = Window.partitionBy("source", "shard").orderBy("lot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.sum("size").over(laid) - F.col("size"))
    out = rows.join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_d")), "left")
    quota = F.least("quota", max_epochs * F.col("shard_size"))
    passes = F.when(F.col("shard_size") > 0, F.expr("least(quota, %d * shard_size) div shard_size" % max_epochs)).otherwise(F.lit(0).cast("long"))
    rest = quota - passes * F.col("shard_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", rest - F.col("start")))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs repeated as the mix says: each row taken / size times, rounded half up, so a part of a text is none or all of it.

    A row without words is in no block and goes. Rows that share doc_id, source and size are told apart by a number, so each
    has one row of the mix. Columns of any name pass through."""
    key = ["id", "source", "size"]
    number = lambda *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    times = F.floor(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0) + 0.5).cast("int")
    marked = mix(docs, **options).select(F.col("doc_id").alias("id"), "source", "size", times.alias("times"))
    marked = marked.withColumn("at", number("times")).where("times > 0").toDF("mix_id", "mix_source", "mix_size", "times", "mix_at")
    own, names = positional(docs, "doc_id", "source", "text")
    rows = own.withColumns({"id": F.col(names["doc_id"]), "source": F.col(names["source"]), "size": word_count(F.col(names["text"]))})
    rows = rows.withColumn("at", number(names["text"]))
    same = F.col("id").eqNullSafe(F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("size") == F.col("mix_size")) & (F.col("at") == F.col("mix_at"))
    return rows.join(marked, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*own.columns).toDF(*docs.columns)
