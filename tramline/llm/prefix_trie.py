"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root. Each turn splits the active classes by the role and text of that turn: a class at
depth d is a node, the conversations that begin with the same d turns. A class of one member is retired at once and its tail emitted as a
chain of nodes of one child each; so rounds go as deep as two conversations agree, and each reads the rows of its own turn alone, of a table
sorted by turn. Then sums are folded back, from the deepest classes to the root.

Turns are known by a digest and their length, so texts are moved once, to order the turns. Conversations are numbered by range, not by
conversation: one with a large part of all turns is dealt over many tasks. Members of a node are never gathered: the ids of those that
end there are joined in runs of RUN ids, and the runs hashed in order, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, on_workers, partitions, pick, written

#: Every conversation starts with the first turns of that of its hundred, up to SHARED - 1 of them.
HUNDRED, SHARED = 100, 6
#: Ids of a node, by value, that make one run of text.
RUN = 256
NONE = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame, folder: str) -> DataFrame:
    """conv_id, pos (from 1), turn_key, n_chars of turns(conv_id, turn, role, text)."""
    texts = turns.withColumn("row", F.monotonically_increasing_id())  # equal rows can be dealt apart
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("row")]
    dealt = texts.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    dealt = dealt.select("conv_id", key.alias("turn_key"), F.length("text").cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("at"))
    dealt = written(dealt, f"{folder}/dealt").withColumn("part", F.shiftright("at", 33))
    runs = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that a conversation is in
    runs = runs.select("conv_id", "part", (F.col("start") - F.coalesce(F.sum("n").over(before), F.lit(0)) - 1).alias("zero"))
    return dealt.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("zero")).alias("pos"), "turn_key", "n_chars")


def head_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuilt(own: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, pos, turn_key, n_chars, length) of the rebuilt conversations, sorted by turn, and conversations(conv_id, length)."""
    named = own.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("h", head_turns(F.col("conv_id")))
    first = own.where(F.col("pos") < SHARED).select("conv_id", F.struct("pos", "turn_key", "n_chars").alias("turn"))
    heads = first.where(F.col("conv_id") % HUNDRED == 0).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))  # SHARED - 1 at most
    base = named.withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED).join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    base = base.withColumn("head", F.when(F.col("turns").isNull() | (F.col("h") == 0), F.array().cast("array<struct<pos:bigint,turn_key:binary,n_chars:bigint>>")).otherwise(F.slice("turns", 1, F.greatest(F.col("h"), F.lit(1)).cast("int"))))
    lead = F.size("head").cast("long")
    base = base.select("conv_id", "h", "head", lead.alias("lead"), (lead + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    base = written(base, f"{folder}/conversations")
    tail = own.join(base.drop("head"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "turn_key", "n_chars", "length")
    lead_in = base.select("conv_id", F.explode("head").alias("turn"), "length").select("conv_id", "turn.pos", "turn.turn_key", "turn.n_chars", "length")
    turns = lead_in.unionByName(tail).repartitionByRange(partitions(own.sparkSession), "pos", "conv_id").sortWithinPartitions("pos")
    return written(turns, f"{folder}/turns"), base.select("conv_id", "length")


def refine(turns: DataFrame, convs: DataFrame, folder: str) -> int:
    """Split the classes turn by turn; the greatest depth of a class. Written by depth: nodes (class, parent, n_convs, n_chars, length), and the
    members of classes of two or more."""
    spark, depth = turns.sparkSession, 0
    found = convs.agg(F.min("conv_id").alias("class"), F.lit(None).cast("long").alias("parent"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("n_chars"), F.max("length").alias("length"))
    nodes = written(found.where("n_convs > 0"), f"{folder}/nodes/depth=0")
    if root := nodes.where("n_convs > 1").first():
        members = written(convs.withColumn("class", F.lit(root["class"])), f"{folder}/members/depth=0")
    while not nodes.where("n_convs > 1").isEmpty():
        depth += 1
        active = members.where(F.col("length") >= depth).select("conv_id", "class")
        now = active.join(turns.where(F.col("pos") == depth), "conv_id")
        split = now.groupBy("class", "turn_key").agg(F.min("conv_id").alias("child"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"), F.max("length").alias("length"))
        split = written(split, f"{folder}/split/depth={depth}")
        nodes = written(split.select(F.col("child").alias("class"), F.col("class").alias("parent"), "n_convs", "n_chars", "length"), f"{folder}/nodes/depth={depth}")
        shared = split.where("n_convs > 1").select("class", "turn_key", "child")
        members = written(now.join(shared, ["class", "turn_key"]).select("conv_id", "length", F.col("child").alias("class")), f"{folder}/members/depth={depth}")
    return depth


def fold(deepest: int, folder: str, spark) -> None:
    """Add up children, leaves and saved tokens from the deepest classes to the root; written by depth."""
    below = None
    for depth in range(deepest, -1, -1):
        nodes = spark.read.parquet(f"{folder}/nodes/depth={depth}")
        chain = nodes.where("n_convs = 1").select("class", "parent", "n_convs", (F.col("length") > depth).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        live = nodes.where("n_convs > 1")
        if below is None:  # no class of two members is as deep
            totals = chain
        else:
            sums = below.groupBy(F.col("parent").alias("class")).agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            zero = lambda c, d=0: F.coalesce(c, F.lit(d).cast("long"))
            live = live.join(sums, "class", "left").select(
                "class", "parent", "n_convs", zero("n").alias("n_children"), zero("leaves", 1).alias("n_leaves"),
                ((F.col("n_convs") - 1) * F.col("n_chars") + zero("saved")).alias("saved_tokens"),
            )
            totals = live.unionByName(chain)
        below = written(totals, f"{folder}/totals/depth={depth}")


def ends(members: DataFrame) -> DataFrame:
    """depth, class, ends_sha256 of the members(depth, class, conv_id) that end at a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, hashlib.sha256()

        def told(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["depth", "class", "ends_sha256"])

        for batch in batches:
            found = []
            for depth, of, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if at != (depth, of):
                    if at:
                        found.append((*at, state.hexdigest()))
                    at, state = (depth, of), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield told(found)
        if at:
            yield told([(*at, state.hexdigest())])

    runs = members.groupBy("depth", "class", F.floor(F.col("conv_id") / RUN).alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = runs.repartition(partitions(members.sparkSession), "depth", "class").sortWithinPartitions("depth", "class", "run")
    return on_workers(dealt, run, "depth long, class long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations(conv_id, turn, role, text): conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, and equal ones by role and text; a null role or text counts as empty; a row that is repeated is a turn
    each time. A conversation takes its first h turns from that of its hundred (h from its id's CRC-32; none if it is absent) and the rest from its own. Rows
    without conv_id belong to no conversation and are left out. Other columns are ignored; an empty table gives an empty result.
    """
    spark = conversations.sparkSession
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = pick(conversations, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", blank("role"), blank("text"))
    folder = new_folder(spark, "trie")
    turns, convs = rebuilt(numbered(rows, folder), folder)
    deepest = refine(turns, convs, folder)
    fold(deepest, folder, spark)

    schema = "class long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long, depth long"
    totals = spark.read.schema(schema).parquet(f"{folder}/totals")
    nodes = spark.read.schema("class long, parent long, n_convs long, n_chars long, length long, depth long").parquet(f"{folder}/nodes")
    live = totals.where("n_convs > 1")
    if deepest:
        members = spark.read.schema("conv_id long, length long, class long, depth long").parquet(f"{folder}/members")
        live = live.join(ends(members.where("length = depth").select("depth", "class", "conv_id")), ["depth", "class"], "left")
    else:
        live = live.withColumn("ends_sha256", F.lit(None).cast("string"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    live = live.select(F.col("class").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))

    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def unary(rows: DataFrame, depth: Column, parent: Column) -> DataFrame:
        more = F.col("length") > depth
        ended = F.when(more, F.lit(NONE)).otherwise(F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))
        return rows.select("conv_id", depth.alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), more.cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), ended.alias("ends_sha256"))

    retired = nodes.where("n_convs = 1").withColumnRenamed("class", "conv_id")
    heads = unary(retired, F.col("depth"), F.col("parent"))
    tails = turns.select("conv_id", "pos", "length").join(retired.select("conv_id", "depth"), "conv_id").where("pos > depth")
    chains = unary(tails.drop("depth"), F.col("pos"), F.col("conv_id"))
    return live.unionByName(heads).unionByName(chains).select(*columns)
