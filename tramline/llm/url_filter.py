"""Verdicts on URLs: rules first, else a path-template tree.

Tree. Each host's paths are cut into segments, however many. A segment with a digit is a wildcard. The tree is built from the host down, level
by level, as deep as paths of different shapes share a node; what is left of a path that is alone below its node is wildcards, whose purities have a closed form. At each node, its children are wildcards too where they are many and few of them repeat; then
children whose share of blocked labels doesn't differ from their siblings' by a two-proportion test, or that have no labels, are merged into
the wildcard. What lies below merged children is merged with it, so a node is one template with labels of all its URLs.
Labels are the rules' own verdicts on the URLs they fit. A node's purity is the share of blocked labels below it, smoothed towards its
parent's, and so on up to the host's, which is smoothed towards the share of all labels. A template's purity is that of the URLs that end at
its node, smoothed towards the node's. From `reject` on, its URLs are blocked.

All of it is aggregation and equi-joins on templates, of which there are far fewer than URLs; the join back to the rows is the
only one that a hot host skews, and it is a plain join by host and path shape that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, pick

#: verdict, rule host and path as one string: the host and all its subdomains, paths that begin so.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A place with this many different values, on average met under REPEATS times, is a wildcard.
FANOUT, REPEATS = 20, 3.0
#: Weight of the parent in a node's purity; z of the two-proportion test; purity from which URLs are blocked.
PRIOR, Z, REJECT = 8.0, 1.96, 0.9


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL. Null or no `://`: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]))):
        on, slash, begin = rule.partition("/")
        fits = ((host == on) | F.endswith(host, F.lit(f".{on}"))) & F.startswith(path, F.lit(slash + begin))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """Segments of a path, `*` for those with a digit."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))


def alone(tree: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """tree without the shapes that end at this level or are the only ones to go on below their node, and these, with their last node and its purity.

    Below a node with one shape each child is without siblings and so a wildcard, and its purity moves towards the shape's own share by the same
    factor at each level."""
    tree = tree.withColumn("more", F.greatest(F.size("shape") - level, F.lit(0)))
    going = tree.where("more > 0").groupBy("host", "node").agg(F.count("*").alias("going"))
    tree = tree.join(going, ["host", "node"], "left")
    own = F.col("bad") / F.greatest("told", F.lit(1))
    purity = F.when(F.col("told") > 0, own + (F.col("purity") - own) * F.pow(PRIOR / (F.col("told") + PRIOR), F.col("more"))).otherwise(F.col("purity"))
    columns = ["host", "shape", "n", "bad", "told", "node", "purity"]
    done = tree.where("more = 0 or going = 1").withColumns({"purity": F.when(F.col("more") > 0, purity).otherwise(F.col("purity")), "node": F.concat("node", F.repeat(F.lit("/*"), F.col("more")))})
    return tree.where("more > 0 and going > 1").select(*columns), done.select(*columns)


def grown(tree: DataFrame, level: int) -> DataFrame:
    """tree(host, shape, n, bad, told, node, purity), whose shapes all go as deep, with the nodes of one more level."""
    deep = tree.withColumn("seg", F.get("shape", F.lit(level - 1)))
    values = deep.groupBy("host", "node", "seg").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("told").alias("told"), F.max("purity").alias("above"))
    wide = values.where(F.col("seg") != "*").groupBy("host", "node").agg(F.count("*").alias("values"), F.sum("n").alias("n"))
    wide = wide.where((F.col("values") >= FANOUT) & (F.col("n") < REPEATS * F.col("values"))).select("host", "node", F.lit(True).alias("wild"))
    values = values.join(wide, ["host", "node"], "left").withColumn("child", F.when(F.col("wild"), "*").otherwise(F.col("seg")))
    children = values.groupBy("host", "node", "child").agg(F.sum("bad").alias("b"), F.sum("told").alias("t"), F.max("above").alias("above"))
    every = children.groupBy("host", "node").agg(F.sum("b").alias("eb"), F.sum("t").alias("et"))
    children = children.join(every, ["host", "node"])
    one = lambda x: F.greatest(x, F.lit(1))
    b, t, others = F.col("b"), F.col("t"), F.col("et") - F.col("t")
    pooled = F.col("eb") / one(F.col("et"))
    gap = F.abs(b / one(t) - (F.col("eb") - b) / one(others))
    alike = (t == 0) | (others == 0) | (gap <= Z * F.sqrt(pooled * (1 - pooled) * (1 / one(t) + 1 / one(others))))
    children = children.withColumn("merged", F.when(alike, "*").otherwise(F.col("child")))
    nodes = children.groupBy("host", "node", "merged").agg(((F.sum("b") + PRIOR * F.max("above")) / (F.sum("t") + PRIOR)).alias("below"))
    to = values.select("host", "node", "seg", "child").join(children.select("host", "node", "child", "merged"), ["host", "node", "child"]).join(nodes, ["host", "node", "merged"])
    deep = deep.join(to.select("host", "node", "seg", "merged", "below"), ["host", "node", "seg"])
    return deep.select("host", "shape", "n", "bad", "told", F.concat("node", F.lit("/"), "merged").alias("node"), F.col("below").alias("purity"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, reject: float = REJECT) -> DataFrame:
    """One row per row of pages(page_id, url): page_id, host, path, rule, verdict, template, purity.

    A null url, or one without `://`, has an empty host and path and the template `/`; it is judged as any other. Repeated rows
    are rows of their own; other columns are ignored. Without any labels every URL that no rule fits is allowed. Of rules as
    long the one with the longer host wins, and of these the later one.
    """
    rows = pick(pages, "page_id", "url")
    host, path = parts(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said).withColumn("shape", shape_of(F.col("path")))
    shapes = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("said") == "block", 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("said").isNotNull(), 1).otherwise(0)).alias("told")
    )
    shapes = cut(shapes)
    hosts = shapes.groupBy("host").agg(F.sum("bad").alias("hb"), F.sum("told").alias("ht"))
    labels, blocked = shapes.agg(F.sum("told"), F.sum("bad")).first()
    base = (blocked or 0) / labels if labels else 0.0
    hosts = hosts.select("host", ((F.col("hb") + PRIOR * base) / (F.col("ht") + PRIOR)).alias("purity"))
    live, tree = alone(shapes.withColumn("node", F.lit("")).join(hosts, "host"), 0)
    level = 0
    while not live.isEmpty():
        level += 1
        grown_ = cut(grown(live, level))
        live, done = alone(grown_, level)
        tree = tree.unionByName(done)
    ends = tree.groupBy("host", "node").agg(((F.sum("bad") + PRIOR * F.max("purity")) / (F.sum("told") + PRIOR)).alias("end"))
    found = tree.select("host", "shape", "node").join(ends, ["host", "node"])
    found = found.select("host", "shape", F.when(F.col("node") == "", "/").otherwise(F.col("node")).alias("template"), F.round("end", 9).alias("purity"))
    verdict = F.coalesce("said", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return rows.join(found, ["host", "shape"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
