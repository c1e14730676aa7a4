"""Running the rules: gating, isolation, batches of plans, and what each rule took."""

from __future__ import annotations

import concurrent.futures
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..feed import NOTICE, Feed, RunOptions
from ..functions.checkpoint import cut
from ..operators import Rule, all_rules

#: Rules whose plans are run as one union; a union of all hundred takes longer to plan than to run.
BATCH = 12
#: Rules that run side by side where each is measured.
AT_ONCE = 6
#: Tables that many rules read; kept in memory, or on disk where that is short.
SHARED = ("stops", "trips", "stop_times", "shapes", "routes")


def broken(feed: Feed, rule: str, error: Exception) -> DataFrame:
    return feed.spark.createDataFrame([("runtime_exception_in_validator_error", "ERROR", None, None, None, {"validator": rule, "exception": type(error).__name__, "message": str(error)[:500]})], NOTICE)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def run_rule(feed: Feed, rule: Rule, options: RunOptions) -> DataFrame:
    """Notices of one rule, as a plan that has not run."""
    found = rule.notices(feed, options)
    return (union(found) if found else feed.no_notices()).withColumn("rule", F.lit(rule.name))


def run_rules(feed: Feed, options: RunOptions, names: list[str] | None = None) -> DataFrame:
    """Notices of all rules that apply, with the feed's own. A failing rule gives a notice and stops no other.

    Duplicates stay. Each batch is written to the shared folder; a batch that fails is run again rule by rule.
    """
    rules = [r for n, r in all_rules().items() if names is None or n in names]
    kept = [feed.tables[t].persist() for t in SHARED if feed.has(t)]
    out = [] if feed.notices is None else [feed.notices.withColumn("rule", F.lit("loader"))]
    pending: list[tuple[Rule, DataFrame]] = []
    parts = int(feed.spark.conf.get("spark.sql.shuffle.partitions"))  # a union has the partitions of all its plans

    def flush() -> None:
        if not pending:
            return
        try:
            out.append(cut(union([p for _, p in pending]).coalesce(parts)))
        except Exception:
            for r, p in pending:
                try:
                    out.append(cut(p.coalesce(parts)))
                except Exception as error:
                    out.append(broken(feed, r.name, error).withColumn("rule", F.lit(r.name)))
        pending.clear()

    for r in rules:
        try:
            found = r.notices(feed, options)
        except Exception as error:
            out.append(broken(feed, r.name, error).withColumn("rule", F.lit(r.name)))
            continue
        if found:
            pending.append((r, union(found).withColumn("rule", F.lit(r.name))))
        if len(pending) >= BATCH:
            flush()
    flush()
    for df in kept:
        df.unpersist()
    return union(out) if out else feed.no_notices().withColumn("rule", F.lit(None).cast("string"))


def run_measured(feed: Feed, options: RunOptions, timings: dict[str, float], at_once: int = AT_ONCE) -> DataFrame:
    """run_rules() with the seconds of each rule put into timings: rules run side by side, each as a job group of its own, and Spark's status store
    tells how long the tasks of its jobs ran, and what they spilled."""
    spark, run = feed.spark, uuid.uuid4().hex
    context = spark.sparkContext
    alone = Feed(spark, feed.tables, feed.headers, feed.broken, None, feed.files, feed.geojson_fatal)
    alone.geojson_notices = getattr(feed, "geojson_notices", None)
    kept = [feed.tables[t].persist() for t in SHARED if feed.has(t)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def one(rule: Rule) -> DataFrame | None:
        context.setJobGroup(f"{run}-{rule.name}", rule.name)
        try:
            found = rule.notices(alone, options)
            return cut(union(found).withColumn("rule", F.lit(rule.name)).coalesce(parts)) if found else None
        except Exception as error:
            return broken(feed, rule.name, error).withColumn("rule", F.lit(rule.name))
        finally:
            timings[f"rule {rule.name}"] = task_seconds(spark, f"{run}-{rule.name}")
            context.setLocalProperty("spark.jobGroup.id", None)

    with concurrent.futures.ThreadPoolExecutor(at_once) as pool:
        found = list(pool.map(one, all_rules().values()))
    for df in kept:
        df.unpersist()
    loader = [] if feed.notices is None else [feed.notices.withColumn("rule", F.lit("loader"))]
    return union([*loader, *(f for f in found if f is not None)] or [feed.no_notices().withColumn("rule", F.lit(None).cast("string"))])


def task_seconds(spark: SparkSession, group: str) -> float:
    """Seconds that the tasks of a job group's jobs ran, each stage once, by the status store; a stage that it no longer has
    (it keeps spark.ui.retainedStages) counts nothing."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    store, stages = context._jsc.sc().statusStore(), set()
    for job in context.statusTracker().getJobIdsForGroup(group):
        ids = store.job(job).stageIds()
        stages |= {ids.apply(k) for k in range(ids.size())}

    def took(stage: int) -> int:
        try:
            return store.lastStageAttempt(stage).executorRunTime()
        except Py4JJavaError as error:  # asking beforehand would not do: other rules' stages may displace it meanwhile
            if error.java_exception.getClass().getSimpleName() != "NoSuchElementException":
                raise
            return 0

    return round(sum(map(took, stages)) / 1000, 3)


def peak_memory(spark: SparkSession) -> dict[str, int]:
    """By executor (and the driver) the greatest bytes of heap in use so far: what executors told with their heartbeats, and for the driver its pools' peaks."""
    jvm, out = spark._jvm, {}
    listed = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    for k in range(listed.size()):
        executor = listed.apply(k)
        told = executor.peakMemoryMetrics()
        out[executor.id()] = int(told.get().getMetricValue("JVMHeapMemory")) if told.isDefined() else 0
    heap = [p for p in jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans() if p.getType().toString() == "Heap memory"]
    out["driver"] = max(out.get("driver", 0), sum(int(p.getPeakUsage().getUsed()) for p in heap))
    return out
