"""What rules took and memory, by Spark's status store."""

import datetime as dt

from tramline import api
from tramline.operators import all_rules
from tramline.plans import runner

from .test_feed import BASE, zipped


def test_rules_are_measured_in_one_run(spark, monkeypatch):
    broken = all_rules()["TimepointTimeValidator"]
    monkeypatch.setattr(type(broken), "notices", lambda self, feed, options, old=type(broken).notices: 1 / 0 if self.name == broken.name else old(self, feed, options))
    files = BASE | {"routes.txt": BASE["routes.txt"].replace("R1,A1", "R1,A9")}
    result = api.validate(zipped(files), date=dt.date(2025, 1, 1), spark=spark, timing=True)
    measured = {k.removeprefix("rule "): v for k, v in result.timings.items() if k.startswith("rule ")}
    assert set(measured) == set(all_rules()) and sum(measured.values()) > 0 and measured["ReferentialIntegrityValidator"] > 0
    plain = api.validate(zipped(files), date=dt.date(2025, 1, 1), spark=spark)
    key = lambda n: (n.code, str(n.file), str(n.row), str(n.field))
    assert sorted(map(key, result.notices)) == sorted(map(key, plain.notices)) and result.by_code("foreign_key_violation") and result.by_code("runtime_exception_in_validator_error")
    assert result.peak_memory["driver"] > 1_000_000 and plain.peak_memory
    assert runner.task_seconds(spark, "no such group") == 0


def test_stages_that_the_store_has_dropped_count_nothing(spark):
    context = spark.sparkContext
    context.setJobGroup("dropped", "dropped")
    try:
        spark.range(1000).repartition(2).count()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert runner.task_seconds(spark, "dropped") >= 0
    kept = context._jsc.sc().statusStore().store()
    for job in context.statusTracker().getJobIdsForGroup("dropped"):
        for stage in context.statusTracker().getJobInfo(job).stageIds:
            key = context._gateway.new_array(context._jvm.int, 2)
            key[0], key[1] = stage, 0
            kept.delete(context._jvm.java.lang.Class.forName("org.apache.spark.status.StageDataWrapper"), key)
    assert runner.task_seconds(spark, "dropped") == 0
