"""validate() and its result, and a command line: python -m tramline.api FEED -o FOLDER."""

from __future__ import annotations

import argparse
import concurrent.futures
import datetime as dt
import json
import os
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feed import NOTICE, RunOptions
from .plans.runner import peak_memory, run_measured, run_rules
from .schema import notice_codes, notice_schema  # noqa: F401
from .sources import report
from .sources.feed import fetch, read_feed

VERSION = "0.2.0"
#: Seconds from which a rule is slow.
SLOW = 0.5


@dataclass(frozen=True)
class Notice:
    code: str
    severity: str
    file: str | None
    row: int | None
    field: str | None
    values: dict[str, str] = field(default_factory=dict)

    @property
    def message(self) -> str:
        """The code in words, and where and what."""
        where = "".join(f", {k} {v}" for k, v in (("file", self.file), ("row", self.row), ("field", self.field)) if v is not None)
        what = ", ".join(f"{k}: {v}" for k, v in self.values.items())
        return self.code.replace("_", " ").capitalize() + where + (f" ({what})" if what else "")

    def get(self, key: str, default: str | None = None) -> str | None:
        return self.values.get(key, default)

    def context(self) -> dict[str, str]:
        return dict(self.values)


@dataclass
class ValidationResult:
    """notices_df holds all notices, distributed; `notices` brings them to the driver, for feeds where that is wanted."""

    notices_df: DataFrame
    summary: dict
    validation_time_seconds: float
    #: What kept the feed from being read; then notices_df has no rows.
    system_errors: list[Notice] = field(default_factory=list)
    #: Seconds by phase and, if asked for, those that tasks of each rule ran.
    timings: dict[str, float] = field(default_factory=dict)
    #: Greatest bytes of heap of each executor, and of the driver.
    peak_memory: dict[str, int] = field(default_factory=dict)

    @cached_property
    def _totals(self) -> dict[str, int]:
        return {r["severity"]: r["count"] for r in self.notices_df.groupBy("severity").count().collect()}

    error_count = property(lambda self: self._totals.get("ERROR", 0))
    warning_count = property(lambda self: self._totals.get("WARNING", 0))
    info_count = property(lambda self: self._totals.get("INFO", 0))
    is_valid = property(lambda self: not self.error_count and not self.system_errors)
    slow_rules = property(lambda self: {k: v for k, v in self.timings.items() if k.startswith("rule ") and v > SLOW})

    def iterate(self, df: DataFrame | None = None) -> Iterator[Notice]:
        """Notices one by one, a partition at a time on the driver."""
        for r in (self.notices_df if df is None else df).toLocalIterator():
            yield Notice(r["code"], r["severity"], r["filename"], r["csv_row"], r["field"], {k: v for k, v in (r["context"] or {}).items() if v is not None})

    def _list(self, df: DataFrame) -> list[Notice]:
        """As a list, for feeds whose notices the driver can hold; else use iterate() or notices_df."""
        return list(self.iterate(df.orderBy("code", "filename", "csv_row", "field")))

    notices = property(lambda self: self._list(self.notices_df))
    errors = property(lambda self: self._list(self.notices_df.where("severity = 'ERROR'")))
    warnings = property(lambda self: self._list(self.notices_df.where("severity = 'WARNING'")))
    infos = property(lambda self: self._list(self.notices_df.where("severity = 'INFO'")))

    def by_code(self, code: str) -> list[Notice]:
        return self._list(self.notices_df.where(F.col("code") == code))

    @cached_property
    def _report(self) -> dict:
        return report.as_dict(self.notices_df, self.summary)

    def to_dict(self) -> dict:
        return self._report

    def to_json(self) -> str:
        return json.dumps(self._report, ensure_ascii=False)

    def save_json(self, path: str, pretty: bool = False) -> None:
        report.write_json(self._report, path, pretty)

    def save_html(self, path: str) -> None:
        report.write_html(self._report, path)

    def save_sarif(self, path: str) -> None:
        report.write_sarif(self._report, path)

    def save_system_errors(self, path: str, pretty: bool = False) -> None:
        one = lambda n: {"code": n.code, "severity": n.severity, "totalNotices": 1, "sampleNotices": [n.values]}
        report.write_json({"notices": [one(n) for n in self.system_errors]}, path, pretty)


def validate(
    source: str | bytes,
    country_code: str | None = None,
    date: dt.date | None = None,
    *,
    thorough: bool = False,
    google: bool = False,
    spark: SparkSession | None = None,
    on_progress: Callable[[str], None] | None = None,
    timing: bool = False,
    storage: str | None = None,
) -> ValidationResult:
    """Read a feed (folder, zip, its bytes, or a URL, downloaded into `storage`, which executors must see, or the shared folder) and run the rules. timing: with the seconds of each rule."""
    spark = spark or SparkSession.builder.getOrCreate()
    options = RunOptions(*([date] if date else []), **{"country": country_code, "google": google, "thorough": thorough})
    began, tell = time.perf_counter(), on_progress or (lambda what: None)
    timings: dict[str, float] = {}

    def passed(what: str, since: float) -> float:
        now = time.perf_counter()
        timings[what] = round(now - since, 3)
        return now

    tell("loading")
    try:
        if isinstance(source, str) and source.startswith(("http://", "https://")):
            source = fetch(spark, source, storage)
        feed = read_feed(spark, source, options)
    except (OSError, zipfile.BadZipFile, AnalysisException) as error:
        failed = Notice("i_o_error", "ERROR", None, None, None, {"exception": type(error).__name__, "message": str(error)[:500]})
        about = {"validationDate": options.date.isoformat()}
        return ValidationResult(spark.createDataFrame([], NOTICE), about, time.perf_counter() - began, [failed], timings)
    at = passed("loading", began)
    tell("checking")
    if timing:
        notices = run_measured(feed, options, timings)
    else:
        notices = run_rules(feed, options)
    at = passed("checking", at)
    tell("summarising")
    about = report.summary(feed, options.date)
    passed("summarising", at)
    tell("done")
    return ValidationResult(notices, about, time.perf_counter() - began, timings=timings, peak_memory=peak_memory(spark))


def validate_async(source: str | bytes, *args, **options) -> concurrent.futures.Future:
    """As validate(), in a thread of its own."""
    pool = concurrent.futures.ThreadPoolExecutor(1)
    future = pool.submit(validate, source, *args, **options)
    pool.shutdown(wait=False)
    return future


def version() -> str:
    return VERSION


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tramline")
    p.add_argument("feed", nargs="?")
    p.add_argument("-i", "--input")
    p.add_argument("-u", "--url")
    p.add_argument("-s", "--storage_directory", "--storage-directory", "--storage")
    p.add_argument("-o", "--output_base", "--output", dest="output", required=True)
    p.add_argument("-c", "--country_code", "--country-code", "--country", dest="country")
    p.add_argument("-d", "--date", "--date-for-validation", dest="date", type=dt.date.fromisoformat)
    p.add_argument("-v", "--validation_report_name", "--validation-report-name", dest="json_name", default="report.json")
    p.add_argument("-r", "--html_report_name", "--html-report-name", dest="html_name", default="report.html")
    p.add_argument("-e", "--system_errors_report_name", "--system-errors-report-name", dest="errors_name", default="system_errors.json")
    p.add_argument("-n", "--export_notices_schema", "--export-notices-schema", dest="schema", action="store_true")
    p.add_argument("-p", "--pretty", action="store_true")
    p.add_argument("--threads", type=int, help="threads of a local session, where this process starts one")
    p.add_argument("--sarif")
    p.add_argument("--google_rules", "--google-rules", action="store_true")
    p.add_argument("--thorough", action="store_true")
    p.add_argument("--timing", action="store_true")
    p.add_argument("--timing-json", action="store_true")
    a = p.parse_args(args)
    builder = SparkSession.builder
    spark = (builder.master(f"local[{a.threads}]") if a.threads else builder).getOrCreate()
    if a.schema:
        report.write_json(notice_schema(spark), f"{a.output}/notice_schema.json", a.pretty)
    source = a.input or a.feed or a.url
    if not source:
        return 0 if a.schema else p.error("an input or a URL is needed")
    result = validate(source, a.country, a.date, thorough=a.thorough, google=a.google_rules, spark=spark, timing=a.timing or a.timing_json, storage=a.storage_directory)
    result.save_json(f"{a.output}/{a.json_name}", a.pretty)
    result.save_html(f"{a.output}/{a.html_name}")
    result.save_system_errors(f"{a.output}/{a.errors_name}", a.pretty)
    if a.sarif:
        result.save_sarif(a.sarif if os.path.isabs(a.sarif) else f"{a.output}/{a.sarif}")
    if a.timing_json:
        print(json.dumps(result.timings | {"peak_memory": result.peak_memory}))
    elif a.timing:
        for what, seconds in sorted(result.timings.items(), key=lambda x: -x[1]):
            print(f"{seconds:10.3f} s  {what}" + "  slow" * (what in result.slow_rules))
    return int(not result.is_valid)


if __name__ == "__main__":
    raise SystemExit(main())
