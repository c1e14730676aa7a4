"""Token counts as delta-maintained rollups.

Totals of documents, tokens and characters by source, language and tokenizer version are sums of committed deltas. A
batch of signed changes (+1 insert, -1 delete; a revised count is both) is aggregated and written as one delta. A marker file under the
batch's id, which only one job can create, makes it count: so a retried batch, or one that two jobs send, counts once, and a crashed
job's delta never does. Totals read deltas alone, whose size doesn't depend on the documents; fold() sums them up in one, and
clean() removes what no marker names.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import importable
from .common import pick, shared_dir, word_count
from .piece_tokens import Encoded, tokenizer

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
#: Tokenizer versions by name: words without ASCII white space, and UTF-8 bytes. Both count a null text as nothing.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"words-1": word_count, "utf8-bytes-1": lambda text: F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))}


def pieces(model_path: str) -> Callable[[Column], Column]:
    """A tokenizer version that counts the ids of a public piece vocabulary."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encoded = Encoded(tokenizer(model_path))
        return pd.Series([decimal.count(",") + 1 if (decimal := encoded(t or "")[0]) else 0 for t in texts], dtype="int64")

    return count


class TokenRollup:
    """Totals in a folder that all executors reach; made there when the first batch is committed."""

    def __init__(self, spark: SparkSession, path: str):
        importable(spark)
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _claim(self, name: str, lines: list[str]) -> bool:
        """Create a marker file; False if there is one."""
        try:
            out = self._fs.create(self._path(f"{self.path}/{name}"), False)
        except Py4JJavaError:
            if self._fs.exists(self._path(f"{self.path}/{name}")):
                return False
            raise
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        return True

    def _markers(self, kind: str) -> dict[str, list[str]]:
        """The lines of each marker file; one that is still empty counts for nothing."""
        where = self._path(f"{self.path}/{kind}")
        if not self._fs.exists(where) or not self._fs.listStatus(where):
            return {}
        found: dict[str, list[str]] = {}
        for r in self.spark.read.text(f"{self.path}/{kind}").select(F.col("_metadata.file_name").alias("name"), "value").collect():
            found.setdefault(r["name"], []).append(r["value"])
        return found

    def committed(self) -> list[str]:
        return sorted(self._markers("commits"))

    def _write(self, name: str, delta: DataFrame) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.path}/data/{folder}")  # a row per key, by as many tasks as sum them up
        return folder

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit changes(sign, source, lang, tokenizer, n_tokens, n_chars) as one batch; False if it had been committed."""
        if not batch_id or any(not (c.isalnum() or c in "-_.") for c in batch_id) or batch_id[0] in "._":
            raise ValueError(f"batch id {batch_id!r}: letters, digits, '-', '_' and '.' only, beginning with none of the last two")
        if self._fs.exists(self._path(f"{self.path}/commits/{batch_id}")):
            return False
        signed = lambda c: F.sum(F.col("sign") * F.col(c)).cast("long").alias(c)
        delta = changes.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), signed("n_tokens"), signed("n_chars"))
        folder = self._write(batch_id, delta)
        if self._claim(f"commits/{batch_id}", [folder]):
            return True
        self._fs.delete(self._path(f"{self.path}/data/{folder}"), True)  # another job was first
        return False

    def _current(self) -> tuple[int, list[str], list[str]]:
        """The number of the last fold, the batches that count, and the folders that hold their sums."""
        batches, folds = self._markers("commits"), self._markers("folds")
        last = max((int(n) for n in folds), default=0)
        lines = folds.get(str(last), [])
        folded = set(lines[1:])
        return last, sorted(batches), lines[:1] + [lines_[0] for b, lines_ in sorted(batches.items()) if b not in folded]

    def _sums(self, folders: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
        if not folders:
            return self.spark.createDataFrame([], schema)
        deltas = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders])
        return deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars; keys whose documents have all been deleted are left out."""
        return self._sums(self._current()[2])

    def fold(self) -> bool:
        """Sum up all deltas in one; totals stay. False if another job did so meanwhile."""
        last, batches, folders = self._current()
        return self._claim(f"folds/{last + 1}", [self._write("fold", self._sums(folders)), *batches])

    def clean(self, older_s: float = 7 * 86400) -> int:
        """Remove folders that totals don't need and that are older than any job that may still commit them; how many."""
        used, now, gone = set(self._current()[2]), time.time() * 1000, 0
        for s in self._fs.listStatus(self._path(f"{self.path}/data")):
            if s.getPath().getName() not in used and now - s.getModificationTime() >= older_s * 1000:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def counted(docs: DataFrame, tokenizers: dict[str, Callable[[Column], Column]] = TOKENIZERS) -> DataFrame:
    """docs(source, lang, text) with one row for each tokenizer version: source, lang, tokenizer, n_tokens, n_chars.

    Null texts have no tokens and characters; null sources and languages are keys of their own; other columns are ignored.
    """
    rows = pick(docs, "source", "lang", "text")
    chars = F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long"))
    each = [F.struct(F.lit(n).alias("tokenizer"), f(F.col("text")).alias("n_tokens")) for n, f in tokenizers.items()]
    counts = rows.select("source", "lang", chars.alias("n_chars"), F.array(*each).alias("each"))
    return counts.select("source", "lang", "n_chars", F.explode("each").alias("one")).select("source", "lang", "one.tokenizer", "one.n_tokens", "n_chars")


def inserted(docs: DataFrame, **options) -> DataFrame:
    return counted(docs, **options).withColumn("sign", F.lit(1))


def deleted(docs: DataFrame, **options) -> DataFrame:
    """docs as they were when inserted."""
    return counted(docs, **options).withColumn("sign", F.lit(-1))


def revised(before: DataFrame, after: DataFrame, **options) -> DataFrame:
    return reduce(DataFrame.unionByName, [deleted(before, **options), inserted(after, **options)])


def token_totals(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Totals of docs(source, lang, text) after a usual course of batches, in the rollup in `path`; a new one in the shared folder by default.

    All rows are loaded; those whose text has white space at an end, or other than single spaces inside, are revised to their squeezed
    text; those whose squeezed text is empty are deleted; the first batch is sent again; and all is folded in one. So the totals are those
    of squeezed texts that are not empty. Null texts count as empty, null keys are keys; repeated rows count each.
    """
    spark = docs.sparkSession
    rollup = TokenRollup(spark, path or f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}")
    rows = pick(docs, "source", "lang", "text").withColumn("text", F.coalesce("text", F.lit("")))
    squeezed = rows.withColumn("old", F.col("text")).withColumn("text", F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    rollup.commit("load", inserted(rows))
    changed = squeezed.where("text <> old")
    rollup.commit("squeeze", revised(changed.select("source", "lang", F.col("old").alias("text")), changed))
    rollup.commit("drop-empty", deleted(squeezed.where("text = ''")))
    rollup.commit("load", inserted(rows))  # a retry, which changes nothing
    rollup.fold()
    return rollup.totals()
