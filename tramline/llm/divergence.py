"""Source divergence audit by sketch-prefiltered counting: how a source's words differ from those of its language's other sources.

Pass one: each task adds the document frequencies of its terms to a count-min sketch whose cells stop at LEAST; the sketches are merged
slice by slice, in two steps. A cell is never below the frequency of a term that falls in it, so a term with a cell below LEAST can't
have LEAST documents. Pass two counts again and drops such terms before anything is shuffled; survivors are counted exactly, and those below LEAST after
all are dropped then.

Scores are integers. A term that a group doesn't have still has a share there, the same for all such terms; so sums over all
kept terms are put together from the terms that groups do have: each source's terms by their count, and one join of the terms that two
sources have both. No list of all terms for all sources is built.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import importable
from .common import new_folder, on_workers, partitions, pick, written
from .near_dedup import _mixed

LEAST, TOP, SCALE = 10, 10, 1_000_000_000
#: The sketch: rows, and cells of a row for each document, a power of two between these; so it has 64 MB at most, and 8 MB as bits.
DEPTH, CELLS, NARROW, WIDE = 4, 16, 1 << 16, 1 << 24
#: Cells of a slice; salts of the first merge; terms of a group that a task holds at once, bytes of text that it splits at once, and rows that it sends at once.
SLICE, SALTS, HELD, PIECE, SENT = 1 << 16, 16, 300_000, 1 << 20, 50_000
#: Bytes of terms (A-Z lower-cased, letters a-z and all beyond ASCII) and a blank for all others.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)

def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """The texts of a batch in pieces of some PIECE bytes: the bytes with terms in lower case and all else blank, where each row ends, the first row, and whether
    it goes on in the next piece. Only a text that is longer than a piece is cut, at a blank."""
    texts = batch.column(2)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        at, last = int(offsets[row]), int(offsets[end])
        while at < last:
            to = last
            if end == row + 1 and last - at > PIECE:
                to = at + PIECE
                while to < last:  # to the next blank
                    blank = np.flatnonzero(_FOLD[data[to : min(last, to + 4096)]] == 32)
                    if len(blank):
                        to += int(blank[0])
                        break
                    to = min(last, to + 4096)
            yield _FOLD[data[at:to]], np.minimum(offsets[row : end + 1], to)[1:] - at, row, to < last
            at = to
        row = end


def _terms_of(folded: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms in order, and the row of each."""
    inside = folded != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    border = ends[:-1][ends[:-1] < len(folded)]
    begins[border] = inside[border]  # texts stand side by side
    at = np.flatnonzero(begins)
    rows = np.searchsorted(ends, at, side="right")
    letters = folded[inside]
    starts = np.flatnonzero(begins[inside]).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(starts, np.int32(len(letters)))), pa.py_buffer(letters)), rows


def tallies(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.Table]:
    """lang, source, term, n (occurrences), docs of batches(lang, source, text); put together within a task as long as they are `held` rows or fewer."""
    groups: dict[tuple[str, str], int] = {}
    parts: list[pa.Table] = []
    rows = 0

    def together() -> None:
        nonlocal parts, rows
        summed = pa.concat_tables(parts).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        parts, rows = [summed.rename_columns(["group", "term", "n", "docs"])], summed.num_rows

    def named() -> pa.Table:
        code = parts[0].column("group")
        lang, source = (pa.array([g[k] for g in groups], pa.string()).take(code.combine_chunks()) for k in (0, 1))
        return pa.table([lang, source, *parts[0].columns[1:]], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        group = np.array([groups.setdefault(x, len(groups)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
        open_: pa.Array | None = None  # terms of a text that has been cut, so far
        for folded, ends, first, goes_on in _pieces(batch):
            found, of = _terms_of(folded, ends)
            coded = found.dictionary_encode()
            codes, words = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            if not words:
                open_ = open_ if goes_on else None
                continue
            keys, counts = np.unique(of * words + codes, return_counts=True)
            of, codes = np.divmod(keys, words)
            docs = np.ones(len(keys), np.int64)
            if open_ is not None:  # a document counts once for a term
                docs[of == 0] = ~pc.is_in(coded.dictionary.take(pa.array(codes[of == 0])), value_set=open_).to_numpy(zero_copy_only=False)
            if goes_on:
                mine = coded.dictionary.take(pa.array(codes[of == of.max()]))
                open_ = mine if open_ is None else pa.concat_arrays([open_, mine]).unique()
            else:
                open_ = None
            short = pa.table({"key": group[first + of] * words + codes, "n": counts, "docs": docs}).group_by("key", use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
            which, codes = np.divmod(short.column("key").to_numpy(), words)
            parts.append(pa.table({"group": which.astype(np.int32), "term": coded.dictionary.take(pa.array(codes)), "n": short.column("n_sum"), "docs": short.column("docs_sum")}))
            rows += len(codes)
            if rows > 2 * held:
                together()
                if rows > held:
                    yield named()
                    parts, rows = [], 0
    if parts:
        together()
        yield named()


def cells(lang: pa.Array, names: pa.Array, width: int) -> np.ndarray:
    """The cell of each term of a language in each row of the sketch, DEPTH x terms: a hash and one made of it, combined."""
    code = lang.dictionary_encode()
    seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in code.dictionary.to_pylist()], np.uint64)
    term = np.fromiter(map(xxhash.xxh64_intdigest, names.cast(pa.binary()).to_pylist()), np.uint64, len(names))
    first = _mixed(term ^ seeds[code.indices.to_numpy()])
    step = _mixed(first) | np.uint64(1)
    with np.errstate(over="ignore"):
        mixed = first + np.arange(DEPTH, dtype=np.uint64)[:, None] * step
    return ((mixed >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64)


def add(sketch: np.ndarray, at: np.ndarray, docs: np.ndarray, least: int) -> None:
    """Add document frequencies to one row's cells, which stop at `least`: none is below a term's frequency or `least`."""
    where, which = np.unique(at, return_inverse=True)
    sketch[where] = np.minimum(sketch[where] + np.bincount(which, docs).astype(np.int64), least)


def sketch_slices(texts: DataFrame, width: int, least: int) -> DataFrame:
    """slice, salt and cells (compressed) of each task's sketch, where not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, salt = np.zeros((DEPTH, width), np.uint8), None
        for found in (b for table in tallies(batches) for b in table.to_batches(max_chunksize=SENT)):
            at, docs = cells(found.column("lang"), found.column("term"), width), np.minimum(found.column("docs").to_numpy(), least)
            salt = int(at[0, 0]) % SALTS if salt is None else salt
            for row in range(DEPTH):
                add(sketch[row], at[row], docs, least)
        flat = sketch.reshape(-1, SLICE)
        some = np.flatnonzero(flat.any(axis=1)).tolist()
        packed = [zlib.compress(flat[k].tobytes(), 1) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([salt or 0] * len(some), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "salt", "cells"])

    return on_workers(texts, run, "slice int, salt int, cells binary")


def merged(slices: DataFrame, least: int, bits: bool = False) -> DataFrame:
    """Slices added up within each partition, a sketch of bounded size at most. bits: then a bit tells for each cell whether it has reached `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, salt, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                one = np.frombuffer(zlib.decompress(packed), np.uint8)
                have = sums.get((k, salt))
                sums[k, salt] = one if have is None else np.minimum(have + one, least)  # two cells of `least` are far below 256
        keys = list(sums)
        packed = [np.packbits(sums[k] >= least).tobytes() if bits else zlib.compress(sums[k].tobytes(), 1) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([s for _, s in keys], pa.int32()), pa.array(packed, pa.binary())], names=["slice", "salt", "cells"])

    return on_workers(slices, run, "slice int, salt int, cells binary")


def possible(texts: DataFrame, width: int, least: int) -> np.ndarray:
    """Bits of the merged sketch, DEPTH x width / 8: whether a cell has reached `least`. Their number is the sketch's, whatever the corpus."""
    n = partitions(texts.sparkSession)
    once = merged(sketch_slices(texts, width, least).repartition(n, "slice", "salt"), least)
    # one operator with Python workers in a stage, so that no second set of them takes memory
    twice = merged(once.withColumn("salt", F.lit(0)).repartition(n, "slice"), least, bits=True)
    bits = np.zeros((DEPTH * width // SLICE, SLICE // 8), np.uint8)
    for row in twice.collect():
        bits[row["slice"]] |= np.frombuffer(row["cells"], np.uint8)
    return bits.reshape(DEPTH, width // 8)


def term_counts(texts: DataFrame, width: int, least: int) -> DataFrame:
    """lang, source, term, n (occurrences), docs: of each term that the sketch allows. Exact; some terms have fewer than `least` documents."""
    spark = texts.sparkSession
    importable(spark)
    sent = spark.sparkContext.broadcast(possible(texts, width, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for found in (b for table in tallies(batches) for b in table.to_batches(max_chunksize=SENT)):
            at = cells(found.column("lang"), found.column("term"), width)
            on = np.ones(found.num_rows, bool)
            for row in range(DEPTH):
                on &= (bits[row][at[row] >> 3] << (at[row] & 7).astype(np.uint8) & 128) > 0
            yield found.filter(pa.array(on))

    counted = on_workers(texts, run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a term with `count` of `total` occurrences among `kept` terms. Decimals, as the product may pass 64 bits; null if there is no term."""
    wide = lambda c: c.cast("decimal(38,0)")
    scaled, of = (wide(count) + F.lit(2)).cast("decimal(27,0)") * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(kept) * F.lit(2).cast("decimal(1,0)")
    return F.when(kept > 0, F.lit(1).cast("long") + F.call_function("div", scaled, F.nullif(of, F.lit(0).cast("decimal(38,0)"))))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of docs(lang, source, text).

    Part `pair`: how far each other source of the language is, over all kept terms, all ranks. Part `term`: the `top` kept terms that the source
    has more of, by share, than its language. Ranks go by value, descending, then item in UTF-8 order. Null text, lang and source count
    as empty, and empty ones are a group like any other. Kept are the terms in `least` documents of the language or more; where there are none, pairs have
    value 0. A source that is its language's only one has no pairs. Repeated rows count as often as they stand. Other columns
    are ignored; an empty table gives an empty result.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    texts = pick(docs, "lang", "source", "text").select(blank("lang"), blank("source"), "text")
    folder = new_folder(docs.sparkSession, "divergence")
    groups = written(texts.groupBy("lang", "source").agg(F.count("*").alias("rows")), f"{folder}/groups")
    rows = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    width = min(WIDE, max(NARROW, 1 << max(0, (rows * CELLS - 1)).bit_length()))
    counted = written(term_counts(texts, width, least), f"{folder}/counted")
    in_lang = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    in_lang = written(in_lang, f"{folder}/terms")
    kept = written(counted.drop("docs").join(in_lang, ["lang", "term"]), f"{folder}/kept")  # lang, term, source, n, lang_n

    langs = in_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    facts = groups.select("lang", "source").join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").select("lang", "source", *map(zero, ("v", "lang_total", "total", "own")))
    facts = written(facts.withColumn("none", share(F.lit(0), F.col("total"), F.col("v"))), f"{folder}/facts")

    shares = kept.join(facts.select("lang", "source", "v", "total", "lang_total", "none"), ["lang", "source"])
    shares = shares.withColumns({"p": share(F.col("n"), F.col("total"), F.col("v")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("v"))})
    shares = written(shares.select("lang", "source", "term", "p", "q", "none"), f"{folder}/shares")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # Terms of one source against those that the other one lacks: by share, as equal counts have equal shares.
    other = facts.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"))
    own = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")).join(other, "lang").where("source <> item")
    alone = written(own.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * apart(F.col("p"), F.col("item_none"))).alias("alone")), f"{folder}/alone")
    # Terms of both, from the smaller name to the larger: what they add to the sums of each against the other's lack.
    a, b = (shares.select("lang", "term", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "none")]) for x in "ab")
    both = a.join(b, ["lang", "term"]).where("source_a < source_b")
    gain = apart(F.col("p_a"), F.col("p_b")) - apart(F.col("p_a"), F.col("none_b")) - apart(F.col("p_b"), F.col("none_a"))
    both = written(both.groupBy("lang", "source_a", "source_b").agg(F.sum(gain).alias("gain"), F.count("*").alias("shared")), f"{folder}/both")
    ways = both.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "gain", "shared")
    ways = ways.unionByName(both.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), "gain", "shared"))
    pairs = facts.join(facts.select("lang", F.col("source").alias("item"), F.col("own").alias("item_own"), F.col("none").alias("item_none")), "lang").where("source <> item")
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("back"))
    pairs = pairs.join(alone, ["lang", "source", "item"], "left").join(back, ["lang", "source", "item"], "left").join(ways, ["lang", "source", "item"], "left")
    lacking = F.col("v") - F.col("own") - F.col("item_own") + zero("shared")
    value = F.when(F.col("v") > 0, zero("alone") + zero("back") + zero("gain") + lacking * apart(F.col("none"), F.col("item_none"))).otherwise(F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(found)
