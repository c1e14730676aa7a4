"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints. A text's words are lower-cased (A-Z) runs without ASCII white space, its shingles SHINGLE words in a row, repeats
included. A bit of the fingerprint is 1 if more than half the shingles' XXH64 hashes have it.

Covering masks. Each of the 64 bits gets a non-zero vector of RADIUS + 1 bits; the mask of a non-zero vector v has the bits whose vectors have an
odd product with v. The vectors of RADIUS bits leave some v orthogonal to them all, so two fingerprints that differ in these bits
alone agree under the mask of v: every pair within the radius meets in some table, and nothing is left to chance.

Buckets. A table's buckets are the fingerprints that agree under its mask. One of up to SMALL fingerprints is compared in a task, which
emits the links that join its parts and no more. In a larger one the members differ in the bits outside the mask alone, so these bits
get masks of their own, and so on. Each level halves the free bits, hence the members that a bucket can have, until all are small.
No bucket is gathered before its size is known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, on_workers, pick, written
from .near_dedup import components

SHINGLE, RADIUS, SEED, BITS = 3, 3, 42, 64
#: Fingerprints of a bucket that one task compares at once.
SMALL = 256
#: A fingerprint is hot from 1/HOT_SHARE of all rows; so there are at most HOT_SHARE of them, the bound of the one broadcast.
HOT_SHARE = 1024
#: Bytes of a text split into words at once.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    at = 0
    while at < len(data):
        gap = SPACE.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        yield data[at:end].lower().split()
        at = end


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, unsigned; 0 if it has no words."""
    ones, n, held = np.zeros(BITS, np.int64), 0, []

    def add(shingles: list[bytes]) -> None:
        nonlocal n
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        ones[:] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(shingles)

    for words in words_of(data):
        held += words
        if len(held) >= size:
            add(list(map(b" ".join, zip(*(held[k:] for k in range(size)), strict=False))))
            held = held[len(held) - size + 1 :]
    if not n and held:
        add([b" ".join(held)])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little") if n else 0


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and print (the fingerprint as a signed long) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.array([fingerprint(t.as_py() or b"", size) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return on_workers(docs, run, "doc_id long, print long")


def masks(free: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the bits `free`, so that any `radius` of these are outside one mask at least."""
    order = sorted(range(1, 2 ** (radius + 1)), key=int.bit_count)  # unit vectors first: no mask is empty as long as there are radius + 1 bits
    vectors = {bit: order[k % len(order)] for k, bit in enumerate(free)}
    return [sum(1 << bit for bit, of in vectors.items() if (of & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def bits_of(mask: int) -> list[int]:
    """The bits outside a mask."""
    return [b for b in range(BITS) if not mask >> b & 1]


def closer_than(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that join what is within `radius` of each other in any number of steps: one less than the members of each part."""
    up = list(range(len(members)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    links = []
    for i in range(1, len(members)):
        for j in np.flatnonzero(np.bitwise_count(members[:i] ^ members[i]) <= radius).tolist():
            if (a := root(i)) != (b := root(j)):
                up[a] = b
                links.append((i, j))
    return links


def linked(prints: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """links(a, b), a > b, between distinct prints(print): they join all prints within `radius` bits of each other, in any number of steps."""
    if small < 2**radius:
        raise ValueError(f"{radius} bits can't be cut further, so tasks must take {2**radius} members")
    spark = prints.sparkSession
    folder = new_folder(spark, "covering")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.column(0):
                members = row.values.to_numpy()
                found += [(max(members[i], members[j]), min(members[i], members[j])) for i, j in closer_than(members.view(np.uint64), radius)]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found, level = [], 0
    tables = {0: 0}  # name of a table -> its mask
    rows = prints.select(F.lit(0).alias("table"), "print")
    while True:
        # Each table of the level before is cut into tables of its own; their number, 15, 225 ..., doesn't depend on the data.
        below = [(name, name * 2 ** (radius + 1) + k, mask | part) for name, mask in tables.items() for k, part in enumerate(masks(bits_of(mask), radius), 1)]
        tables = {name: mask for _, name, mask in below}
        finer = spark.createDataFrame([(up, name, _signed(mask)) for up, name, mask in below], "table int, finer int, mask long")
        placed = rows.join(F.broadcast(finer), "table").select(F.col("finer").alias("table"), F.col("print").bitwiseAND(F.col("mask")).alias("key"), "print")
        sizes = written(placed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/sizes-{level}")
        compared = placed.join(sizes.where(F.col("n") <= small), ["table", "key"]).groupBy("table", "key").agg(F.collect_list("print").alias("members"))
        found.append(on_workers(compared.select("members"), compare, "a long, b long"))
        if sizes.where(F.col("n") > small).isEmpty():
            break
        rows = written(placed.join(sizes.where(F.col("n") > small), ["table", "key"]).select("table", "print"), f"{folder}/large-{level}")
        level += 1
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return written(links.distinct(), f"{folder}/links")


def simhash_components(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, small: int = SMALL, hot_share: int = HOT_SHARE) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint (16 hexadecimal digits), component_id.

    Texts are linked if their fingerprints differ in `radius` bits or fewer; component_id is the least doc_id that can be reached, over any number of links. A
    null text, or one without words, has fingerprint zero and is linked like any other; of fewer than `size` words, the whole
    sequence is the one shingle. Null doc_ids are never a component_id unless a component has no other. Repeated rows stay. Other
    columns are ignored, and an empty table gives an empty result.
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = new_folder(docs.sparkSession, "simhash")
    signed = written(fingerprints(docs, size), f"{folder}/prints")
    known = written(signed.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), f"{folder}/distinct")
    classes = components(linked(known.select("print"), radius, small)).select(F.col("member").alias("print"), "class")
    known = known.join(classes, "print", "left").withColumn("class", F.coalesce("class", "print"))
    least = known.groupBy("class").agg(F.min("least").alias("component_id"))
    best = written(known.join(least, "class").select("print", "n", "component_id"), f"{folder}/components")
    hot = F.broadcast(best.where(F.col("n") > max(1, signed.count() // hot_share)))
    each = signed.join(hot, "print").unionByName(signed.join(hot.select("print"), "print", "left_anti").join(best, "print"))
    return each.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
