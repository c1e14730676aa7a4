"""Media columns: payloads stored losslessly as 8-bit mono WAV, cut by content, deduplicated by digest, and rebuilt.

A rolling gear hash over the last 32 bytes cuts where its top bits are zero, between a least and a largest size; so an edit
moves few cuts, and a passage that two media share comes to the same chunks. Chunks go by SHA-256. What is stored are two tables in a
folder that all executors share: a manifest with each medium's chunks in order, and a chunk store with one copy of each chunk, compressed
with a dictionary that all share and bucketed by digest. Reading joins the two, which moves the manifest alone, sorts the chunks within a
medium, and holds the rebuilt medium to the checksum that was taken before it was cut. Features are read from the rebuilt bytes.

Chunks of 1/HOT_SHARE of all references or more, at most HOT_SHARE of at most LARGEST bytes, are joined by broadcast; so the references
to a chunk that a third of the media share stay in their tasks. No medium's or digest's references are gathered.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, on_workers, partitions, pick, shared_dir

UNIT, TAIL = 576, 32
#: Least and largest bytes of a chunk, and the bits of the hash that a cut needs to be zero (some 1.5 KB on average).
LEAST, LARGEST, BITS = 512, 8192, 10
#: Texts that the dictionary is made from (one chunk of each), its bytes, and the level of compression. They decide sizes alone.
SAMPLE, DICTIONARY, LEVEL = 4000, 262_144, 19
#: A chunk is hot from 1/HOT_SHARE of all references on, counted in one of COUNTED media. That decides how it is joined, never results.
HOT_SHARE, COUNTED = 1024, 16
RATE = 8000


def _gear() -> np.ndarray:
    """256 numbers from SHA-256 of their index: a rule, not a table."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear %d" % i).digest()[:4], "little") for i in range(256)], np.uint32)


_GEAR = _gear()


def payload(text: str) -> tuple[int, bytes]:
    """UTF-8 and bytes 255 up to a positive multiple of UNIT; the unpadded length first."""
    raw = text.encode("utf-8", "replace")
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    return len(raw), raw.ljust(size, b"\xff")


def wav(samples: bytes) -> bytes:
    """8-bit mono PCM; a pad byte makes the length even, as RIFF asks."""
    n = len(samples)
    head = b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)
    return head + samples + b"\0" * (n % 2)


def samples_of(media: bytes) -> bytes:
    """The data chunk of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("a WAV file without data")


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks. The hash of the last 32 bytes is built by doubling: 1, 2, 4, 8, 16, then 32 of them."""
    n = len(media)
    h = _GEAR[np.frombuffer(media, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if n <= k:
            break
        older = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += older
    places = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        k = int(np.searchsorted(places, at + LEAST))
        end = min(int(places[k]) if k < len(places) else n, at + LARGEST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def checksum(media: bytes) -> int:
    """Of a whole medium, whose chunks have digests of their own: it tells a wrong order or number of chunks."""
    return xxhash.xxh3_64_intdigest(media) - (1 << 63)


def features(samples: bytes) -> str:
    """Count, sum, sum of squares about 128, crossings of 128 and the largest deviation: integers, so alike everywhere."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())}"


def chunks_of(text: str | None) -> tuple[int, bytes, list[bytes]]:
    """The unpadded length, the medium, and its chunks in order."""
    n, raw = payload(text or "")
    media = wav(raw)
    ends = cuts(media)
    return n, media, [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def dictionary(rows: DataFrame) -> bytes:
    """A compression dictionary from the chunk of least digest of SAMPLE rows(doc_id, text); empty where they are too few for one."""
    lots = rows.select(F.xxhash64("doc_id").alias("lot"))
    last = lots.orderBy("lot").limit(SAMPLE).agg(F.max("lot")).first()[0]  # first the lots alone: tasks send no texts that are not chosen

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([min(chunks_of(t.as_py())[2], key=lambda c: hashlib.sha256(c).digest()) for t in batch.column(0)], pa.binary())], names=["data"])

    some = rows.where(F.xxhash64("doc_id") <= last).limit(SAMPLE).select("text")
    parts = sorted({r["data"] for r in on_workers(some, least, "data binary").collect()})
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes() if parts else b""
    except zstandard.ZstdError:
        return b""


def shared(words: bytes) -> dict[str, zstandard.ZstdCompressionDict]:
    return {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}


def manifest_of(rows: DataFrame) -> DataFrame:
    """One row per row of rows(row, doc_id, text): row, doc_id, n_bytes, a checksum of the whole, and the digests of its chunks in order, end to end."""
    names = ["row", "doc_id", "n_bytes", "whole", "digests"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, wholes, digests = [], [], []
            for text in batch.column(2):
                n, media, chunks = chunks_of(text.as_py())
                sizes.append(n)
                wholes.append(checksum(media))
                digests.append(b"".join([hashlib.sha256(c).digest() for c in chunks]))
            made = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(wholes, pa.int64()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=names)

    return on_workers(rows, run, "row long, doc_id long, n_bytes long, whole long, digests binary")


def pieces_of(rows: DataFrame, words: bytes) -> DataFrame:
    """digest and compressed data of each chunk of rows(text): what a chunk store is made of."""

    def made(found: dict[bytes, bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, write_dict_id=False, **shared(words))
        for batch in batches:
            found: dict[bytes, bytes] = {}
            held = 0
            for text in batch.column(0):
                for piece in chunks_of(text.as_py())[2]:
                    if (digest := hashlib.sha256(piece).digest()) not in found:
                        found[digest] = packed = pack.compress(piece)
                        held += len(packed)
                if held > 8 << 20:
                    yield made(found)
                    found, held = {}, 0
            yield made(found)

    return on_workers(rows.select("text"), run, "digest binary, data binary")


def rebuilt(ordered: DataFrame, words: bytes) -> DataFrame:
    """Media of ordered(row, at, chunks, doc_id, n_bytes, whole, data), whose rows of a medium follow each other in order. doc_id,
    n_bytes and whole are those of the row of its first chunk."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, chunks int"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(**shared(words))
        pieces: list[bytes] = []
        now = head = None
        for batch in batches:
            out: list[tuple] = []
            for row, at, chunks, doc_id, n, whole, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not pieces:
                    now, head = row, (doc_id, n, whole)
                if at != len(pieces) or row != now:
                    raise ValueError(f"chunk {at} of medium {row} came after {len(pieces)} chunks of medium {now}")
                pieces.append(unpack.decompress(data))
                if len(pieces) < chunks:
                    continue
                media = b"".join(pieces)
                pieces.clear()
                if checksum(media) != head[2]:
                    raise ValueError(f"medium {row} is not what was cut")
                raw = samples_of(media)
                out.append((head[0], head[1], len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), features(raw), chunks))
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])
        if pieces:
            raise ValueError("the last medium lacks chunks")

    return on_workers(ordered, run, schema)


class MediaStore:
    """Media in a folder that all executors reach: manifest, chunks, and a row with the dictionary and the number of buckets."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, docs: DataFrame) -> MediaStore:
        """Store the texts of docs(doc_id, text) as media, in place of what was there."""
        rows = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        words, buckets = dictionary(rows), min(partitions(self.spark), 100_000)
        manifest_of(rows).write.mode("overwrite").parquet(f"{self.path}/manifest")
        chunks = pieces_of(rows, words).groupBy("digest").agg(F.first("data").alias("data"))
        chunks.write.bucketBy(buckets, "digest").sortBy("digest").option("path", f"{self.path}/chunks").mode("overwrite").saveAsTable(f"chunks_{uuid.uuid4().hex}")
        self.spark.createDataFrame([(words, buckets)], "words binary, buckets int").write.mode("overwrite").parquet(f"{self.path}/settings")
        return self

    def chunks(self) -> tuple[DataFrame, bytes]:
        """The chunk store(digest, data), as a table that knows its buckets, and the dictionary."""
        words, buckets = self.spark.read.parquet(f"{self.path}/settings").first()
        name = f"chunks_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (digest BINARY, data BINARY) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/chunks'")
        return self.spark.table(name), bytes(words)

    def references(self) -> DataFrame:
        """A row per chunk of a medium; what belongs to the medium as a whole stands in the row of its first."""
        media = self.spark.read.parquet(f"{self.path}/manifest").withColumn("chunks", F.expr("int(octet_length(digests) div 32)"))
        each = media.withColumn("at", F.explode(F.expr("sequence(0, chunks - 1)")))
        first = [F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("doc_id", "n_bytes", "whole")]
        return each.select("row", "at", "chunks", *first, F.expr("substring(digests, at * 32 + 1, 32)").alias("digest"))

    def read(self, hot_share: int = HOT_SHARE) -> DataFrame:
        """One row per medium, rebuilt from its chunks and verified."""
        references, (store, words) = self.references(), self.chunks()
        some = references.where(F.pmod(F.xxhash64("row"), F.lit(COUNTED)) == 0)
        counts = some.groupBy("digest").agg(F.count("*").alias("n"))
        hot = cut(counts.where(F.col("n") > max(1, some.count() // hot_share)).select("digest"))
        often = F.broadcast(store.join(F.broadcast(hot), "digest", "left_semi"))
        both = references.join(often, "digest").unionByName(references.join(F.broadcast(hot), "digest", "left_anti").join(store, "digest"))
        ordered = both.drop("digest").repartition(partitions(self.spark), "row").sortWithinPartitions("row", "at")
        return rebuilt(ordered.select("row", "at", "chunks", "doc_id", "n_bytes", "whole", "data"), words)


def store_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text), stored and rebuilt from the stored bytes: doc_id, n_bytes (unpadded), payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature, chunks.

    A null text counts as empty: UNIT bytes 255. Repeated rows and null ids are media of their own, whose chunks are
    shared. Other columns are ignored. A medium is in memory whole when it is cut and when it is rebuilt, one at a time. The
    store is in `path`; a new folder in the shared one by default.
    """
    spark = docs.sparkSession
    return MediaStore(spark, path or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}").write(docs).read()
