"""Near-duplicate classes by BagMinHash: weighted signatures of word shingles, banding, and verified multiset overlap.

Signatures. A shingle of multiplicity w covers the weights (0, w]. These are cut into the strata (0,1], (1,2], (2,4],
(4,8] ...; each stratum of a shingle has a Poisson process of its own, seeded by both, whose points have a time, a
signature slot and a weight within the stratum. Points above the multiplicity are thinned out, so the rest are a process
over (0, w], and the earliest point of a slot is the same for two texts with the probability of their weighted Jaccard similarity.
Points are only drawn up to the time by which all slots have one; a text needs few more than one draw a shingle.

Candidates. Signatures are banded. A bucket's pairs are not listed: in a first round each member is held against one pivot,
the least doc_id, and in a second against two more. Verified links join members to classes. Where members of a bucket are left
in different classes, tasks compare the sketches of blocks of some BLOCK members of it, two at a time, and verify by their texts the pairs of
different classes that agree in AGREE of the slots or more. At a similarity of 0.8, fewer agree with a probability of 0.00001.
Copies (equal word sequences) are one member.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import importable
from .common import cut, on_workers, partitions, pick, positional

SHINGLE, SIMILARITY = 5, 0.8
#: 80 slots: a pair at 0.8 meets in a band with probability 0.99997.
BANDS, ROWS = 20, 4
#: Rounds with pivots, 1, 2 ... of a bucket; members of a block; share of slots that agree in listed pairs.
TURNS, BLOCK, AGREE = 2, 512, 0.6
#: Words remembered by a task, and words signed together.
REMEMBERED, TOGETHER = 500_000, 100_000
#: Links of a task of components().
LINKS_A_TASK = 50_000
_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S11 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(11)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser (splitmix64), element by element."""
    with np.errstate(over="ignore"):
        x = x + _MIX1
        x = (x ^ (x >> _S30)) * _MIX2
        x = (x ^ (x >> _S27)) * _MIX3
        return x ^ (x >> _S31)


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> _S11).astype(np.float64) + 1.0) * 2.0**-53


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = BANDS * ROWS) -> np.ndarray:
    """A signature for each bag: distinct 64-bit elements with positive integer weights. Each slot holds its earliest point's 64-bit name.

    No bag may be empty. The bags advance together, which spares most of the array calls.
    """
    out = np.zeros((len(bags), slots), np.uint64)
    if not bags:
        return out
    owner = np.repeat(np.arange(len(bags)), [len(e) for e, _ in bags])
    ids, tops = np.concatenate([e for e, _ in bags]), np.concatenate([w for _, w in bags])
    until = (np.log(slots) + 3.0) / np.array([float(w.sum()) for _, w in bags])
    lows, spans = np.zeros(len(ids)), np.ones(len(ids))
    if (heavy := tops > 1).any():
        parts, low = [(owner, ids, tops, lows, spans)], 1
        more = [owner[heavy], ids[heavy], tops[heavy]]
        while len(more[0]):
            n = len(more[0])
            parts.append((more[0], _mixed(more[1] ^ np.uint64(low)), more[2], np.full(n, float(low)), np.full(n, float(low))))
            low *= 2
            more = [x[more[2] > low] for x in more]
        owner, ids, tops, lows, spans = (np.concatenate(x) for x in zip(*parts, strict=True))
    seeds, rates = _mixed(ids), slots * spans
    times = -np.log(_uniform(seeds)) / rates
    while True:
        alive = np.flatnonzero(times <= until[owner])
        now = [x[alive] for x in (owner, seeds, times, rates, tops, lows, spans)]
        found: list[tuple[np.ndarray, ...]] = []
        while len(now[0]):
            doc, s, t, r, top, lo, sp = now
            where = _mixed(s ^ _MIX2)
            inside = lo + np.ceil(_uniform(_mixed(s ^ _MIX3)) * sp) <= top  # of the stratum's points, those up to the weight
            found.append((doc[inside] * slots + (where[inside] % np.uint64(slots)).astype(np.int64), t[inside], where[inside]))
            s = _mixed(s)
            t = t - np.log(_uniform(s)) / r
            on = t <= until[doc]
            now = [x[on] for x in (doc, s, t, r, top, lo, sp)]
        slot, at, name = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))
        order = np.lexsort((name, at, slot))
        slot, name = slot[order], name[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        slot, name = slot[first], name[first]
        filled = np.bincount(slot // slots, minlength=len(bags)) == slots
        whole = filled[slot // slots]
        out.reshape(-1)[slot[whole]] = name[whole]
        left = ~filled[owner]
        if not left.any():
            return out
        owner, seeds, times, rates, tops, lows, spans = (x[left] for x in (owner, seeds, times, rates, tops, lows, spans))
        until *= 2  # points up to the old time come again, the same


class Shingler:
    """Hashed word shingles of texts; words' hashes are remembered."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.seen: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        seen, words = self.seen, text.lower().split()
        got = list(map(seen.get, words))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    w = words[i]
                    got[i] = seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
        return np.array(got, dtype=np.uint64)

    def bag(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles, sorted, and how often each occurs. Under `size` words, all of them are one shingle."""
        n = min(self.size, len(words))
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            h = _mixed(h ^ words[k : len(words) - n + 1 + k])
        return np.unique(h, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def signatures(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, copy (digest of the lower-cased words), bands (a hash of each) and sketch (16 bits of each slot); nulls without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            digests: list[bytes | None] = []
            keys: list[np.ndarray | None] = []
            sketches: list[bytes | None] = []
            bags: list[tuple[np.ndarray, np.ndarray]] = []
            waiting: list[int] = []

            def sign() -> None:
                names = bag_minhash(bags, bands * rows).reshape(len(bags), bands, rows)
                key = np.full((len(bags), bands), size, np.uint64)
                for k in range(rows):
                    key = _mixed(key ^ names[:, :, k])
                short = (names >> np.uint64(48)).astype(np.uint16)
                for i, one, sketch in zip(waiting, key.view(np.int64), short, strict=True):
                    keys[i], sketches[i] = one, sketch.tobytes()
                bags.clear()
                waiting.clear()

            held = 0
            for i, text in enumerate(batch.column(1)):
                words = shingler.words(text.as_py() or "")
                keys.append(None)
                sketches.append(None)
                digests.append(xxhash.xxh3_128_digest(words.tobytes()) if len(words) else None)
                if len(words):
                    bags.append(shingler.bag(words))
                    waiting.append(i)
                    held += len(words)
                if held >= TOGETHER:
                    sign()
                    held = 0
            sign()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "copy", "bands", "sketch"])

    return on_workers(docs, run, "doc_id long, copy binary, bands array<long>, sketch binary")


class Joined:
    """Classes that a task has joined."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, c: int) -> int:
        while (up := self.up.get(c, c)) != c:
            c = up
        return c

    def join(self, x: int, y: int) -> None:
        """x and y are roots."""
        self.up[max(x, y)] = min(x, y)


def verify(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """links(a, b) of classes: those of pairs(a, b, class_a, class_b) whose texts(member, text) overlap by `least` or more.

    What would join classes that a task has joined already is skipped. The join's large keys are left to be split at run time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, joined, last, bag = Shingler(size), Joined(), None, None
        for batch in batches:
            keep = []
            of_a, of_b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, (b, ta, tb) in enumerate(zip(batch.column(0), batch.column(3), batch.column(4), strict=True)):
                if (x := joined.root(of_a[i])) == (y := joined.root(of_b[i])):
                    continue
                if (b := b.as_py()) != last:
                    last, bag = b, shingler.bag(shingler.words(tb.as_py()))
                if overlap(shingler.bag(shingler.words(ta.as_py())), bag) >= least:
                    joined.join(x, y)
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], names=["a", "b"]).take(pa.array(keep, pa.int64()))

    both = pairs.join(texts.select(F.col("member").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("member").alias("b"), F.col("text").alias("text_b")), "b").select("b", "class_a", "class_b", "text_a", "text_b")
    return on_workers(both, run, "a long, b long")


def linked(state: DataFrame, members: DataFrame, texts: DataFrame, slots: int, size: int, least: float) -> DataFrame:
    """links(a, b) of classes that join members of a bucket but of different classes.

    Tasks compare the blocks of a bucket two at a time, by sketches alone, and name the members with a partner of another class
    that agrees in AGREE of the slots; only the texts of these are fetched. Then such pairs are verified in the first
    bucket that they share; what would join classes that a task has joined already is skipped. Only links leave a task.
    """
    sizes = state.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("least"), F.max("class").alias("most")).where("least < most")
    blocks = state.join(sizes.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "bucket")
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    blocks = blocks.join(members.select("member", "bands", "sketch"), "member")
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = blocks.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "band", "own", "member", "class", "bands", "sketch")

    def partners(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each member outside the largest class, those that may be its partners, and how far they agree."""
        own, of_class = rows.column("own").to_numpy(), rows.column("class").to_numpy()
        names = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(len(own), slots)
        keys = np.array(rows.column("bands").to_pylist())
        band, within = rows.column("band")[0].as_py(), rows.column("low")[0] == rows.column("high")[0]
        known, counts = np.unique(of_class, return_counts=True)
        for i in np.flatnonzero(of_class != known[counts.argmax()]).tolist():  # a pair of different classes has a member outside the largest
            agree = (names == names[i]).sum(axis=1)
            fits = (agree >= AGREE * slots) & (of_class != of_class[i])
            if not within:
                fits &= own != own[i]
            near = np.flatnonzero(fits)
            yield i, near[(keys[near] == keys[i]).argmax(axis=1) == band], agree

    def screen(rows: pa.Table) -> pa.Table:
        found = np.zeros(rows.num_rows, bool)
        for i, near, _ in partners(rows):
            found[near] = True
            found[i] |= len(near) > 0
        return rows.filter(pa.array(found))

    def compare(rows: pa.Table) -> pa.Table:
        of_class = rows.column("class").to_numpy()
        shingler, texts_ = Shingler(size), rows.column("text")
        bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        joined = Joined()

        def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in bags:
                bags[i] = shingler.bag(shingler.words(texts_[i].as_py()))
            return bags[i]

        a, b = [], []
        for i, near, agree in partners(rows):
            for j in near[np.argsort(-agree[near], kind="stable")].tolist():
                if (x := joined.root(int(of_class[i]))) != (y := joined.root(int(of_class[j]))) and overlap(bag(i), bag(j)) >= least:
                    joined.join(x, y)
                    a.append(of_class[i])
                    b.append(of_class[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    importable(state.sparkSession)
    screened = cut(pair.groupBy("bucket", "low", "high").applyInArrow(screen, pair.schema))
    return screened.join(texts, "member").groupBy("bucket", "low", "high").applyInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """member, class: the least member reachable by links(a, b), for all members that have a link.

    Labels spread to neighbours and then jump to their label's label, so rounds grow with the logarithm of the longest chain; the
    state of each is cut. No set of links or members is gathered anywhere: the tasks of a round are as many as the links ask for, so that
    rounds over few links are short and leave few files.
    """
    spark = links.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, links.coalesce(partitions(spark)).count() // LINKS_A_TASK)
    ends = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ("ab", "ba")])
    edges = cut(links.coalesce(tasks).select(F.inline(ends)))
    labels = None
    while True:
        if labels is None:
            spread = edges.groupBy("x").agg(F.least("x", F.min("y")).alias("to")).select(F.col("x").alias("member"), "to", F.col("x").alias("was"))
        else:
            near = edges.join(labels.select(F.col("member").alias("y"), F.col("label").alias("to")), "y").select(F.col("x").alias("member"), "to", F.lit(None).cast("long").alias("was"))
            own = labels.select("member", F.col("label").alias("to"), F.col("label").alias("was"))
            spread = near.unionByName(own).groupBy("member").agg(F.min("to").alias("to"), F.max("was").alias("was"))
        jump = spread.select(F.col("member").alias("to"), F.col("to").alias("far"))
        new = cut(spread.join(jump, "to").select("member", F.col("far").alias("label"), "was").coalesce(tasks))
        labels = new.select("member", "label")
        if new.where("label <> was").isEmpty():
            return labels.select("member", F.col("label").alias("class"))


def renamed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with their `class` replaced by its class in roots(member, class), where it has one."""
    return rows.join(roots.select(F.col("member").alias("class"), F.col("class").alias("root")), "class", "left").withColumn("class", F.coalesce("root", "class")).drop("root")


def near_classes(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, class_id, kept.

    class_id is the least doc_id of the class: texts linked, in any number of steps, by a weighted Jaccard similarity of
    their shingles of `least` or more; kept marks that document. Words are runs without white space, lower-cased. A null
    text, or one without words, is a class of its own, as is a row without doc_id. Rows that repeat a doc_id fall in one class.
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(signatures(docs, size, bands, rows))
    usable = signed.where(F.col("copy").isNotNull() & F.col("doc_id").isNotNull())
    members = cut(usable.groupBy("copy").agg(F.min("doc_id").alias("member"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")))
    placed = members.select("member", F.posexplode("bands").alias("band", "key")).select("member", "band", F.xxhash64("band", "key").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = cut(placed.join(shared, "bucket"))
    wanted = buckets.select("member").distinct()
    texts = cut(docs.join(wanted, docs["doc_id"] == wanted["member"]).groupBy("member").agg(F.max("text").alias("text")))
    state, named = buckets.withColumn("class", F.col("member")), members.select("copy", F.col("member").alias("class"))
    for turn in range(TURNS):
        # A pivot of each lane; lanes and pivots are dealt by hash, so that no bucket is gathered to choose them.
        lanes, order = 2**turn, F.xxhash64("bucket", "member") if turn else F.lit(0)
        lane, pivot = F.pmod(F.xxhash64("member", "bucket"), F.lit(lanes)), F.struct(order.alias("order"), "member", "class")
        chosen = [F.min(F.when(lane == k, pivot)) for k in range(lanes)]
        open_ = state.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.array_compact(F.array(*chosen)).alias("pivots")).where("least < most")
        round_ = cut(state.join(open_.select("bucket", "pivots"), "bucket"))
        pairs = round_.select("member", "class", F.explode(F.expr("filter(pivots, p -> p.class <> class)")).alias("pivot"))
        pairs = pairs.select(F.greatest("member", "pivot.member").alias("a"), F.least("member", "pivot.member").alias("b"), F.col("class").alias("class_a"), F.col("pivot.class").alias("class_b"))
        # a pair's classes are the same in each of its buckets, but for their order
        pairs = pairs.select("a", "b", F.greatest("class_a", "class_b").alias("class_a"), F.least("class_a", "class_b").alias("class_b")).distinct()
        roots = components(cut(verify(pairs, texts, size, least)))
        state = renamed(round_.where("not exists(pivots, p -> p.member = member)").select("member", "band", "bucket", "class"), roots)
        named = renamed(named, roots)
    roots = components(cut(linked(state, members, texts, bands * rows, size, least)))
    members = renamed(named, roots).select("copy", "class")
    out = signed.join(members, "copy", "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without those that near_classes() doesn't keep: one document of each class stays. Columns of any name pass through.

    Where ids are null or repeat, rows are told apart by numbers of their own, and the first row of a class stays."""
    own, names = positional(docs, "doc_id", "text")
    ids = own.groupBy(names["doc_id"]).count().where((F.col("count") > 1) | F.col(names["doc_id"]).isNull())
    if ids.isEmpty():
        rows = own.withColumn("id", F.col(names["doc_id"]).cast("long"))
    else:
        rows = cut(own.withColumn("id", F.monotonically_increasing_id()))
    classes = near_classes(rows.select(F.col("id").alias("doc_id"), F.col(names["text"]).alias("text")), **options)
    gone = classes.where(~F.col("kept")).select(F.col("doc_id").alias("id"))
    return rows.join(gone, "id", "left_anti").select(*own.columns).toDF(*docs.columns)
