"""Language of texts, word by word, by a linear-chain conditional random field.

Each word of a text has a label. Its scores come from the word itself, its affixes and its character n-grams; learned
transitions join neighbours, so that a text which switches languages gets runs of labels. Forward-backward gives
each word's label probabilities; a text's language is the one with the highest mean over its words.

The field is trained on a bounded sample of labelled rows: at most `SAMPLE` rows of each language, the one of lowest hash of id and text in each of `SAMPLE` shares.
Runs of words from these, RUN words long on average, are joined into SEQUENCES sequences of LENGTH words that switch language,
labelled run by run, and the conditional likelihood of the labels is climbed by Adam in STEPS steps. Features that these
sequences show less than SEEN times are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import on_workers, pick, positional

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows of each language that training sees, and what it makes of them; fixed, whatever the size of the table.
SAMPLE = 200
SEQUENCES, LENGTH, STEPS, RUN, SEEN = 1200, 48, 80, 12, 3
#: Words scored together, and words remembered by a task.
TOGETHER, REMEMBERED = 200_000, 300_000


def held_out(doc_id: Column) -> Column:
    """The quarter of rows that training never sees; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def features(word: str) -> list[str]:
    """The word, affixes of 1 to 3 characters, and n-grams of 3 inside it."""
    out = [f"={word}", f"^{word[:1]}", f"^{word[:2]}", f"^{word[:3]}", f"{word[-1:]}$", f"{word[-2:]}$", f"{word[-3:]}$"]
    out += [word[i : i + 3] for i in range(len(word) - 2)]
    return out


@dataclass
class Field:
    """A trained field: labels, weights of features, transitions and starts (log scores)."""

    labels: list[str]
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words, each row scaled to a highest of 1 (exponentiated)."""
        get, flat, sizes = self.index.get, [], []
        for w in words:
            found = [i for f in features(w) if (i := get(f)) is not None] or [0]
            flat += found
            sizes.append(len(found))
        if not words:
            return np.zeros((0, len(self.labels)))
        s = np.add.reduceat(self.weights[np.array(flat)], np.r_[0, np.cumsum(sizes)[:-1]], axis=0).astype(np.float64)
        return np.exp(s - s.max(axis=1, keepdims=True))

    def marginals(self, emitted: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Label probabilities of all words: emitted has the rows of texts one after the other; text k's begin at starts[k].

        Texts advance together, longest first, so each step is one small product for all that are as long.
        """
        order = np.argsort(-sizes, kind="stable")
        begin, long = starts[order], sizes[order]
        steps = int(long[0]) if len(long) else 0
        active = np.searchsorted(-long, -np.arange(steps), side="left")  # texts longer than t
        move, first = np.exp(self.transitions), np.exp(self.starts)
        forward = np.empty_like(emitted)
        a = np.zeros((0, emitted.shape[1]))
        for t in range(steps):
            at = begin[: active[t]] + t
            a = emitted[at] * (first if not t else a[: active[t]] @ move)
            a /= a.sum(axis=1, keepdims=True)
            forward[at] = a
        back = np.ones((0, emitted.shape[1]))
        for t in range(steps - 1, -1, -1):
            n = active[t]
            at = begin[:n] + t
            if len(back) < n:
                back = np.vstack([back, np.ones((n - len(back), emitted.shape[1]))])
            g = forward[at] * back
            forward[at] = g / g.sum(axis=1, keepdims=True)
            back = (back * emitted[at]) @ move.T
            back /= back.sum(axis=1, keepdims=True)
        return forward


def train(texts: list[str], langs: list[str], seed: int = 7) -> Field:
    """A field from labelled whole texts; without any, one that knows no label."""
    labels = sorted(set(langs))
    if not labels:
        return Field([])
    rng, k = np.random.default_rng(seed), len(labels)
    by_label = [[w for t, g in zip(texts, langs, strict=True) if g == lab and len(w := WORD.findall(t.lower())) > 0] for lab in labels]
    if not any(by_label):
        return Field([])
    usable = [i for i in range(k) if by_label[i]]
    words, tags = [], []
    while len(words) < SEQUENCES * LENGTH:
        lab = usable[rng.integers(len(usable))]
        doc = by_label[lab][rng.integers(len(by_label[lab]))]
        n = min(1 + int(rng.geometric(1 / RUN)), len(doc))
        at = int(rng.integers(len(doc) - n + 1))
        words += doc[at : at + n]
        tags += [lab] * n
    words, y = words[: SEQUENCES * LENGTH], np.array(tags[: SEQUENCES * LENGTH]).reshape(SEQUENCES, LENGTH)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([vocabulary[w] for w in words]).reshape(SEQUENCES, LENGTH)
    counts = Counter(words)
    of_word = [features(w) for w in vocabulary]
    seen: Counter[str] = Counter()
    for w, fs in zip(vocabulary, of_word, strict=True):
        for f in set(fs):
            seen[f] += counts[w]
    # rarer features than this would only name single words; row 0 is of words without any
    index = {f: i for i, f in enumerate((f for f, n in sorted(seen.items()) if n >= SEEN), 1)}
    flat, sizes = [], []
    for fs in of_word:
        found = [index[f] for f in fs if f in index] or [0]
        flat += found
        sizes.append(len(found))
    flat, bounds = np.array(flat), np.r_[0, np.cumsum(sizes)[:-1]]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    w, a, s = np.zeros((len(index) + 1, k)), np.zeros((k, k)), np.zeros(k)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, a, s)]
    hot, total = np.eye(k)[y], SEQUENCES
    seen_moves = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    for step in range(1, STEPS + 1):
        score = np.add.reduceat(w[flat], bounds, axis=0)
        e = np.exp(score - score.max(axis=1, keepdims=True))[x]
        move, first = np.exp(a), np.exp(s)
        alpha, scale = np.empty_like(e), np.empty((SEQUENCES, LENGTH, 1))
        for t in range(LENGTH):
            p = e[:, t] * (first if not t else alpha[:, t - 1] @ move)
            scale[:, t] = p.sum(axis=1, keepdims=True)
            alpha[:, t] = p / scale[:, t]
        beta = np.ones_like(e)
        for t in range(LENGTH - 2, -1, -1):
            beta[:, t] = (beta[:, t + 1] * e[:, t + 1]) @ move.T / scale[:, t + 1]
        gamma = alpha * beta
        after = e[:, 1:] * beta[:, 1:] / scale[:, 1:]
        moves = move * np.einsum("nti,ntj->ij", alpha[:, :-1], after)
        per_word = np.zeros((len(sizes), k))
        np.add.at(per_word, x.ravel(), (hot - gamma).reshape(-1, k))
        gw = np.zeros_like(w)
        np.add.at(gw, flat, per_word[owner])
        for p, g, (m, v) in zip((w, a, s), (gw / total - 1e-4 * w, (seen_moves - moves) / total, (hot[:, 0] - gamma[:, 0]).sum(axis=0) / total), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(labels, index, w.astype(np.float32), a, s)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Train on text and lang of docs(doc_id, text, lang) outside the held-out quarter; null langs and texts teach nothing."""
    rows = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("lot", F.xxhash64("doc_id", "text"))
    # of each language and each of `sample` shares of its rows the least lot: an aggregate, in which no language is ranked in one task
    few = rows.groupBy("lang", F.pmod(F.xxhash64("lot"), F.lit(sample)).alias("share")).agg(F.min("lot").alias("lot"))
    lots = sorted({r["lot"] for r in few.select("lot").collect()})  # at most `sample` of a language
    got = sorted((r["lang"], r["text"]) for r in rows.where(F.col("lot").isin(lots)).select("lang", "text").distinct().collect()) if lots else []
    return train([t for _, t in got], [g for g, _ in got])


class Labeller:
    """Languages of texts, with the scores of words remembered."""

    def __init__(self, model: Field):
        self.model, self.rows = model, {}
        self.scores = np.zeros((0, len(model.labels)))

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        pending: list[list[str]] = []
        size = 0
        for text in texts:
            words = WORD.findall(text.lower()) if text else []
            if words and not any(map(str.isalpha, words)):
                words = [w for w in words if any(map(str.isalpha, w))]
            pending.append(words)
            size += len(words)
            if size >= TOGETHER:
                yield from self.label(pending)
                pending, size = [], 0
        yield from self.label(pending)

    def label(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        k = len(self.model.labels)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not k or not sizes.sum():
            return out
        if len(self.rows) > REMEMBERED:
            self.rows, self.scores = {}, self.scores[:0]
        rows, words = self.rows, [w for t in texts for w in t]
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            self.scores = np.vstack([self.scores, self.model.emissions(new)])
        emitted = self.scores[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        mean = np.add.reduceat(self.model.marginals(emitted, starts, sizes[full]), starts, axis=0) / sizes[full, None]
        best = mean.argmax(axis=1)
        for i, b, p in zip(full, best, mean.max(axis=1), strict=True):
            out[i] = self.model.labels[b], float(min(1.0, p))
        return out


def label_languages(docs: DataFrame, model: Field) -> DataFrame:
    """docs with two more columns, lang_pred and score (0 to 1). Only `text` is looked at.

    A text that is null or has no letter is `und` with score 0, as is any if the field knows no label. Every row gives a row;
    repeated rows and other columns pass through. Columns that docs already has by these names are replaced.
    """
    out = _labelled(docs, model)
    kept = [(i, c) for i, c in enumerate(docs.columns) if c not in ("lang_pred", "score")]
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in kept], "lang_pred", "score")


def _labelled(docs: DataFrame, model: Field) -> DataFrame:
    """docs with its columns called _c0, _c1 ..., and lang_pred and score."""
    rows, names = positional(docs, "text")
    at = rows.columns.index(names["text"])
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    arrow_names = [*rows.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            found = list(labeller(batch.column(at).to_pylist()))
            columns = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=arrow_names)

    return on_workers(rows, run, schema)


def identify_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): doc_id, held_out, lang_pred, score, by a field fitted on docs itself."""
    out = label_languages(pick(docs, "doc_id", "text"), fit(docs, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.35, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows whose text has no letter or no language of a mean probability of `least`. Columns of any name pass
    through as they are."""
    out = _labelled(docs, fit(docs, sample)).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return out.drop("lang_pred", "score").toDF(*docs.columns)
