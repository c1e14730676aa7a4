"""The pipeline's stages against brute force, on a table of the usual shape."""

import hashlib
from collections import Counter

import sentencepiece

import corpus_pipeline
from tests.llm.test_operators import LONG, bag, lower, mix_by_hand, prose
from tramline.llm import mixing
from tramline.llm.queries import piece_model


def test_stages(spark):
    rows = [(i, prose(60 + i, i), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, rows[3][1].upper(), "en", "s0", 1), (101, rows[4][1] + " more", "en", "s1", 1), (102, None, "en", "s1", 0), (103, "123", None, "s1", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    functions = dict(corpus_pipeline.STAGES)
    assert list(functions) == ["language", "exact", "near", "mixing", "tokens"]
    known = functions["language"](spark, docs, "")
    assert sorted(r["doc_id"] for r in known.collect()) == sorted(r[0] for r in rows if r[0] not in (102, 103)) and known.columns == docs.columns
    exact = functions["exact"](spark, known, "")
    assert {r["doc_id"] for r in exact.collect()} == {r[0] for r in rows} - {3, 102, 103} and exact.columns == docs.columns
    near = functions["near"](spark, exact, "")
    left = {r["doc_id"]: r for r in near.collect()}
    assert set(left) == {r[0] for r in rows} - {3, 101, 102, 103} and near.columns == docs.columns
    mixed = functions["mixing"](spark, near, "")
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 2 and set(times) <= set(left) and mixed.columns == docs.columns
    tokens = functions["tokens"](spark, mixed, "").collect()
    assert Counter(r["doc_id"] for r in tokens) == times


def test_rows_without_or_with_shared_ids(spark):
    """One row of every distinct text stays, and each row is mixed for itself, whatever its id."""
    rows = [(None, f"lost text {i}", "en", "s", 1) for i in range(4)] + [(None, "LOST text 1", "en", "s", 1), (7, "one text", "en", "s", 1), (7, "another text of seven", "en", "s", 1), (7, "one text", "en", "s", 1), (6, "One Text", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    functions = dict(corpus_pipeline.STAGES)
    exact = functions["exact"](spark, docs, "")
    assert sorted((r["doc_id"] or 0, lower(r["text"])) for r in exact.collect()) == [(0, f"lost text {i}") for i in range(4)] + [(7, "another text of seven"), (7, "one text")]
    # lots of one text with 64 words or so, of which a budget takes some rows and leaves others
    words = [(None, " ".join([f"w{i}"] * 64), "en", "s", 1) for i in range(10)] + [(3, " ".join([f"v{i}"] * 32 * (1 + i)), "en", "s", 1) for i in range(4)]
    docs = spark.createDataFrame(words, "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixing.mix(docs, share=0.5).collect()
    want = Counter((r["doc_id"], r["size"], int(r["taken"] / r["size"] + 0.5)) for r in plan)
    got = Counter((r["doc_id"], r["text"]) for r in mixing.apply_mix(docs, share=0.5).collect())
    assert Counter((w[0], len(w[1].split()), got[w[0], w[1]]) for w in words) == want and len(set(got.values()) | {0}) > 1
    assert any(n == 0 for _, _, n in want) and any(n > 0 for _, _, n in want)


def by_hand(spark, rows):
    """doc_id, n_tokens and digests of what the five stages leave of rows(doc_id, text, lang, source), all of whose words are of known languages."""
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    last = {}
    for i, r in enumerate(left):
        best = last.get(lower(r[1]))
        last[lower(r[1])] = i if best is None or (r[0] is not None, r[0] or 0) > (left[best][0] is not None, left[best][0] or 0) else best
    left = sorted((left[i] for i in last.values()), key=lambda r: (r[0] is not None, r[0] or 0))
    root = list(range(len(left)))
    bags = [bag(r[1]) for r in left]
    for i, x in enumerate(bags):
        for j, y in enumerate(bags[:i]):
            if sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                a, b = root[i], root[j]
                root = [min(a, b) if k in (a, b) else k for k in root]
    left = [r for i, r in enumerate(left) if root[i] == i]
    plan = mix_by_hand(spark, [(r[0], r[3], r[1]) for r in left], mixing.BLOCK_WORDS, mixing.SHARD_DOCS)
    times = {(d, size): int(taken / size + 0.5) for d, size, taken in plan}
    sp, out = sentencepiece.SentencePieceProcessor(model_file=piece_model()), Counter()
    for d, text, *_ in left:
        ids = sp.encode(text)
        out[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += times[d, len(text.split())]
    return +out


def run_on(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, size string, copy string, at string, digest string"
    spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "x", "x", "x", "x", "x") for r in rows], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, str(folder))
    return Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())


def test_run_against_brute_force(spark, tmp_path):
    rows = [(i, prose(60 + i, i), "en", f"s{i % 3}" if i % 7 else None) for i in range(60)]
    rows += [(100, rows[3][1].upper(), "en", "s0"), (101, rows[4][1] + " more", None, "s1"), (102, None, "en", "s1"), (103, "123", None, "s1"), (104, "", "en", "s0"), (105, LONG, "en", "s2"), (100, rows[3][1].upper(), "en", "s0")]
    assert run_on(spark, tmp_path, rows) == by_hand(spark, rows)


def test_run_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(None if i % 2 else i % 5, prose(60 + i, i), "en", "s") for i in range(20)]
    got, want = run_on(spark, tmp_path, rows), by_hand(spark, rows)
    assert got == want and any(k[0] is None for k in got)


def test_run_on_an_empty_table(spark, tmp_path):
    assert run_on(spark, tmp_path, []) == Counter()
