"""Source divergence, conversation prefix trie and SimHash against brute force, on small and awkward tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tramline.llm import divergence, prefix_trie, simhash

DOCS = "doc_id long, text string, lang string, source string, TEXT string, term string, n long, `rank` int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
lower = lambda t: t.encode().lower().decode()


def documents(seed, n=220):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeÄñß日") for _ in range(r.randint(1, 4))) for _ in range(60)]
    rows = []
    for k in range(n):
        text = r.choice(["", " ", None, "1 2 3 _"]) if r.random() < 0.1 else "".join(r.choice(words).title() + r.choice(" .,\n1_\x00") for _ in range(r.choice([1, 3, 12, 40])))
        rows.append((k, text, r.choice(["en", "en", "de", None, ""]), r.choice(["a", "b", "B", "ä", None]), "x", "y", 1, 2))
    rows += [(k, "Common words here", "en", "a", "x", "y", 1, 2) for k in range(30)]  # copies, with repeated ids
    rows += [(900, "once", "fr", "only", "x", "y", 1, 2), (None, None, "xx", "u", "x", "y", 1, 2), (None, "", "xx", "v", "x", "y", 1, 2)]
    return rows


def divergences(rows, least=10, top=10):
    docs = [(d[2] or "", d[3] or "", Counter(TERM.findall(lower(d[1] or "")))) for d in rows]
    out, freq = [], Counter()
    for lang, _, c in docs:
        freq.update((lang, t) for t in c)
    kept = defaultdict(set)
    for (lang, t), n in freq.items():
        if n >= least:
            kept[lang].add(t)
    counts = defaultdict(Counter)
    for lang, source, c in docs:
        for key in ((lang, source), (lang, None)):
            counts[key].update({t: n for t, n in c.items() if t in kept[lang]})
    total = {k: sum(c.values()) for k, c in counts.items()}
    p = lambda key, t: 1 + 10**9 * (counts[key][t] + 2) // (total[key] + 2 * len(kept[key[0]]))
    f = lambda x, y: (x - y) ** 2 // (x + y)
    for lang, source in {(x, s) for x, s in counts if s is not None}:
        others = {s for x, s in counts if x == lang and s not in (None, source)}
        pairs = [(s, sum(f(p((lang, source), t), p((lang, s), t)) for t in kept[lang])) for s in others]
        terms = [(t, f(p((lang, source), t), p((lang, None), t))) for t in kept[lang] if counts[lang, source][t] and p((lang, source), t) > p((lang, None), t)]
        for part, found in (("pair", pairs), ("term", terms)):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_divergence(spark, seed):
    rows = documents(seed)
    got = divergence.audit(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got)) == divergences(rows) and len(got) > 60


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    two = [(1, None, None, "a", "", "", 1, 1), (2, "few", None, "b", "", "", 1, 1)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(two, DOCS)).collect())) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


@pytest.mark.parametrize("piece,held", [(1 << 22, 10**6), (40, 10**6), (7, 20)])
def test_terms_of_cut_texts(monkeypatch, piece, held):
    """Texts longer than a piece are cut at a blank, and their terms still count one document."""
    monkeypatch.setattr(divergence, "PIECE", piece)
    rows = [(x[2], x[3], x[1]) for x in documents(5)] + [("en", "a", "x" * 5000 + " y"), ("en", "a", "é" * 3000), ("en", "b", "same " * 300 + "Same")]
    batch = pa.RecordBatch.from_arrays([pa.array([x or "" for x in c], pa.string()) if k < 2 else pa.array(c, pa.string()) for k, c in enumerate(zip(*rows))], names=["lang", "source", "text"])
    got, want = Counter(), Counter()
    for table in divergence.tallies(iter([batch.slice(0, 50), batch.slice(50)]), held):
        for lang, source, term, n, docs in zip(*(c.to_pylist() for c in table.columns)):
            got[lang, source, term, "n"] += n
            got[lang, source, term, "docs"] += docs
    for lang, source, text in rows:
        for term, n in Counter(TERM.findall(lower(text or ""))).items():
            want[lang or "", source or "", term, "n"] += n
            want[lang or "", source or "", term, "docs"] += 1
    assert got == want


def test_sketch_never_underestimates(spark):
    """Every term in 10 documents passes, whatever the width; and a narrow sketch lets more pass, which counting drops later."""
    rows = documents(8, 500)
    texts = spark.createDataFrame([(x[2] or "", x[3] or "", x[1]) for x in rows], "lang string, source string, text string").repartition(7)
    freq = Counter((x[2] or "", t) for x in rows for t in set(TERM.findall(lower(x[1] or ""))))
    for width in (1 << 16, 1 << 18):
        got = {(x.lang, x.term) for x in divergence.term_counts(texts, width, 10).collect()}
        assert {k for k, n in freq.items() if n >= 10} <= got
    monkey = divergence.term_counts(texts, 1 << 16, 1)
    assert {(x.lang, x.term) for x in monkey.collect()} == set(freq)


CONVS = "conv_id long, turn long, role string, text string, CONV_ID string, depth long, `class` int"


def trie(rows):
    """All nodes, from whole sequences of turns."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in nodes if k)
    out = []
    for k, members in nodes.items():
        below = [(x, m) for x, m in nodes.items() if x[: len(k)] == k]
        ended = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], sum(not children[x] for x, _ in below), sum((len(m) - 1) * (len(x[-1][1]) if x else 0) for x, m in below), hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def conversations(seed):
    r = random.Random(seed)
    rows, texts = [], ["hi", "Hi", "", None, "a\nb", "é日"]
    for c in [*range(0, 9), 100, 101, 177, 305, 306, -5, -100, -101, -107]:
        for k in range(r.choice([1, 2, 4, 7])):
            rows.append((c, r.choice([k, k, None, 0]), r.choice(["user", "assistant", None, ""]), r.choice(texts[:2] if k < 2 else texts), "x", 1, 2))
    rows += [(c, k, "user", f"turn {k}", "x", 1, 2) for c in (700, 701, 702, 703, 2000) for k in range(9)]  # copies
    rows += [(701, 3, "user", "turn 3", "x", 1, 2)] * 2 + [(None, 1, "user", "lost", "x", 1, 2)]  # repeated rows; no conversation
    rows += [(5000, None, "user", "same", "x", 1, 2)] * 40  # a long one, all tied
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_prefix_trie(spark, seed, monkeypatch):
    if seed:
        monkeypatch.setattr(prefix_trie, "RUN", 2)
    rows = conversations(seed)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVS).repartition(5)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert sorted(map(tuple, got), key=lambda x: (x[1], x[0])) == trie(rows)


def test_prefix_trie_edges(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVS)).collect() == []
    one = [(55, 1, "user", "x" * 100_000, "", 1, 1), (55, 0, None, None, "", 1, 1)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(one, CONVS)).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == trie(one)


def prints_of(texts):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0)
    return out


def components(prints, ids):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(least.get(root(i), x), x)
    return [least.get(root(i)) for i in range(len(prints))]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    """Whatever bits differ, up to the radius, some mask leaves them all out; also among the bits that a mask leaves."""
    for free in (list(range(64)), simhash.bits_of(simhash.masks(list(range(64)), radius)[0]), [3, 9, 11, 40, 41, 63]):
        cut = simhash.masks(free, radius)
        assert all(m for m in cut) and len(cut) == 2 ** (radius + 1) - 1 and not any(m & ~sum(1 << b for b in free) for m in cut)
        for bits in itertools.combinations(free, min(radius, len(free))):
            apart = sum(1 << b for b in bits)
            assert any(not m & apart for m in cut)


def test_fingerprints(spark, monkeypatch):
    texts = ["", None, " \t\x0b\n", "One", "one two", "ONE two three", "É x\x1cy z \x85w", "a b c d " * 50, "a  b\tc\nd"]
    want = prints_of(texts)
    assert [simhash.fingerprint((t or "").encode()) for t in texts] == want and want[0] == want[1] == want[2] == 0
    monkeypatch.setattr(simhash, "PIECE", 5)  # words of long texts are taken in pieces
    assert [simhash.fingerprint((t or "").encode()) for t in texts] == want
    # the same function as Spark's own, so that others can check it
    docs = spark.createDataFrame([("one two three",)], "text string").selectExpr("xxhash64(text) as h").first().h
    assert simhash.fingerprint(b"One two\nthree") == docs % 2**64


@pytest.mark.parametrize("small", [8, 256])
def test_components_of_many_prints(spark, small):
    """A dense ball, chains and scattered prints; buckets over `small` are cut further."""
    r = random.Random(small)
    center = r.getrandbits(64)
    prints = {center ^ sum(1 << b for b in r.sample(range(0, 22), r.randint(0, 6))) for _ in range(400)}
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            prints.add(x)
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
    prints = sorted(prints | {0, 2**64 - 1, 2**63, 7, 15})
    table = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    links = [(a % 2**64, b % 2**64) for a, b in simhash.linked(table, small=small).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    at = {p: k for k, p in enumerate(prints)}
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(root(at[a]), root(at[b]))] = min(root(at[a]), root(at[b]))
    assert [root(i) for i in range(len(prints))] == components(prints, range(len(prints)))


def test_simhash_components(spark):
    r = random.Random(1)
    base = " ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(300))
    texts = [None, "", "x", base, base.upper(), base + " tail", base.replace("aa", "bb", 1), *(" ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(60)) for _ in range(25)), base, "w " * 50_000]
    ids = [5, 3, 9, 40, 41, 42, 43, *range(100, 125), None, None]
    rows = [(i, t, "en", "s", "x", "y", 1, 2) for i, t in zip(ids, texts)] * 2  # all rows twice
    got = simhash.simhash_components(spark.createDataFrame(rows, DOCS), hot_share=4).collect()
    prints = prints_of(texts)
    want = [(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, components(prints, ids))]
    key = lambda x: str(tuple(x))
    assert sorted(map(tuple, got), key=key) == sorted(want * 2, key=key)
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        simhash.linked(spark.createDataFrame([(1,)], "print long"), small=4)


LONG_TEXT = "This is the text of an article and it has all of the words that one would need for it to be told from the rest of the page, as it is long and of many words. " * 2


@pytest.mark.parametrize(
    "wrapper",
    "<div class='layout has-sidebar'><article>%s</article></div>|<main class='content no-sidebar'>%s</main>|<article id='form-and-function'>%s</article>|<article class='post tag-social'>%s</article>|<div id='story-reader'>%s</div>"
    "|<article data-id='promo-123'>%s</article>|<article data-hidden='false'>%s</article>|<div title='a class=ad b'>%s</div>|<div class=x data-role='menu'>%s</div>|<body class='has-sidebar'><div class='page-with-menu'>%s</div>"
    "|<div hidden>%s</div>|<div style='visibility:hidden' class=overlay>%s</div>|<div class=sidebar-layout><div class=ads>Buy</div>%s</div>".split("|"),
)
def test_html_wrappers_keep_articles(wrapper):
    """Names of wrappers, of articles themselves and of other attributes empty no article."""
    from tramline.llm import html_text

    page = wrapper % f"<h1>A title</h1><p>{LONG_TEXT}</p><p>Short one.</p><p>{LONG_TEXT}</p>"
    assert html_text.main_text(page) == f"A title\n{LONG_TEXT.strip()}\nShort one.\n{LONG_TEXT.strip()}"


def test_html_comments_and_notices_go():
    from tramline.llm import html_text

    article = f"<article><h1>A title</h1><p>{LONG_TEXT}</p></article>"
    want = f"A title\n{LONG_TEXT.strip()}"
    for other in ("<div id=comments><article class=comment><p>%s</p></article></div>", "<div class=cookie-notice>%s</div>", "<div class=related><article>%s</article></div>", "<div aria-hidden=true>%s</div>", "<div class=sponsored><h2>Buy</h2><p>%s</p><p>Now</p></div>"):
        assert html_text.main_text(article + other % LONG_TEXT) == want == html_text.main_text(other % LONG_TEXT + article)
        assert html_text.main_text(f"<article><h1>A title</h1><p>{LONG_TEXT}</p>{other % LONG_TEXT}</article>") == want
    assert html_text.main_text(f"<article><h1>A title</h1><p>x</article><div class=ad>{LONG_TEXT}</div>") == "A title\nx"


def test_html_hints_weigh_no_more_than_densities():
    """Pass one by hand: any block, any containers."""
    from tramline.llm import html_text

    assert max(abs(html_text.NAMED), html_text.ARTICLE, abs(html_text.NAMED + html_text.ARTICLE)) <= html_text.GOOD
    r = random.Random(2)
    for _ in range(300):
        blocks = []
        for _ in range(r.randint(1, 8)):
            b = html_text.Block((0, r.choice([-3, -1, 0, 0, 2])))
            words = [r.choice(["the", "and", "of", "zebra", "quilt", "vortex", "mango"]) for _ in range(r.choice([1, 4, 20, 60]))]
            b.text, b.heading = " ".join(words), r.random() < 0.2
            b.linked = r.choice([0, 0, len(b.text.replace(" ", "")) // 2, len(b.text.replace(" ", ""))])
            blocks.append(b)
        points = []
        for b in blocks:
            n, words = len(b.text), b.text.split()
            stops, links = sum(w in ("the", "and", "of") for w in words) / len(words), b.linked / len("".join(words))
            x = b.hint + (1 if n >= 70 else 0) + (1 if n >= 200 else 0)
            if n >= 70:
                x += 1 if stops >= 0.3 else -2 if stops < 0.15 else 0
            points.append(x - (0 if links <= 0.34 else 4 if links > 0.9 and n >= 70 else 2))
        top = max(points)
        good = 3 if top >= 3 else max(0, top)
        want = ["good" if x >= good else "bad" if x < 0 else "near" if x > 0 and len(b.text) >= 70 else "short" for x, b in zip(points, blocks)]
        heading = [b.heading for b in blocks].index(True) if any(b.heading for b in blocks) else 0
        if not any(x == "good" for x in want[:heading]):
            want = ["bad" if k < heading and x == "short" and blocks[k].hint <= 0 else x for k, x in enumerate(want)]
        assert html_text.decide_alone(blocks) == want


def test_html_without_hints():
    """With every hint of the given pages taken away, blocks are told from boilerplate by densities and neighbours."""
    import os

    import pyarrow.parquet as pq

    from tramline.llm import html_text

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    right = wrong = lost = 0
    for page in pq.read_table(path)["html"].to_pylist():
        want = Counter(html_text.main_text(page).split("\n"))
        got = Counter(html_text.main_text((page or "").replace("<article", "<div").replace("</article", "</div").replace('class="ad"', "")).split("\n"))
        right, wrong, lost = right + (want & got).total(), wrong + (got - want).total(), lost + (want - got).total()
    assert right / (right + wrong) > 0.9 and right / (right + lost) > 0.9


def test_pii_needs_context():
    """Plain numbers without a word that tells what they are give nothing; the same forms with one are found."""
    from tramline.llm import pii

    r = random.Random(5)
    filler = [" ".join(r.choice(["the", "river", "goes", "by", "a", "mill", "and", "on"]) for _ in range(30)) + " mail ann@b.example.org or +1 555 010 9999 or 10.1.2.3 now" for _ in range(60)]
    model = pii.train(filler)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    added = lambda t: {k for k, *_ in set(pii.all_spans(t, model)[1]) - set(pii.base_spans(t))}
    plain = [lambda: f"population {d(3)} {d(3)} {d(4)} people", lambda: f"pages {d(3)}-{d(3)}-{d(4)}", lambda: f"row 0{d(2)} {d(6)} in the ledger", lambda: f"version {d(1)} . {r.randint(10, 99)} . {d(1)} . {d(1)}", lambda: f"a cost of {d(3)} {d(3)} {d(3)} dollars", lambda: f"at 40.{d(4)}, -74.{d(4)} near"]
    told = [(3, lambda: f"Please call {d(3)}-{d(3)}-{d(4)} today"), (3, lambda: f"phone 0{d(3)} {d(6)}"), (3, lambda: f"write to ({d(3)}) {d(3)}-{d(4)}"), (1, lambda: f"server {' . '.join(str(r.randint(1, 255)) for _ in range(4))} is down"), (0, lambda: "jane.doe(at)host[dot]com")]
    for make in plain:
        assert sum(bool(added(make())) for _ in range(100)) <= 5
    for kind, make in told:
        assert sum(kind in added(make()) for _ in range(100)) >= 90


def test_pii_sample_is_bounded(spark, monkeypatch):
    """However many rows share an id, training sees `sample` texts."""
    from tramline.llm import pii

    seen = []
    monkeypatch.setattr(pii, "train", lambda texts: seen.append(texts) or pii.SemiMarkov())
    rows = [(7, f"text {k} with 1 digit") for k in range(3000)] + [(8, "the same 2")] * 500 + [(None, "no id 3")]
    pii.fit(spark.createDataFrame(rows, "doc_id long, text string"), sample=3)
    assert 1 <= len(seen[0]) <= 3
