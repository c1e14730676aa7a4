"""The queries of the corpus operators: each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, prefix_trie, url_filter
from .common import LOWER, UPPER, table
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .language_id import identify_languages
from .media_chunks import store_and_read
from .mixing import mix
from .near_dedup import near_classes
from .pii import find_pii
from .piece_tokens import encode_documents
from .simhash import simhash_components
from .token_rollup import token_totals
from .url_filter import judge_urls


def piece_model() -> str:
    """Where the public piece vocabulary lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_totals(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents"))


def op10_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), piece_model())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def _url_sql() -> str:
    """op2_url_filter in SQL: rules, template tree, merged branches and purity."""
    fits = {
        r: (said, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')")
        for said, r in url_filter.RULES
        for h, _, p in [r.partition("/")]
    }
    order = sorted(fits, key=len, reverse=True)
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits[r][1]} THEN '{pick(r)}'" for r in order) + " END"
    k, z, deep = url_filter.PRIOR, url_filter.Z, 6  # the given tables have no longer paths
    levels = ""
    for at in range(1, deep + 1):
        levels += f"""
        d{at} AS (SELECT *, shape[{at}] AS seg FROM t{at - 1} WHERE len(shape) >= {at}),
        v{at} AS (SELECT host, node, seg, sum(n) AS n, sum(bad) AS bad, sum(told) AS told, max(purity) AS above FROM d{at} GROUP BY ALL),
        w{at} AS (SELECT host, node, TRUE AS wild FROM v{at} WHERE seg <> '*' GROUP BY ALL
            HAVING count(*) >= {url_filter.FANOUT} AND sum(n) < {url_filter.REPEATS} * count(*)),
        x{at} AS (SELECT v{at}.*, CASE WHEN wild THEN '*' ELSE seg END AS child FROM v{at} LEFT JOIN w{at} USING (host, node)),
        c{at} AS (SELECT host, node, child, sum(bad) AS b, sum(told) AS t, max(above) AS above FROM x{at} GROUP BY ALL),
        e{at} AS (SELECT *, sum(b) OVER (PARTITION BY host, node) AS eb, sum(t) OVER (PARTITION BY host, node) AS et FROM c{at}),
        g{at} AS (SELECT *, CASE WHEN t = 0 OR et = t OR abs(b / greatest(t, 1) - (eb - b) / greatest(et - t, 1)) <= {z} * sqrt(
            (eb / greatest(et, 1)) * (1 - eb / greatest(et, 1)) * (1 / greatest(t, 1) + 1 / greatest(et - t, 1))) THEN '*' ELSE child END AS merged FROM e{at}),
        n{at} AS (SELECT host, node, merged, (sum(b) + {k} * max(above)) / (sum(t) + {k}) AS below FROM g{at} GROUP BY ALL),
        m{at} AS (SELECT x.host, x.node, x.seg, g.merged, n.below FROM x{at} x JOIN g{at} g USING (host, node, child)
            JOIN n{at} n ON n.host = g.host AND n.node = g.node AND n.merged = g.merged),
        t{at} AS (SELECT host, shape, n, bad, told, node, purity FROM t{at - 1} WHERE len(shape) < {at}
            UNION ALL SELECT host, shape, n, bad, told, node || '/' || merged, below FROM d{at} JOIN m{at} USING (host, node, seg)),"""
    return rf"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        r AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
            regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
        s AS (SELECT *, {case(lambda r: r)} AS rule, {case(lambda r: fits[r][0])} AS said,
            list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END) AS shape FROM r),
        q AS (SELECT * FROM s),
        shapes AS (SELECT host, shape, count(*) AS n, count(*) FILTER (said = 'block') AS bad, count(said) AS told FROM q GROUP BY ALL),
        h AS (SELECT host, (sum(bad) + {k} * (SELECT CASE WHEN sum(told) > 0 THEN sum(bad)::DOUBLE / sum(told) ELSE 0 END FROM shapes))
            / (sum(told) + {k}) AS purity FROM shapes GROUP BY ALL),
        t0 AS (SELECT shapes.*, '' AS node, h.purity FROM shapes JOIN h USING (host)),{levels}
        f AS (SELECT host, node, (sum(bad) + {k} * max(purity)) / (sum(told) + {k}) AS ends FROM t{deep} GROUP BY ALL)
        SELECT page_id, q.host, path, rule, coalesce(said, CASE WHEN round(ends, 9) >= {url_filter.REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
            CASE WHEN t.node = '' THEN '/' ELSE t.node END AS template, round(ends, 9) AS purity
        FROM q JOIN t{deep} t ON t.host = q.host AND t.shape = q.shape JOIN f ON f.host = t.host AND f.node = t.node"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_text, op2_url_filter, op3_pii, op4_language_id, op5_token_counts, op6_exact_dedup, op7_near_dedup, op8_mix_sources, op9_media_chunks, op10_piece_tokens,
        op11_source_divergence, op12_prefix_trie, op13_simhash_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": _url_sql(),
    "op5_token_counts": r"""
        WITH squeezed AS (SELECT source, lang, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS text FROM documents),
        kept AS (SELECT * FROM squeezed WHERE text <> ''),
        counts AS (
            SELECT source, lang, 'words-1' AS tokenizer, len(string_split(text, ' ')) AS n_tokens, length(text) AS n_chars FROM kept
            UNION ALL
            SELECT source, lang, 'utf8-bytes-1', strlen(text), length(text) FROM kept)
        SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(n_chars) AS BIGINT) AS n_chars
        FROM counts GROUP BY ALL""",
    "op6_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)""",
    "op11_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        w AS (SELECT doc, lang, source, unnest(words) AS term FROM d),
        kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= {divergence.LEAST}),
        n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        a AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, coalesce(sum(n) OVER (PARTITION BY lang, source), 0)::HUGEINT AS total FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
        l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY ALL),
        b AS (SELECT lang, term, n, (sum(n) OVER (PARTITION BY lang))::HUGEINT AS total FROM l),
        p AS (SELECT lang, source, term, n, 1 + ({divergence.SCALE}::HUGEINT * (n + 2)) // (total + 2 * v) AS p FROM a JOIN v USING (lang)),
        q AS (SELECT lang, term, 1 + ({divergence.SCALE}::HUGEINT * (n + 2)) // (total + 2 * v) AS q FROM b JOIN v USING (lang)),
        f AS (SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        x AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
        pairs AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(x.value, 0) AS value FROM g JOIN g o ON o.lang = g.lang AND o.source <> g.source
            LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = o.source),
        every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM f),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}""",
    "op12_prefix_trie": f"""
        WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS turns FROM o GROUP BY ALL),
        crc AS (SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, 8 * length(conv_id::VARCHAR)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substring(conv_id::VARCHAR, i // 8 + 1, 1)) ELSE 0 END::BIGINT)),
            lambda was, byte: CASE WHEN xor(was, byte) & 1 = 1 THEN xor(xor(was, byte) >> 1, 3988292384) ELSE xor(was, byte) >> 1 END), 4294967295) AS crc FROM c),
        r AS (SELECT crc.conv_id, list_concat(coalesce(base.turns, [])[1:crc % {prefix_trie.SHARED}], crc.turns[crc % {prefix_trie.SHARED} + 1:]) AS turns
            FROM crc LEFT JOIN c AS base ON base.conv_id = crc.conv_id - crc.conv_id % {prefix_trie.HUNDRED}),
        m AS (SELECT conv_id, len(turns) AS length, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
        k AS (SELECT conv_id, length, depth, sha256(turns[1:depth]::VARCHAR) AS node, CASE WHEN depth > 0 THEN sha256(turns[1:depth - 1]::VARCHAR) END AS up, CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS n_chars FROM m),
        n AS (SELECT depth, node, up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n_chars) AS saved, string_agg(CASE WHEN length = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ended FROM k GROUP BY ALL),
        i AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.up = n.node AND x.depth = n.depth + 1) AS n_children FROM n),
        e AS (SELECT k.depth, k.node, sum((i.n_children = 0)::BIGINT) AS n_leaves, sum(i.saved) AS saved_tokens
            FROM i JOIN k AS t ON t.conv_id = i.conv_id AND t.depth = i.depth JOIN k ON k.conv_id = i.conv_id AND k.depth <= i.depth GROUP BY ALL)
        SELECT i.conv_id, i.depth, p.conv_id AS parent_conv_id, i.n_convs, i.n_children, e.n_leaves::BIGINT AS n_leaves, e.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(i.ended, '')) AS ends_sha256
        FROM i JOIN e ON e.depth = i.depth AND e.node = i.node LEFT JOIN i AS p ON p.depth = i.depth - 1 AND p.node = i.up""",
}
