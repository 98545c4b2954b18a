"""The training-data operators as queries over the synthetic tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, license_scan, line_dedup, mtree, near_dedup, packing, prefix_trie, quality_classifier, quality_rules, simple8b, unigram, warc, whitening
from .common import table


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as Simple-8b shards and read back."""
    return simple8b.encode_documents(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of every document after white-space normalisation."""
    marked = exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template spans of every document."""
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and tokeniser fertility of every document."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of every document, with a round trip through the decoder."""
    return unigram.encode_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry scores of every document."""
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy repeats of every line of all documents."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_dup_components(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth embedding with all others."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def whitening_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of op13 alone, which SQL can express."""
    return op13_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base scan of op3 alone, which SQL can express."""
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op4 alone, which SQL can express."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict:
    return {f.__name__: f for f in (license_base, quality_base, op1_token_output, op2_exact_dedup, op3_license_scan, op4_quality_rules, op5_sentencepiece, op6_quality_classifier, op7_packing, op8_line_dedup, op9_near_dedup, op10_warc, op11_topk_search, op12_prefix_trie, op13_whitening, whitening_deviation)}


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_WORDS4 = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "license_base": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, len(w) AS n, list_filter(range(len(w)), lambda i: w[i+1] = 'mit' AND w[i+2] = 'license') AS m,
              list_filter(range(len(w)), lambda i: w[i+1] = 'apache' AND w[i+2] = 'license') AS a,
              list_filter(range(len(w)), lambda i: w[i+1] = 'general' AND w[i+2] = 'public' AND w[i+3] = 'license') AS g FROM t),
        q AS (SELECT *, list_concat(list_concat(m, a), g) AS x FROM p)
        SELECT doc_id, n AS n_words, len(x) AS n_base, list_min(x) AS first_word, list_max(x) AS last_word,
               concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels FROM q""",
    "quality_base": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS4} AS w FROM documents),
        l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM t WHERE len(w) >= 5),
        h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+4]) AS c FROM g),
        r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h WHERE c > 1) GROUP BY 1),
        f AS (SELECT t.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
              len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
              FROM t JOIN l ON t.doc_id = l.doc_id LEFT JOIN r ON t.doc_id = r.doc_id)
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f""",
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_NORM} AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op10_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
        u AS (SELECT page_id, octet_length(encode(p)) AS n, sha256(p) AS d, min(page_id) OVER (PARTITION BY p) AS first FROM t)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
        FROM u""",
    "op11_topk_search": """
        WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
              FROM x q JOIN x c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op12_prefix_trie": """
        WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(concat(octet_length(encode(role)), ':', role, text))) AS turns,
              xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                  lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda e, z: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295) % 9 AS h
              FROM o GROUP BY conv_id),
        r AS (SELECT c.conv_id, list_concat(coalesce(f.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM c LEFT JOIN c f ON f.conv_id = c.conv_id - c.conv_id % 5),
        m AS (SELECT conv_id, d, len(turns) = d AS ends, turns[1:d] AS k FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
        n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(octet_length(encode(k[d].text)), 0) AS saved,
              sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY k, d),
        p AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
        v AS (SELECT n.*, coalesce(p.n_children, 0) AS n_children, n.k[1:n.d - 1] AS up FROM n LEFT JOIN p ON n.k = p.k),
        a AS (SELECT k[1:e] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
              FROM (SELECT k, n_children, saved, unnest(range(0, d + 1)) AS e FROM v) GROUP BY 1)
        SELECT v.conv_id, v.d AS depth, CASE WHEN v.d > 0 THEN u.conv_id END AS parent_conv_id, v.n_convs, v.n_children, a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
        FROM v JOIN a ON v.k = a.k JOIN n u ON u.k = v.up""",
    "whitening_deviation": """
        WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        e AS (SELECT unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM (SELECT DISTINCT x FROM x)),
        t AS (SELECT list(s ORDER BY i) AS s, max(n) AS n FROM (SELECT i, sum(v) AS s, count(*) AS n FROM e GROUP BY i))
        SELECT vec_id, n, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (n * x[i] - s[i]) * (n * x[i] - s[i]))) AS BIGINT) AS deviation FROM x, t""",
}
