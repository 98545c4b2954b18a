"""SQL for DuckDB that says the same as the queries, by name."""

from __future__ import annotations

from .queries import ENDINGS

_TIDY = "trim(regexp_replace(regexp_replace(text, ' +(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10)||chr(10), 'g'), ' '||chr(10))"
_WORDS = "len(list_filter(string_split_regex(t, '[ \\n]+'), lambda w: w <> ''))"
_TOKENS = "regexp_extract_all(lower(translate(replace(replace(text, '''', ''), '’', ''), 'Σİ', 'σi')), '[\\p{L}\\p{Nd}]+')"
_CORPUS = f"""
    corpus AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, source, TIMESTAMP '2020-01-01' + to_days(CAST(n_chars // 10 AS INTEGER)) AS published, n_chars // 10 AS day, {_TIDY} AS t FROM documents),
    docs AS (SELECT *, {_WORDS} AS words FROM corpus)"""
_SHINGLES = f"""
    w AS (SELECT id, source, day, doc_id, regexp_extract_all(lower(translate(t, 'Σİ', 'σi')), '[\\p{{L}}\\p{{Nd}}'']+') AS w FROM docs),
    s AS (SELECT id, source, day, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w)"""
_PAIRS = """
    x AS (SELECT id, source, day, len(s) AS n, unnest(s) AS g FROM s),
    p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.source < b.source AND abs(a.day - b.day) <= 2 GROUP BY ALL),
    pairs AS (SELECT a, b, k / (na + nb - k) AS score FROM p WHERE k / (na + nb - k) >= 0.5)"""
_GROUPS = """
    e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    r(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
    roots AS (SELECT id, min(root) AS root FROM r GROUP BY id),
    m AS (SELECT d.id, d.source, roots.root, CAST(regexp_extract(d.source, '\\d+') AS INTEGER) AS priority FROM docs d JOIN roots USING (id)),
    mw AS (SELECT *, first_value(id) OVER (PARTITION BY root ORDER BY priority DESC, source, id) AS winner_id FROM m),
    sc AS (SELECT mw.id, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS score
           FROM mw JOIN s a ON a.id = mw.id JOIN s b ON b.id = mw.winner_id),
    members AS (SELECT mw.*, CASE WHEN mw.id = winner_id THEN 1.0 ELSE sc.score END AS score FROM mw JOIN sc USING (id))"""
_ENTRIES = """
    gone AS (SELECT winner_id, count(*) AS n FROM members WHERE id <> winner_id GROUP BY 1),
    entries AS (SELECT d.*, coalesce(g.n, 0) AS copies FROM docs d LEFT JOIN gone g ON g.winner_id = d.id WHERE d.id NOT IN (SELECT id FROM members WHERE id <> winner_id))"""
_LENGTH = "CASE WHEN words < 250 THEN 'short' WHEN words < 1000 THEN 'medium' ELSE 'long' END"
_DUPES = f"WITH RECURSIVE {_CORPUS}, {_SHINGLES}, {_PAIRS}, {_GROUPS}"
_LINES = "SELECT * FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS index FROM documents WHERE {where}) WHERE text <> ''"
_QUERY = ["and", "reason", "stable", "the", "thing"]


def _bm25(where: str = "true", passages: str = _LINES) -> str:
    terms = ", ".join(f"'{t}'" for t in _QUERY)
    return f"""
    ps AS ({passages.format(where=where)}),
    pt AS (SELECT source, doc_id, index, {_TOKENS} AS tk FROM ps),
    st AS (SELECT count(*) AS n, avg(len(tk)) AS mean FROM pt),
    tf AS (SELECT source, doc_id, index, len(tk) AS ln, q.term, len(list_filter(tk, lambda x: x = q.term)) AS f FROM pt, (SELECT unnest([{terms}]) AS term) q),
    df AS (SELECT term, count(*) AS df FROM tf WHERE f > 0 GROUP BY 1),
    sc0 AS (SELECT source, doc_id, index, list_sum(list(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * ln / mean)) ORDER BY term)) AS score
           FROM tf JOIN df USING (term), st WHERE f > 0 GROUP BY 1, 2, 3),
    lex AS (SELECT *, row_number() OVER (ORDER BY score DESC, source, doc_id, index) AS rank FROM sc0)"""


_FEED = "chr(10)||chr(10)"
_CHUNKS = f"""
    cd AS (SELECT doc_id, source, regexp_replace(replace(text, chr(10), {_FEED}), '([^\\n]{{400}})', '\\1'||{_FEED}, 'g') AS t FROM documents),
    cs AS (SELECT doc_id, source, string_split(t, {_FEED}) AS p FROM cd WHERE regexp_matches(t, '\\S')),
    cu AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM cs),
    cb AS (SELECT doc_id, i, octet_length(encode(x)) AS n, sum(octet_length(encode(x)) + 2) OVER (PARTITION BY doc_id ORDER BY i) - octet_length(encode(x)) - 2 AS b FROM cu),
    cq AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, i, b AS s, b + n AS e FROM cb WHERE n > 0),
    cr AS (SELECT doc_id, k, i, s, e, 0 AS c FROM cq WHERE k = 1
           UNION ALL SELECT q.doc_id, q.k, q.i, CASE WHEN q.e - r.s > 1200 THEN q.s ELSE r.s END, q.e, r.c + CASE WHEN q.e - r.s > 1200 THEN 1 ELSE 0 END FROM cr r JOIN cq q ON q.doc_id = r.doc_id AND q.k = r.k + 1),
    cg AS (SELECT doc_id, c, min(s) AS s, max(e) AS e, min(i) AS lo, max(i) AS hi FROM cr GROUP BY 1, 2),
    cm AS (SELECT g.*, CASE WHEN c > 0 AND c = max(c) OVER (PARTITION BY doc_id) AND octet_length(encode(trim(array_to_string(p[lo:hi], {_FEED}), chr(10)||' '))) < 200 THEN c - 1 ELSE c END AS k FROM cg g JOIN cs USING (doc_id)),
    chunks AS (SELECT doc_id, source, k AS index, s, e, trim(array_to_string(p[lo:hi], {_FEED}), chr(10)||' ') AS text
               FROM (SELECT doc_id, k, min(s) AS s, max(e) AS e, min(lo) AS lo, max(hi) AS hi FROM cm GROUP BY 1, 2) JOIN cs USING (doc_id))"""
_TITLED = f"SELECT source, CAST(doc_id AS VARCHAR) AS doc_id, index, CASE WHEN doc_id % 2 = 0 THEN 'The reason of '||source||{_FEED}||text ELSE text END AS text FROM chunks"
_MANY = f"""
    ps AS ({_LINES.format(where='true')}),
    pt AS (SELECT source, doc_id, index, {_TOKENS} AS tk FROM ps),
    st AS (SELECT count(*) AS n, avg(len(tk)) AS mean FROM pt),
    tf AS (SELECT source, doc_id, index, ln, term, count(*) AS f FROM (SELECT source, doc_id, index, len(tk) AS ln, unnest(tk) AS term FROM pt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    qt AS (SELECT DISTINCT query_id, unnest({_TOKENS}) AS term FROM (SELECT doc_id AS query_id, string_split(text, chr(10))[1] AS text FROM documents WHERE doc_id % 50 = 0)),
    sc0 AS (SELECT query_id, source, doc_id, index, list_sum(list(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * ln / mean)) ORDER BY term)) AS score
            FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2, 3, 4),
    lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, doc_id, index) AS rank FROM sc0)"""
_VECS = """
    vq AS (SELECT d.source, d.doc_id, 0 AS index, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
    vs AS (SELECT q.vec_id AS query_id, v.source, v.doc_id, v.index, list_dot_product(v.embedding, q.embedding) AS score FROM embeddings q, vq v WHERE {where}),
    vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, doc_id) AS rank FROM vs)"""
_SRC3 = "source = 'src3'"
_VEC = """
    qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7),
    vs AS (SELECT d.source, d.doc_id, 0 AS index, list_dot_product(e.embedding, q) AS score FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, qv),
    vec AS (SELECT *, row_number() OVER (ORDER BY score DESC, source, doc_id) AS rank FROM vs)"""
_FUSED = """
    fused AS (SELECT coalesce(l.source, v.source) AS source, coalesce(l.doc_id, v.doc_id) AS doc_id, CAST(coalesce(l.index, v.index) AS BIGINT) AS index, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + v.rank), 0) AS score,
              coalesce(l.rank, 0) AS lexical_rank, coalesce(v.rank, 0) AS vector_rank
              FROM (SELECT * FROM lex WHERE rank <= 200) l FULL OUTER JOIN (SELECT * FROM vec WHERE rank <= 200) v ON l.doc_id = v.doc_id AND l.source = v.source AND l.index = v.index)"""
_ROLLED = """
    best AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, source, index) = 1),
    o AS (SELECT *, row_number() OVER (ORDER BY score DESC, source, doc_id, index) AS place FROM best)"""


def _quoted(text: str) -> str:
    """Whether ``text``, with its words in ``words``, is a quotation."""
    credits = r"(?:\s*(?:https?://\S+|(?:RT|via)\s+@[0-9A-Za-z_]+))+\s*$"
    named = lambda first, never, n: f" *{first}[^ {never}]*(?: +[^ {never}]+){{{{0,{n - 1}}}}} *$".replace("{{", "{").replace("}}", "}")
    name = lambda n: named(r"\p{L}", "~?!", n)
    closing, dashes = "[.!?\"''\u201d\u2019]", "[-\u2013\u2014]"
    x = f"trim({text})"
    line = f"string_split(trim(regexp_replace({x}, '{credits}', '')), chr(10))[-1]"
    linked = f"contains(regexp_extract({x}, '{credits}'), 'http')"
    return f"""(words < 100 AND regexp_matches({text}, '[~\u2013\u2014-]') AND CASE WHEN contains({line}, '~')
        THEN CASE WHEN {linked} THEN regexp_matches({line}, '~{name(6)}') ELSE regexp_matches({line}, '~{name(10)}') END
        ELSE NOT {linked} AND regexp_matches({line}, '{closing} *-*{dashes}{named(r'\p{Lu}', '?!', 6)}') END)"""


def _spread(rows: str) -> str:
    return f"""
    WITH {rows}, u AS (SELECT source, v FROM v0 UNION ALL SELECT 'all', v FROM v0),
    g AS (SELECT source, list_sort(list(v)) AS l, count(*) AS n, sum(v) AS s FROM u GROUP BY 1)
    SELECT source, CAST(l[1] AS BIGINT) AS min, CAST(l[n * 50 // 100 + 1] AS BIGINT) AS p50, CAST(l[n * 90 // 100 + 1] AS BIGINT) AS p90, CAST(l[n * 99 // 100 + 1] AS BIGINT) AS p99,
           CAST(l[n] AS BIGINT) AS max, CAST(s // n AS BIGINT) AS mean FROM g"""


ORACLES: dict[str, str] = {
    "normalise_text": """
        WITH d AS (SELECT doc_id, nfc_normalize(chr(13)||chr(10)||' '||chr(8203)||replace(replace(text, chr(10), chr(13)||chr(10)||' '||chr(13)||chr(10)||chr(13)||chr(10)||chr(13)||chr(10)), ' the ', chr(160)||'the '||chr(9)||chr(12288))||'e'||chr(769)||' '||chr(65279)||chr(10)||chr(10)) AS t FROM documents),
        a AS (SELECT doc_id, regexp_replace(replace(replace(t, chr(8203), ''), chr(65279), ''), '\\r\\n?', chr(10), 'g') AS t FROM d),
        b AS (SELECT doc_id, translate(t, chr(160)||chr(9)||chr(12288), '   ') AS t FROM a),
        c AS (SELECT doc_id, regexp_replace(regexp_replace(t, ' +\\n', chr(10), 'g'), '\\n{3,}', chr(10)||chr(10), 'g') AS t FROM b)
        SELECT doc_id, trim(t, ' '||chr(10)) AS text FROM c""",
    "document_identity": """
        WITH r AS (SELECT source, CAST(doc_id AS VARCHAR) AS k, text FROM documents UNION ALL SELECT 'chat', conv_id || ':' || turn, text FROM conversations)
        SELECT source, k, substr(sha256(source || chr(0) || k), 1, 16) AS id, sha256(text) AS content_hash, substr(sha256(source || chr(0) || 'sha256:' || sha256(text)), 1, 16) AS id_by_content FROM r""",
    "length_buckets": f"WITH a AS (SELECT {_TIDY} AS t FROM documents), b AS (SELECT {_WORDS} AS words FROM a) SELECT {_LENGTH} AS length, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM b GROUP BY 1",
    "even_sample": """
        WITH r AS (SELECT doc_id, substr(sha256(source || chr(0) || doc_id), 1, 16) AS id FROM documents), n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () // 37 AS step FROM r)
        SELECT doc_id, id FROM n WHERE k % step = 0 AND k // step < 37""",
    "quote_flags": f"WITH a AS (SELECT doc_id, {_TIDY} AS t FROM documents), b AS (SELECT doc_id, t, {_WORDS} AS words FROM a) SELECT doc_id, " + ", ".join(f"{_quoted('t || ' + chr(39) + end + chr(39))} AS {name}" for name, end in ENDINGS.items()) + " FROM b",
    "documents_build": """
        SELECT substr(sha256('chat' || chr(0) || conv_id || ':' || turn), 1, 16) AS id, 'a.json' AS file, role AS title, 'Someone' AS author, sha256(text) AS content_hash,
               CAST(len(list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> '')) AS BIGINT) AS words FROM conversations WHERE text <> ''""",
    "dupes_summary": f"{_DUPES} SELECT (SELECT count(*) FROM docs) AS compared, count(*) AS duplicated, count(DISTINCT root) AS groups FROM members",
    "timeline_order": f"""
        WITH {_CORPUS}, r AS (SELECT id, source, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE published END AS p FROM docs), o AS (SELECT id, row_number() OVER (ORDER BY p DESC NULLS LAST, source, id) AS place FROM r)
        SELECT id, place FROM o WHERE place <= 100""",
    "post_link_summary": """
        WITH p AS (SELECT url, 1577836800 + page_id % 40 AS second, page_id % 5 = 0 AS bad FROM pages WHERE page_id % 5 = 0 OR page_id % 7 <> 0), s AS (SELECT DISTINCT url, second FROM p WHERE NOT bad)
        SELECT (SELECT count(*) FROM s) AS links, (SELECT count(DISTINCT url) FROM s) AS unique, (SELECT min(second) FROM s) AS earliest, (SELECT max(second) FROM s) AS latest, (SELECT 2 * count(*) FROM p WHERE bad) AS dropped""",
    "chunk_paragraphs": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, CAST(index AS INTEGER) AS chunk, CAST(s AS INTEGER) AS first, CAST(e AS INTEGER) AS last, sha256(text) AS hash FROM chunks",
    "passage_search": f"""
        WITH RECURSIVE {_CHUNKS}, {_bm25(passages=_TITLED)}, fused AS (SELECT source, doc_id, index, 1.0 / (60 + rank) AS score, rank AS lexical_rank FROM lex WHERE rank <= 200), {_ROLLED}
        SELECT doc_id, CAST(index AS INTEGER) AS index, round(score, 9) AS score, lexical_rank, place FROM o WHERE place <= 50""",
    "chunk_invariants": f"""
        WITH a AS (SELECT doc_id, {_TIDY} AS t FROM documents)
        SELECT doc_id, CAST(octet_length(encode(t)) AS BIGINT) AS covered, true AS bounded, CAST(0 AS BIGINT) AS first, CAST(octet_length(encode(t)) AS BIGINT) AS last FROM a WHERE t <> ''""",
    "token_frequencies": f"WITH t AS (SELECT unnest({_TOKENS}) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY 1",
    "postings": f"WITH ps AS ({_LINES.format(where='true')}), t AS (SELECT doc_id, index, unnest({_TOKENS}) AS term FROM ps) SELECT term, count(DISTINCT (doc_id, index)) AS df, count(*) AS cf FROM t GROUP BY 1",
    "bm25_top": f"WITH {_bm25()} SELECT source, doc_id, CAST(index AS BIGINT) AS index, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM lex WHERE rank <= 50",
    "query_table": f"WITH {_MANY} SELECT query_id, source, doc_id, CAST(index AS BIGINT) AS index, round(score, 6) AS score, rank FROM lex WHERE rank <= 20",
    "query_table_hybrid": f"""
        WITH {_MANY}, {_VECS.format(where="q.vec_id IN (SELECT query_id FROM qt)")},
        fused AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.source, v.source) AS source, coalesce(l.doc_id, v.doc_id) AS doc_id, CAST(coalesce(l.index, v.index) AS BIGINT) AS index,
                  coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + v.rank), 0) AS score, coalesce(l.rank, 0) AS lexical_rank, coalesce(v.rank, 0) AS vector_rank
                  FROM (SELECT * FROM lex WHERE rank <= 200) l FULL OUTER JOIN (SELECT * FROM vec WHERE rank <= 200) v ON l.query_id = v.query_id AND l.doc_id = v.doc_id AND l.source = v.source AND l.index = v.index),
        best AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, source, index) = 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, doc_id, index) AS place FROM best)
        SELECT query_id, source, doc_id, index, round(score, 9) AS score, lexical_rank, vector_rank, place FROM o WHERE place <= 10""",
    "vector_table": f"WITH {_VECS.format(where='true')} SELECT query_id, doc_id, round(CAST(score AS DOUBLE), 4) AS score, rank FROM vec WHERE rank <= 5",
    "vector_file": """
        SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, len(embedding) AS width, CAST(embedding[1] AS DOUBLE) AS head, CAST(embedding[-1] AS DOUBLE) AS tail,
               round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS squares FROM embeddings""",
    "vector_top": f"WITH {_VEC} SELECT doc_id, round(CAST(score AS DOUBLE), 4) AS score, CAST(rank AS INTEGER) AS rank FROM vec WHERE rank <= 50",
    "vector_normalise": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
        SELECT vec_id, 1.0 AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 4) AS head FROM e""",
    "hybrid_rrf": f"WITH {_bm25()}, {_VEC}, {_FUSED} SELECT source, doc_id, index, round(score, 9) AS score, lexical_rank, vector_rank FROM fused",
    "hybrid_rollup": f"WITH {_bm25()}, {_VEC}, {_FUSED}, {_ROLLED} SELECT source, doc_id, index, round(score, 9) AS score, place FROM o WHERE place <= 10",
    "source_filtered_search": f"""
        WITH {_bm25(_SRC3)}, fused AS (SELECT source, doc_id, index, 1.0 / (60 + rank) AS score, rank AS lexical_rank FROM lex WHERE rank <= 200), {_ROLLED}
        SELECT doc_id, CAST(index AS BIGINT) AS index, lexical_rank, place FROM o WHERE place <= 10""",
    "reuse_plan": """
        WITH o AS (SELECT DISTINCT sha256(text || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS k FROM documents WHERE doc_id % 3 <> 0)
        SELECT doc_id, sha256(text) IN (SELECT k FROM o) AS reused FROM documents""",
    "shingle_sets": f"WITH {_CORPUS}, {_SHINGLES} SELECT doc_id, CAST(len(s) AS BIGINT) AS shingles FROM s",
    "near_duplicate_pairs": f"WITH {_CORPUS}, {_SHINGLES}, {_PAIRS} SELECT least(CAST(a AS BIGINT), CAST(b AS BIGINT)) AS a, greatest(CAST(a AS BIGINT), CAST(b AS BIGINT)) AS b, round(score, 6) AS score FROM pairs",
    "duplicate_members": f"{_DUPES} SELECT id, root AS group_id, winner_id, id = winner_id AS winner, round(score, 6) AS score, priority FROM members",
    "duplicate_groups": f"{_DUPES} SELECT root AS group_id, winner_id, count(*) AS members, round(min(CASE WHEN id <> winner_id THEN score END), 6) AS lowest FROM members GROUP BY 1, 2",
    "timeline_entries": f"{_DUPES}, {_ENTRIES} SELECT id, source, CAST(words AS BIGINT) AS words, {_LENGTH} AS length, CAST(copies AS BIGINT) AS copies FROM entries",
    "timeline_sources": f"{_DUPES}, {_ENTRIES} SELECT source, count(*) AS entries FROM entries GROUP BY 1",
    "timeline_months": f"{_DUPES}, {_ENTRIES} SELECT year(published) AS year, month(published) AS month, count(*) AS entries FROM entries GROUP BY 1, 2",
    "event_months": "SELECT year(ts) AS year, month(ts) AS month, count(*) AS entries FROM events GROUP BY ALL",
    "stats_by_source": f"""
        WITH {_CORPUS}, r AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE published END AS p, CASE WHEN length(t) > 20 THEN 1 ELSE 0 END AS c FROM docs)
        SELECT coalesce(source, 'all') AS source, count(*) AS documents, CAST(sum(c) AS BIGINT) AS chunks, CAST(sum(words) AS BIGINT) AS words, count(*) FILTER (p IS NULL) AS undated, count(*) FILTER (c = 0) AS empty,
               strftime(min(p), '%Y-%m-%d') AS earliest, strftime(max(p), '%Y-%m-%d') AS latest FROM r GROUP BY ROLLUP (source)""",
    "stats_spread": _spread(f"{_CORPUS}, v0 AS (SELECT source, words AS v FROM docs)"),
    "stats_years": f"""
        WITH {_CORPUS}, r AS (SELECT source, year(published) AS year FROM docs WHERE doc_id % 17 <> 0)
        SELECT source, year, count(*) AS documents FROM r GROUP BY 1, 2 UNION ALL SELECT 'all', year, count(*) FROM r GROUP BY 2""",
    "stats_vocabulary": f"""
        WITH {_CORPUS}, tk AS (SELECT source, unnest({_TOKENS}) AS term FROM (SELECT source, t AS text FROM docs)), g AS (SELECT source, term, count(*) AS n FROM tk GROUP BY 1, 2), a AS (SELECT term, sum(n) AS n FROM g GROUP BY 1)
        SELECT source, count(*) AS vocabulary, count(*) FILTER (n = 1) AS hapax FROM g GROUP BY 1 UNION ALL SELECT 'all', count(*), count(*) FILTER (n = 1) FROM a""",
    "order_spread": _spread("v0 AS (SELECT l_returnflag AS source, CAST(floor(l_extendedprice) AS BIGINT) AS v FROM lineitem)"),
    "link_domains": "SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS domain, count(*) AS count FROM pages WHERE regexp_matches(lower(url), '^https?://[^/?#]+') GROUP BY 1",
    "link_dedupe": """
        WITH l AS (SELECT url, 1577836800 + page_id % 40 AS second, 'c' || page_id AS comment FROM pages UNION ALL SELECT url, 1577836800 + page_id % 40, 'again' FROM pages)
        SELECT url, second, min(comment) AS comment FROM l GROUP BY 1, 2""",
    "link_hosts": """
        WITH u AS (SELECT page_id, page_id % 3 AS k, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages)
        SELECT page_id, k <> 0 AS usable, CASE WHEN k <> 0 THEN regexp_replace(lower(h), '^www\\.', '') END AS host FROM u""",
    "page_meta": """
        WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t FROM pages)
        SELECT page_id, replace(replace(replace(replace(t, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS title FROM t""",
    "page_text": """
        WITH a AS (SELECT page_id, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS t FROM pages),
        b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?is)<!--.*?-->|<(script|style|nav|form|noscript)[^>]*>.*?</(script|style|nav|form|noscript)>', '', 'g'), '(?i)</?(p|div|section|article|h[1-6]|li|ul|ol|blockquote|pre|tr|table|br|hr|header|footer|figcaption|dd|dt)(\\s[^>]*)?/?>', chr(10)||chr(10), 'g') AS t FROM a),
        c AS (SELECT page_id, regexp_replace(t, '<[^>]*>', '', 'g') AS t FROM b),
        d AS (SELECT page_id, replace(replace(replace(replace(t, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS t FROM c),
        e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '\\t', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n{3,}', chr(10)||chr(10), 'g') AS t FROM d)
        SELECT page_id, trim(t, ' '||chr(10)) AS text FROM e""",
    "post_records": """
        WITH c AS (SELECT *, 1577836800 + conv_id * 100 + turn AS second FROM conversations)
        SELECT 'your_posts_' || conv_id || '_' || turn || '.json' AS file, second || ':' || substr(sha256(text), 1, 12) AS native_key, text, second FROM c""",
    "sidecar_join": f"""
        WITH a AS (SELECT doc_id, source, {_TIDY} AS t FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 <> 0)
        SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'found' END AS status, sha256(CASE WHEN doc_id % 7 <> 0 AND t <> '' THEN 'About ' || source || chr(10) || chr(10) || t ELSE t END) AS hash FROM a""",
    "review_titles": """
        WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'A ' || source END AS t, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'By ' || lang END AS a, CAST(floor((doc_id % 13) / 2 + 0.5) AS INTEGER) AS n FROM documents)
        SELECT doc_id, trim(CASE WHEN t = '' THEN a WHEN a = '' THEN t ELSE t || ' by ' || a END || CASE WHEN n BETWEEN 1 AND 5 THEN ' ' || repeat('★', n) || repeat('☆', 5 - n) ELSE '' END) AS title FROM r""",
    "site_dates": "SELECT doc_id, strftime(TRY_CAST((1990 + doc_id % 40) || '-' || (1 + doc_id % 14) || '-' || (1 + doc_id % 33) AS DATE), '%Y-%m-%d') AS day FROM documents",
    "slug_titles": """
        SELECT doc_id, source || ' of ' || lang AS slug, '2001 2 3 ' || source || ' of ' || lang || CASE WHEN doc_id % 2 = 0 THEN ' copy' ELSE '' END AS name FROM documents""",
    "mojibake_repair": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "path_matcher": """
        SELECT page_id, page_id % 11 IN (0, 2, 3, 5, 6, 8) AS file_rule, page_id % 11 IN (9, 10) AS folder_rule FROM pages""",
    "snippets": """
        WITH a AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
        b AS (SELECT doc_id, t, octet_length(encode(t)) AS n, list_max(list_filter(range(0, 151), lambda k: octet_length(encode(substr(t, 1, k))) <= 150)) AS k, substr(t, 1, 500) AS p FROM a),
        c AS (SELECT *, substr(t, 1, k) || CASE WHEN n > 150 AND octet_length(encode(substr(t, 1, k))) < 150 THEN chr(65533) ELSE '' END AS s FROM b),
        d AS (SELECT *, length(s) - strpos(reverse(s), ' ') AS i, length(p) - strpos(reverse(p), ' ') AS j FROM c)
        SELECT doc_id, CASE WHEN n <= 150 THEN t WHEN strpos(s, ' ') > 0 AND octet_length(encode(substr(s, 1, i))) > 130 THEN substr(s, 1, i) || '...' ELSE s || '...' END AS snippet,
               sha256(CASE WHEN length(t) <= 1000 THEN t ELSE rtrim(CASE WHEN strpos(p, ' ') > 0 AND j > 250 THEN substr(p, 1, j) ELSE p END, ' ,.;:-') || '…' END) AS preview FROM d""",
    "viewer_filter": f"WITH {_CORPUS} SELECT id, source, {_LENGTH} AS length FROM docs WHERE source IN ('src1', 'src2', 'src3') AND words < 1000 AND contains(lower(t), 'the ')",
}
