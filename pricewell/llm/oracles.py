"""DuckDB SQL for the queries that SQL can express."""

from pricewell.llm import host_rules, url_filter

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OUTER = r"E' \t\n\x0B\x0C\r'"

TERMS = r"regexp_extract_all(translate(text, {letters}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(letters=LETTERS)
RULE_LIMITS = ", ".join(f"('{rule}', {most})" for rule, most in host_rules.HOST_MOST_FAILED.items())
URL_RULES = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in url_filter.RULES)
URL_TERMS = ", ".join(f"('{t}', {w})" for t, w in url_filter.VOCABULARY.items())

ORACLES = {
    "op1_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 50 = 0
        ),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
        SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5""",
    "op4_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
        k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k FROM g),
        f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (k) WHERE doc_id > first),
        lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
        kept AS (
            SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
                   CASE WHEN ps IS NULL THEN ws ELSE [ws[j] for j in range(1, len(ws) + 1) if NOT list_contains(ps, j)] END AS left_
            FROM w LEFT JOIN lists USING (doc_id)
        )
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(left_, ' '), '')) AS kept_sha256 FROM kept""",
    "op6_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
        ),
        k AS (SELECT *, translate(trim(line, {OUTER}), {LETTERS}) AS k FROM l),
        o AS (SELECT k, min(doc_id) AS first FROM k WHERE length(k) >= 10 GROUP BY k),
        m AS (SELECT k.*, coalesce(doc_id > first, false) AS gone FROM k LEFT JOIN o USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op7_host_rules": f"""
        WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
        t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
        c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY doc_id),
        d AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (
                SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w
            ) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
        ),
        b AS (
            SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   coalesce(d.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
            FROM w LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)
        ),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
        r AS (
            SELECT source, unnest([
                {{'rule': 'base', 'failed': base_failed}}, {{'rule': 'short', 'failed': n_words < 50}},
                {{'rule': 'repeats', 'failed': 100 * n_repeat_words > 50 * n_words}}, {{'rule': 'symbols', 'failed': 4 * n_symbols > n_words}},
                {{'rule': 'lines', 'failed': 4 * n_dup_lines > n_words}}, {{'rule': 'lengths', 'failed': word_chars < 2 * n_words OR word_chars > 15 * n_words}}
            ], recursive := true) FROM f
        ),
        h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS k FROM r GROUP BY source, rule),
        p AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM h GROUP BY rule),
        q AS (SELECT rule, m, greatest(least(m * (1 - m) / greatest(v, 1e-6) - 1, 1e4), 1.0) AS s FROM p),
        l(rule, most) AS (VALUES {RULE_LIMITS}),
        ok AS (SELECT source, bool_and((k + m * s) / (n + s) <= most) AS host_ok FROM h JOIN q USING (rule) JOIN l USING (rule) GROUP BY source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
        FROM f JOIN ok ON f.source IS NOT DISTINCT FROM ok.source""",
    "op12_lexical_search": f"""
        WITH d AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
        t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
        n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
        c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
        m AS (SELECT doc_id, 75 + ((25 * n * big_n) // big_l) AS m FROM n, c),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, big_n),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
        s AS (
            SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
        ),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS "rank" FROM s WHERE score > 0)
        SELECT item_id, "rank", doc_id, score FROM r WHERE "rank" <= 20""",
    "op13_url_filter": f"""
        WITH rules(h, p, v) AS (VALUES {URL_RULES}), terms(term, weight) AS (VALUES {URL_TERMS}),
        u AS (
            SELECT row_number() OVER () AS n, page_id, translate(coalesce(url, ''), {LETTERS}) AS low,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {LETTERS}) AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
        ),
        f AS (
            SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
            FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n
        ),
        k AS (SELECT n, sum(weight) AS weight FROM u JOIN terms ON regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN coalesce(weight, 0) >= {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN f USING (n) LEFT JOIN k USING (n)""",
}
