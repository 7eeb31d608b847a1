"""DuckDB SQL for the corpus queries that SQL can express."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_source_mixing": r"""
        WITH items AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5)
                       / 4503599627370496.0::DOUBLE AS u
            FROM documents),
        sizes AS (
            SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT * 3 AS cap,
                   [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
            FROM items GROUP BY source),
        leveled AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                   / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM sizes),
        aims AS (
            SELECT source, source_size,
                   CASE WHEN cap::DOUBLE / weight <= level THEN cap::DOUBLE
                        ELSE max(CASE WHEN cap::DOUBLE / weight > level THEN level END) OVER () * weight END AS target
            FROM leveled),
        expected AS (
            SELECT i.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS e
            FROM items i JOIN aims a ON i.source IS NOT DISTINCT FROM a.source),
        ranked AS (
            SELECT *, floor(e)::BIGINT AS certain, target - source_size * floor(e) AS rest,
                   CASE WHEN e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS rank
            FROM expected),
        summed AS (
            SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST) AS so_far,
                   sum(size) OVER (PARTITION BY source, rank, doc_id) AS own
            FROM ranked)
        SELECT doc_id, size, source_size, target,
               size * (certain + CASE WHEN rank IS NOT NULL AND (so_far <= rest OR so_far - own < rest AND so_far - rest <= rest - (so_far - own))
                                      THEN 1 ELSE 0 END) AS taken
        FROM summed""",
    "op5_exact_dedup": f"""
        WITH bodies AS (SELECT doc_id, {LOWERED} AS body FROM documents),
        groups AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM bodies GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM bodies JOIN groups USING (body)""",
    "op6_warc_archive": """
        WITH hashed AS (
            SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        named AS (
            SELECT page_id, payload_bytes,
                   array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + (((('0x' || substr(h, (i // 4)::INT * 5 + 1, 5))::INT >> (5 * (3 - i % 4))::INT) & 31)), 1)), '') AS payload_digest,
                   max(page_id) OVER (PARTITION BY h) AS first
            FROM hashed)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM named""",
    "op10_url_filter": """
        WITH rules(rule_host, rule_path, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        parts AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
            FROM pages),
        urls AS (SELECT DISTINCT host, path FROM parts),
        best AS (
            SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(verdict, length(rule_host || rule_path)) AS verdict
            FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY host, path)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)""",
    "op7_token_rollups": r"""
        WITH marks AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
        bodies AS (
            SELECT d.doc_id, source, lang,
                   CASE WHEN m.quality = 0 THEN regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}\x20\x09-\x0D]+', ' ', 'g')
                        ELSE coalesce(text, '') END AS body
            FROM documents d LEFT JOIN marks m ON m.doc_id = d.doc_id
            WHERE coalesce(m.toxic, 0) <> 1),
        counted AS (
            SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS n FROM bodies
            UNION ALL
            SELECT source, lang, 'pieces-1', len(regexp_extract_all(body, '\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]+')) FROM bodies)
        SELECT source, lang, tokenizer, count(*)::BIGINT AS documents, sum(n)::BIGINT AS tokens FROM counted GROUP BY ALL""",
    "op13_fill_in_middle": r"""
        WITH units AS (
            SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
                   list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), i::INT, 8))::BIGINT) AS h
            FROM documents),
        cut AS (
            SELECT *, len(units)::BIGINT AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a,
                   greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
                   CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                        WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM units),
        pieces AS (
            SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
            FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(body) AS restored_sha256
        FROM pieces""",
    "op12_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        occurrences AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
        vocabulary AS (SELECT lang, term, count(*) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
        held AS (SELECT lang, source, term, count(*) AS n FROM occurrences SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
        languages AS (SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY lang),
        totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN held USING (lang, source) GROUP BY ALL),
        shares AS (
            SELECT lang, source, term, coalesce(h.n, 0) AS n, 1 + (1000000000 * (coalesce(h.n, 0) + 5)::HUGEINT) // (t.total + 5 * l.v) AS p
            FROM totals t JOIN languages l USING (lang) JOIN vocabulary USING (lang) LEFT JOIN held h USING (lang, source, term)),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(p.p - q.p)), 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN shares p ON p.lang = a.lang AND p.source = a.source
            LEFT JOIN shares q ON q.lang = b.lang AND q.source = b.source AND q.term = p.term
            GROUP BY ALL),
        own AS (
            SELECT lang, source, term AS item, p - (1 + (1000000000 * (v.n + 5)::HUGEINT) // (l.total + 5 * l.v)) AS value
            FROM shares s JOIN vocabulary v USING (lang, term) JOIN languages l USING (lang) WHERE s.n > 0),
        parts AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM own WHERE value > 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
