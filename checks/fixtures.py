"""Views over the driver tables, in SQL that Spark and DuckDB both run.

They stand for the tables the engine would have: feedback items with labels, logs, replies, drafts.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from roadsift.session import configure

BASE_TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

EVENT_KEYS = "(SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"

VIEWS = {
    "feedback_items": f"""
SELECT d.doc_id AS id, d.source AS source, md5(d.text) AS external_id,
       concat('u', CAST(e.user_id AS STRING)) AS author, d.text AS body,
       1 + e.k % 5 AS rating, e.ts AS created_at, e.ts AS ingested_at,
       CASE WHEN e.k % 20 = 0 THEN 'new' WHEN e.k % 20 = 1 THEN 'failed' ELSE 'classified' END AS status,
       CASE WHEN e.k % 20 <= 1 THEN NULL WHEN l.toxic = 1 THEN 'churn_risk' WHEN e.k % 17 = 0 THEN 'question'
            WHEN e.event_type = 'error' THEN 'bug' WHEN e.event_type = 'signup' THEN 'feature_request'
            WHEN e.event_type = 'click' THEN 'ux_friction' WHEN e.event_type = 'purchase' THEN 'pricing'
            ELSE 'praise' END AS fb_type,
       CASE WHEN e.k % 20 <= 1 THEN NULL ELSE d.lang END AS product_area,
       CASE WHEN e.k % 20 <= 1 THEN NULL WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive'
            ELSE 'neutral' END AS sentiment,
       CASE WHEN e.k % 20 <= 1 THEN NULL ELSE 1 + e.k % 4 END AS severity,
       CASE WHEN e.k % 20 <= 1 THEN NULL ELSE CAST(50 + e.k % 51 AS DOUBLE) / 100 END AS confidence,
       CASE WHEN e.k % 23 = 0 THEN 1 ELSE 0 END AS human_corrected,
       CASE WHEN e.k % 20 <= 1 THEN NULL
            WHEN e.event_type = 'view' AND coalesce(l.toxic, 0) = 0 AND e.k % 17 <> 0 THEN NULL
            ELSE m.label END AS theme_id
FROM documents d
JOIN {EVENT_KEYS} e ON e.event_id = d.doc_id * 5
LEFT JOIN labels l ON l.doc_id = d.doc_id
LEFT JOIN embeddings m ON m.vec_id = d.doc_id % 500""",
    "themes": """
SELECT DISTINCT label AS id, concat('theme ', CAST(label AS STRING)) AS name,
       concat('all about ', CAST(label AS STRING)) AS summary FROM embeddings""",
    "replies": f"""
SELECT e.event_id AS item_id, CASE e.k % 8
 WHEN 0 THEN concat('{{"type": "bug", "area": "sync", "sentiment": "negative", "severity": ', CAST(e.k % 7 AS STRING), ', "confidence": 0.9}}')
 WHEN 1 THEN concat('Sure! Here it is: {{"type": "praise", "area": "editor", "sentiment": "positive", "severity": "', CAST(e.k % 5 AS STRING), '", "confidence": "0.75"}} Hope that helps.')
 WHEN 2 THEN '{{"type": "rant", "area": "billing", "sentiment": "angry", "severity": 9, "confidence": 1.7}}'
 WHEN 3 THEN '{{"type": "pricing", "sentiment": "neutral", "severity": "high"}}'
 WHEN 4 THEN 'I cannot label this.'
 WHEN 5 THEN '{{"type": "question", "area": "onboarding"'
 WHEN 6 THEN '{{"type": "churn_risk", "area": "an area name that is much longer than fifty characters in total", "sentiment": "negative", "severity": 4, "confidence": -0.2}}'
 ELSE NULL END AS reply
FROM {EVENT_KEYS} e""",
    "verdict_replies": """
SELECT id AS item_id, fb_type, CASE id % 8
 WHEN 0 THEN '{"type_correct": true, "suggested_type": "bug", "reasoning": "clear"}'
 WHEN 1 THEN 'Well: {"type_correct": false, "suggested_type": "pricing", "reasoning": "about money"} Done.'
 WHEN 2 THEN '{"type_correct": "false"}'
 WHEN 3 THEN '{"type_correct": 1, "reasoning": null}'
 WHEN 4 THEN '{"suggested_type": "other"}'
 WHEN 5 THEN 'no idea'
 WHEN 6 THEN '{"type_correct": true'
 ELSE concat('{"type_correct": true, "reasoning": "', repeat('because ', 60), '"}') END AS reply
FROM feedback_items WHERE status = 'classified'""",
    "verdicts": """
SELECT id AS item_id, CASE WHEN rating = 3 THEN NULL ELSE rating <> 1 END AS type_correct, 'other' AS suggested_type
FROM feedback_items WHERE status = 'classified'""",
    "golden": """
SELECT CAST(f.id AS STRING) AS id, f.body AS body,
       CASE WHEN f.rating = 4 THEN ' ' WHEN l.quality = 0 THEN 'other' ELSE coalesce(f.fb_type, 'bug') END AS gold_type,
       CAST(CASE WHEN l.quality = 0 THEN 1 ELSE f.severity END AS STRING) AS gold_severity
FROM feedback_items f JOIN labels l ON l.doc_id = f.id""",
    "failures": f"""
SELECT e.event_id AS id, CASE e.k % 8
 WHEN 0 THEN 'HTTP 429 Too Many Requests' WHEN 1 THEN 'Service UNAVAILABLE' WHEN 2 THEN 'limit 1500'
 WHEN 3 THEN 'bad JSON' WHEN 4 THEN NULL WHEN 5 THEN 'Tokens per day used up' WHEN 6 THEN 'Request Timeout'
 ELSE concat('status ', CAST(480 + e.k AS STRING)) END AS message,
 CASE WHEN e.k % 9 = 0 THEN 503 WHEN e.k % 9 = 1 THEN 404 END AS code
FROM {EVENT_KEYS} e""",
    "plain_items": """
SELECT doc_id AS id, lang AS source, md5(text) AS external_id, text AS body FROM documents""",
    "label_log": f"""
SELECT CAST(floor(e.event_id / 20) AS BIGINT) AS item_id, e.event_id AS seq,
       CASE e.event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'reset' ELSE 'label' END AS kind,
       CASE WHEN e.event_type IN ('error', 'signup') THEN NULL WHEN e.k % 3 = 0 THEN 'bug' ELSE 'praise' END AS fb_type,
       CASE WHEN e.event_type IN ('error', 'signup') THEN NULL ELSE 'sync' END AS product_area,
       CASE WHEN e.event_type IN ('error', 'signup') THEN NULL ELSE 'neutral' END AS sentiment,
       CASE WHEN e.event_type IN ('error', 'signup') THEN NULL ELSE 1 + e.k % 4 END AS severity,
       CASE WHEN e.event_type IN ('error', 'signup') THEN NULL ELSE CAST(e.k AS DOUBLE) / 100 END AS confidence,
       CASE WHEN e.event_type = 'error' THEN 'broken' END AS error
FROM {EVENT_KEYS} e""",
    "edits": f"""
SELECT CAST(floor(e.event_id / 13) AS BIGINT) AS item_id, e.event_id AS seq,
       CASE WHEN e.k % 5 = 0 THEN 'nonsense' WHEN e.k % 5 = 1 THEN 'pricing' ELSE 'other' END AS fb_type,
       1 + e.k % 6 AS severity
FROM {EVENT_KEYS} e WHERE e.event_type = 'signup'""",
    "theme_runs": """
SELECT CAST(1 AS BIGINT) AS run_id, d.doc_id AS item_id, CAST(m.label AS BIGINT) AS theme_id
FROM documents d JOIN embeddings m ON m.vec_id = d.doc_id % 500
UNION ALL
SELECT CAST(2 AS BIGINT) AS run_id, d.doc_id AS item_id, CAST(m.label + 10 AS BIGINT) AS theme_id
FROM documents d JOIN embeddings m ON m.vec_id = d.doc_id % 500 WHERE d.lang = 'en'""",
    "raw_reviews": """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS reviewId,
       CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 3 = 1 THEN NULL ELSE concat('c', CAST(conv_id AS STRING)) END AS userName,
       CASE WHEN conv_id % 5 = 0 THEN concat(chr(9), ' ', text, chr(10), ' ') WHEN conv_id % 7 = 0 THEN NULL ELSE text END AS content,
       CASE WHEN turn = 0 THEN NULL ELSE concat(CAST(1 + conv_id % 5 AS STRING), '.7') END AS score,
       concat('2024-01-', CASE WHEN conv_id % 28 < 9 THEN '0' ELSE '' END, CAST(1 + conv_id % 28 AS STRING), 'T01:30:00+02:00') AS at,
       conv_id, turn
FROM conversations WHERE role = 'user'""",
    "ranked_items": """
SELECT theme_id, id, row_number() OVER (PARTITION BY theme_id ORDER BY severity DESC, id) AS place,
       count(*) OVER (PARTITION BY theme_id) AS places
FROM feedback_items WHERE theme_id IS NOT NULL""",
    "theme_drafts": """
SELECT theme_id, draft, concat('  # PRD', chr(10), AGG(concat('claim ', CAST(place AS STRING), ' [#', CAST(id AS STRING), ']'), chr(10)),
       chr(10), 'see #999999999 and #', CAST(min(id) AS STRING), chr(10)) AS markdown
FROM (SELECT *, CAST(floor((place - 1) / 40) AS BIGINT) AS draft FROM ranked_items) r GROUP BY theme_id, draft""",
    "review_drafts": """
SELECT f.id AS item_id, concat('# PRD for [#', CAST(f.id AS STRING), ']', chr(10), 'also [#', CAST(a.id AS STRING), '], [#',
       CAST(b.id AS STRING), '], [#', CAST(c.id AS STRING), '] and #', CAST(f.id + 1 AS STRING)) AS markdown
FROM feedback_items f
JOIN ranked_items r ON r.id = f.id
JOIN ranked_items a ON a.theme_id = r.theme_id AND a.place = 1 + (r.place + 3) % 5
JOIN ranked_items b ON b.theme_id = r.theme_id AND b.place = 1 + r.place % r.places
JOIN ranked_items c ON c.theme_id = r.theme_id AND c.place = 1 + r.place * 7 % r.places
WHERE f.status = 'classified'""",
    # For Spark only: every run of letters, blanks and commas of a text, on a line of its own.
    "quoting_drafts": r"""
SELECT doc_id, regexp_replace(text, '[^\\p{L} ,]*([\\p{L} ,]+)[^\\p{L} ,]*',
       concat('One said [#', CAST(doc_id AS STRING), '] "$1", another [#', CAST(doc_id + 1 AS STRING), ']: "$1".', chr(10))) AS markdown
FROM documents WHERE text RLIKE '[\\p{L} ,]'""",
    "name_replies": """
SELECT id AS theme_id, CASE id % 3
 WHEN 0 THEN concat('{"name": "Trouble with number ', CAST(id AS STRING), repeat(' and on', 10), '", "summary": "All of it."}')
 WHEN 1 THEN 'Sorry, no.' ELSE '{"summary": "No name here."}' END AS reply
FROM themes""",
    "efforts": """
SELECT id AS theme_id, 0.5 + id AS effort FROM themes""",
    "versions": f"""
SELECT CASE WHEN e.event_type = 'view' THEN 'brief' ELSE 'theme' END AS target_kind, e.user_id % 12 AS target_id,
       concat('draft ', CAST(e.event_id AS STRING)) AS markdown, e.event_id AS updated_at
FROM {EVENT_KEYS} e""",
    "reports": f"""
SELECT e.event_id AS doc_id, CASE WHEN e.k % 3 = 0 THEN concat('- Citations found: **', CAST(e.k AS STRING), '**', chr(10),
    '- Valid (point to a real review in this theme): **', CAST(e.k - 1 AS STRING), '**', chr(10),
    '- Hallucinated (id not in this theme): **1** — none')
 WHEN e.k % 3 = 1 THEN concat('- Citations found: **', CAST(e.k AS STRING), '**', chr(10), '- Valid (point to a real review): **',
    CAST(e.k AS STRING), '**', chr(10), '- Hallucinated: **0** - none')
 ELSE 'no report' END AS markdown
FROM {EVENT_KEYS} e""",
}

AGGREGATE = {
    "spark": (r"AGG\((.*), chr\(10\)\),", r"listagg(\1, chr(10)) WITHIN GROUP (ORDER BY place),"),
    "duckdb": (r"AGG\((.*), chr\(10\)\),", r"string_agg(\1, chr(10) ORDER BY place),"),
}


def _needed(text: str) -> list[str]:
    """Views a query mentions, directly or through others, each after the ones it needs."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                visit(VIEWS[name])
                order.append(name)

    visit(text)
    return order


def with_views(query: str, engine: str = "duckdb") -> str:
    """The query behind a WITH clause holding the views it reads."""
    pattern, replacement = AGGREGATE[engine]
    parts = [f"{name} AS ({re.sub(pattern, replacement, VIEWS[name]).strip()})" for name in _needed(query)]
    stripped = query.strip()
    if stripped[:5].upper() == "WITH ":
        parts.append(stripped[5:])
        return "WITH " + ",\n".join(parts)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + stripped


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return configure(spark).read.schema(BASE_TABLES[name]).parquet(f"{directory}/{name}.parquet")


def view(spark: SparkSession, directory: str, name: str, registered: set[str] | None = None) -> DataFrame:
    """One of the views as a DataFrame; ``registered`` remembers base tables across calls for one directory."""
    registered = set() if registered is None else registered
    sql = with_views(f"SELECT * FROM {name}", "spark")
    for base in BASE_TABLES:
        used = re.compile(rf"\b(FROM|JOIN) {base}\b")
        if used.search(sql):
            if base not in registered:
                table(spark, directory, base).createOrReplaceTempView(f"driver_{base}")
                registered.add(base)
            sql = used.sub(rf"\1 driver_{base}", sql)
    return spark.sql(sql)
