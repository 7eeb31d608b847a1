"""What every registered query must return, as SQL for DuckDB, written independently of the engine's plans."""

from checks.fixtures import with_views
from roadsift.operators import evaluation, labels
from roadsift.plans import packs

ORACLES: dict[str, str] = {}

# Fixed values that results must show, stated apart from the engine's own: keyword rules and default (type, area,
# sentiment, severity, confidence), error texts, report wording, the summary of an unnamed theme.
KEYWORD_RULES = [
    (["not opening", "crash", "bug", "laggy"], "bug", "general", "negative", 3, 0.6),
    (["how to", "how do"], "question", "onboarding", "neutral", 1, 0.6),
    (["love", "great", "best"], "praise", "general", "positive", 1, 0.7),
]
KEYWORD_DEFAULT = ("other", "general", "neutral", 2, 0.4)
LABEL_FIELDS = ["fb_type", "product_area", "sentiment", "severity", "confidence"]
NO_OBJECT = "no JSON object in the reply"
BROKEN_OBJECT = "the reply's JSON object cannot be read"
REPORT_HEAD = "\n---\n## Citation Verification (automated guardrail)"
REPORT_FOUND = "- Citations found: **"
REPORT_VALID = "- Valid (point to a real review): **"
REPORT_HALLUCINATED = "- Hallucinated: **"
EVIDENCE_HEAD = "\n## Evidence - verbatim from source (rendered from the database, not the model)"
UNNAMED_SUMMARY = "(auto-named by product area — LLM naming unavailable)"


def text(value: str) -> str:
    """SQL literal."""
    return "'" + value.replace("'", "''") + "'"


WHITESPACE = "concat(' ', " + ", ".join(
    f"chr({code})"
    for code in [9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
) + ")"


def strip(column: str) -> str:
    return f"trim({column}, {WHITESPACE})"


RICE = """scored AS (
  SELECT theme_id, reach, impact, confidence, effort, round_even(reach * impact * confidence / effort * 10, 0) / 10 AS rice_score
  FROM (
    SELECT CAST(t.id AS BIGINT) AS theme_id, count(f.id) AS reach, {effort} AS effort,
           round_even(coalesce(CAST(sum(f.severity) AS DOUBLE) / count(f.severity), 0.0) * 100, 0) / 100 AS impact,
           round_even(coalesce(CAST(sum(CAST(round_even(f.confidence * 1000000, 0) AS BIGINT)) AS DOUBLE)
                      / (count(f.confidence) * 1000000.0), 0.0) * 100, 0) / 100 AS confidence
    FROM themes t LEFT JOIN feedback_items f ON f.theme_id = t.id {more}
    GROUP BY t.id, {effort}) sums)"""
SCORED = RICE.format(effort="CAST(2.0 AS DOUBLE)", more="").replace("GROUP BY t.id, CAST(2.0 AS DOUBLE)", "GROUP BY t.id")
NAMED = "SELECT s.*, t.name, t.summary FROM scored s JOIN themes t ON t.id = s.theme_id"
LINE = (
    "concat(CAST(position AS VARCHAR), '. ', name, ' — reach ', CAST(reach AS VARCHAR), ', impact ', CAST(impact AS VARCHAR),"
    " '/4, effort ', CAST(effort AS VARCHAR), 'w, RICE ', printf('%.1f', rice_score))"
)
LINES = f"""placed AS (SELECT *, row_number() OVER (ORDER BY rice_score DESC, theme_id) AS position FROM ({NAMED}) n),
lines AS (SELECT CAST(position AS INT) AS position, theme_id, {LINE} AS line FROM placed)"""

ORACLES["rice_roadmap"] = f"WITH {SCORED} SELECT theme_id, name, reach, impact, confidence, effort, rice_score FROM ({NAMED}) n"
ORACLES["rice_with_efforts"] = (
    "WITH " + RICE.format(effort="CAST(e.effort AS DOUBLE)", more="JOIN efforts e ON e.theme_id = t.id") + " SELECT * FROM scored"
)
ORACLES["top_opportunity"] = f"WITH {SCORED} SELECT * FROM ({NAMED}) n ORDER BY rice_score DESC, theme_id LIMIT 1"
ORACLES["opportunity_lookup"] = f"WITH {SCORED} SELECT * FROM ({NAMED}) n WHERE theme_id = 3"
ORACLES["roadmap_lines"] = f"WITH {SCORED}, {LINES} SELECT * FROM lines"
ORACLES["roadmap_text"] = f"WITH {SCORED}, {LINES} SELECT string_agg(line, chr(10) ORDER BY position) AS roadmap FROM lines"
ORACLES["landscape"] = f"WITH {SCORED} SELECT name, reach, impact, rice_score FROM ({NAMED}) n"
ORACLES["score_printout"] = f"WITH {SCORED} SELECT rice_score, name, reach, impact, confidence FROM ({NAMED}) n"

DRIFT = """newest AS (SELECT max(CAST(created_at AS DATE)) AS anchor FROM feedback_items),
moved AS (
  SELECT CAST(t.id AS BIGINT) AS theme_id, t.name AS theme,
         count(*) FILTER (WHERE CAST(f.created_at AS DATE) > n.anchor - 7) AS recent,
         count(*) FILTER (WHERE CAST(f.created_at AS DATE) <= n.anchor - 7 AND CAST(f.created_at AS DATE) > n.anchor - 14) AS previous,
         any_value(n.anchor) AS anchor
  FROM themes t JOIN feedback_items f ON f.theme_id = t.id CROSS JOIN newest n GROUP BY t.id, t.name),
drifted AS (
  SELECT theme_id, theme, recent, previous, recent - previous AS change,
         CASE WHEN recent > previous THEN 'Rising' WHEN recent < previous THEN 'Cooling' ELSE 'Flat' END AS direction,
         CAST(anchor AS VARCHAR) AS anchor FROM moved)"""
BRIEF = f"""{SCORED}, {DRIFT},
leader AS (SELECT * FROM ({NAMED}) n ORDER BY rice_score DESC, theme_id LIMIT 1),
brief AS (
  SELECT max(anchor) AS week_ending, CAST(sum(recent) AS BIGINT) AS total_recent,
    coalesce(string_agg(concat('- **', theme, '** (', printf('%+d', change), ')'), chr(10) ORDER BY change DESC, theme_id) FILTER (WHERE change > 0), '- (none)') AS rising,
    coalesce(string_agg(concat('- **', theme, '** (', printf('%+d', change), ')'), chr(10) ORDER BY change DESC, theme_id) FILTER (WHERE change < 0), '- (none)') AS cooling,
    string_agg(concat('- ', theme, ': ', CAST(previous AS VARCHAR), ' → ', CAST(recent AS VARCHAR), ' (', printf('%+d', change), ')'), chr(10) ORDER BY change DESC, theme_id) AS movement,
    (SELECT name FROM leader) AS top_theme, (SELECT printf('%.1f', rice_score) FROM leader) AS top_score
  FROM drifted)"""
ORACLES["drift_table"] = f"WITH {DRIFT} SELECT * FROM drifted"
ORACLES["drift_printout"] = f"""WITH {DRIFT} SELECT theme_id, concat('  [', CASE WHEN change > 0 THEN 'UP  ' WHEN change < 0 THEN 'DOWN' ELSE 'flat' END, '] ',
 CASE WHEN length(theme) < 42 THEN rpad(theme, 42, ' ') ELSE theme END, printf(' %2d -> %2d  (%+d)', previous, recent, change)) AS line FROM drifted"""
ORACLES["stream_daily_counts"] = ORACLES["drift_table"]
SECOND = DRIFT.replace("CAST(t.id AS BIGINT)", "CAST(t.id + 10 AS BIGINT)").replace(
    "JOIN feedback_items f ON f.theme_id = t.id", "JOIN theme_runs r ON r.run_id = 2 AND r.theme_id = t.id + 10 JOIN feedback_items f ON f.id = r.item_id"
)
ORACLES["drift_by_deltas"] = f"WITH {SECOND} SELECT * FROM drifted"
ORACLES["drift_brief"] = f"WITH {BRIEF} SELECT * FROM brief"
ORACLES["brief_document"] = f"""WITH {BRIEF} SELECT 'brief' AS target_kind, concat('# State of Feedback — week ending ', week_ending, chr(10), chr(10),
 '*', CAST(total_recent AS VARCHAR), ' actionable items this week.*', chr(10), chr(10), '## Summary', chr(10), 'Ship it.', chr(10), chr(10),
 '## Rising themes', chr(10), rising, chr(10), chr(10), '## Cooling themes', chr(10), cooling, chr(10), chr(10),
 '## Movement (prev week → this week)', chr(10), movement, chr(10)) AS markdown FROM brief"""

KPI = """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'classified') AS classified,
 count(*) FILTER (WHERE status = 'classified' AND fb_type <> 'praise') AS actionable, count(theme_id) AS themed FROM feedback_items"""
ORACLES["kpi_counts"] = f"""SELECT k.*, (SELECT count(*) FROM themes) AS opportunities,
 concat(CAST(CAST(round_even(themed * 100.0::DOUBLE / total, 0) AS BIGINT) AS VARCHAR), '% of all feedback') AS themed_share FROM ({KPI}) k"""
ORACLES["funnel"] = f"""SELECT * FROM (
 SELECT 1 AS position, 'Ingested' AS stage, total AS items FROM ({KPI}) a UNION ALL SELECT 2, 'Classified', classified FROM ({KPI}) b
 UNION ALL SELECT 3, 'Actionable', actionable FROM ({KPI}) c UNION ALL SELECT 4, 'Prioritized (RICE)', themed FROM ({KPI}) d) u"""
SEVERITY = (
    "CASE severity WHEN 1 THEN '1 · minor' WHEN 2 THEN '2 · moderate' WHEN 3 THEN '3 · major' WHEN 4 THEN '4 · critical' END AS label"
)
ORACLES["type_mix"] = "SELECT fb_type, count(*) AS items FROM feedback_items WHERE status = 'classified' GROUP BY fb_type"
ORACLES["sentiment_mix"] = "SELECT sentiment, count(*) AS items FROM feedback_items WHERE status = 'classified' GROUP BY sentiment"
ORACLES["severity_mix"] = (
    f"SELECT severity, count(*) AS items, {SEVERITY} FROM feedback_items WHERE status = 'classified' GROUP BY severity"
)
ORACLES["severity_labels"] = f"SELECT id, {SEVERITY} FROM feedback_items"
ORACLES["rating_hist"] = "SELECT rating, count(*) AS items FROM feedback_items GROUP BY rating"
ORACLES["status_hist"] = "SELECT status, count(*) AS items FROM feedback_items GROUP BY status"
ORACLES["review_queue"] = """SELECT id, body, fb_type, severity, confidence FROM feedback_items WHERE status = 'classified'
 ORDER BY human_corrected NULLS FIRST, confidence NULLS FIRST, severity DESC NULLS LAST, id LIMIT 15"""
ORACLES["review_picker"] = """SELECT id, concat('#', CAST(id AS VARCHAR), ' · ', fb_type, ' · sev ', CAST(severity AS VARCHAR), ' · ', substring(body, 1, 55)) AS label
 FROM feedback_items WHERE status = 'classified'"""
WORK = "SELECT id, body FROM feedback_items WHERE status = 'new' ORDER BY ingested_at NULLS FIRST, id LIMIT"
LOW = "SELECT id, rating, substring(body, 1, 160) AS body FROM feedback_items WHERE rating <= 2 ORDER BY id LIMIT 5"
ORACLES["work_batch"] = f"{WORK} 15"
ORACLES["low_rating_sample"] = LOW
ORACLES["theme_drilldown"] = """SELECT CAST(f.theme_id AS INT) AS theme_id, f.id, f.fb_type, f.severity, f.body, t.name AS theme
 FROM feedback_items f JOIN themes t ON t.id = f.theme_id"""
ORACLES["theme_headers"] = """SELECT t.id, concat(t.name, ' — ', CAST(count(f.id) AS VARCHAR), ' items') AS header
 FROM themes t LEFT JOIN feedback_items f ON f.theme_id = t.id GROUP BY t.id, t.name"""
ORACLES["data_sanity"] = f"""SELECT 'rating' AS section, CAST(rating AS VARCHAR) AS entry, CAST(count(*) AS VARCHAR) AS value FROM feedback_items GROUP BY rating
 UNION ALL SELECT 'status', status, CAST(count(*) AS VARCHAR) FROM feedback_items GROUP BY status
 UNION ALL SELECT 'low rating', CAST(id AS VARCHAR), body FROM ({LOW}) l
 UNION ALL SELECT 'work batch', CAST(id AS VARCHAR), NULL FROM ({WORK} 5) w"""
ORACLES["actionable_items"] = "SELECT id, body, product_area FROM feedback_items WHERE status = 'classified' AND fb_type <> 'praise'"
ORACLES["item_lookup"] = "SELECT id, body, fb_type, severity, product_area, theme_id FROM feedback_items WHERE id = 42"
ORACLES["first_rows"] = "SELECT id, body, fb_type FROM feedback_items WHERE status = 'classified' ORDER BY id LIMIT 5"

USABLE = f"(SELECT * FROM plain_items WHERE length({strip('body')}) >= 20)"
STORED_KEYS = "(SELECT p.source, p.external_id FROM plain_items p JOIN labels l ON l.doc_id = p.id)"
FRESH = f"""SELECT id, source, external_id FROM (
 SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY id) AS nth FROM {USABLE} u) r
 WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM {STORED_KEYS} s WHERE s.source = r.source AND s.external_id = r.external_id)"""
ORACLES["ingest_filter"] = f"SELECT id, source, external_id FROM {USABLE} u"
ORACLES["ingest_normalize"] = f"""SELECT * FROM (
 SELECT 'play_store' AS source, reviewId AS external_id, coalesce(nullif(userName, ''), 'anonymous') AS author,
        {strip("coalesce(content, '')")} AS body, CAST(floor(CAST(score AS DOUBLE)) AS INT) AS rating,
        strftime(make_timestamp(2024, 1, 1 + conv_id % 28, 1, 30, 0) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS created_at, conv_id, turn
 FROM raw_reviews) n WHERE length(body) >= 20"""
ORACLES["ingest_dedup"] = FRESH
ORACLES["ingest_dedup_keyless"] = f"""SELECT id, source, CASE WHEN source <> 'en' THEN external_id END AS external_id FROM (
 SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY id) AS nth FROM plain_items) r
 WHERE source = 'en' OR (nth = 1 AND NOT EXISTS (SELECT 1 FROM {STORED_KEYS} s WHERE s.source = r.source AND s.external_id = r.external_id))"""
ORACLES["ingest_counts"] = f"""SELECT (SELECT count(*) FROM plain_items) AS incoming, (SELECT count(*) FROM {USABLE} a) AS usable,
 (SELECT count(*) FROM ({FRESH}) b) AS inserted"""
ORACLES["csv_import"] = f"""SELECT DISTINCT 'csv' AS source, lang AS author, CAST(trunc(n_chars / 10.0) AS INT) AS rating, md5({strip('text')}) AS body_md5
 FROM documents WHERE length({strip('text')}) >= 20"""

ORACLES["label_prompts"] = (
    f"SELECT id, md5(concat({text(labels.PROMPT_HEAD)}, body, {text(labels.PROMPT_TAIL)})) AS prompt_md5 FROM plain_items"
)
ORACLES["judge_prompts"] = f"""SELECT id, md5(concat({text(evaluation.JUDGE_HEAD)}, body, {text(evaluation.JUDGE_MIDDLE)}, fb_type,
 {text(evaluation.JUDGE_TAIL)})) AS prompt_md5 FROM feedback_items WHERE status = 'classified'"""

SPAN = r"regexp_extract(reply, '(?s)\{.*\}')"
ERROR = f"""CASE WHEN reply IS NULL THEN NULL WHEN {SPAN} = '' THEN {text(NO_OBJECT)}
 WHEN NOT json_valid({SPAN}) THEN {text(BROKEN_OBJECT)} END"""
READ = f"read AS (SELECT *, CASE WHEN {SPAN} <> '' AND json_valid({SPAN}) THEN {SPAN} END AS span, {ERROR} AS error FROM replies)"
SEVERITY_NUMBER = """CASE WHEN json_type(span, '$.severity') = 'VARCHAR'
   THEN CASE WHEN regexp_full_match(json_extract_string(span, '$.severity'), '[+-]?[0-9]+') THEN CAST(json_extract_string(span, '$.severity') AS DOUBLE) END
   ELSE trunc(try_cast(json_extract_string(span, '$.severity') AS DOUBLE)) END"""
VALIDATED = f"""{READ}, checked AS (
 SELECT item_id, error, CASE WHEN reply IS NULL THEN NULL WHEN span IS NULL THEN 'other'
   WHEN json_extract_string(span, '$.type') IN ('bug', 'feature_request', 'ux_friction', 'pricing', 'praise', 'churn_risk', 'question', 'other')
   THEN json_extract_string(span, '$.type') ELSE 'other' END AS fb_type,
  CASE WHEN reply IS NULL THEN NULL WHEN span IS NULL THEN 'unknown' ELSE substring(coalesce(json_extract_string(span, '$.area'), 'unknown'), 1, 50) END AS product_area,
  CASE WHEN reply IS NULL THEN NULL WHEN json_extract_string(span, '$.sentiment') IN ('positive', 'neutral', 'negative')
   THEN json_extract_string(span, '$.sentiment') ELSE 'neutral' END AS sentiment,
  CASE WHEN reply IS NULL THEN NULL ELSE CAST(greatest(1, least(4, coalesce({SEVERITY_NUMBER}, 2))) AS INT) END AS severity,
  CASE WHEN reply IS NULL THEN NULL WHEN span IS NULL THEN 0.0::DOUBLE
   ELSE greatest(0.0, least(1.0, coalesce(try_cast(json_extract_string(span, '$.confidence') AS DOUBLE), 0.5)))::DOUBLE END AS confidence
 FROM read)"""
ORACLES["reply_parse"] = f"WITH {READ} SELECT item_id, error FROM read"
ORACLES["reply_validate"] = f"WITH {VALIDATED} SELECT item_id, fb_type, product_area, sentiment, severity, confidence FROM checked"
EVENTS = "SELECT item_id, CAST(7 AS BIGINT) AS seq, CASE WHEN error IS NULL THEN 'label' ELSE 'fail' END AS kind"
ORACLES["label_run_events"] = f"""WITH {VALIDATED} {EVENTS}, """ + ", ".join(
    f"CASE WHEN error IS NULL THEN {field} END AS {field}" for field in LABEL_FIELDS
) + " FROM checked WHERE fb_type IS NOT NULL"
ORACLES["label_run_summary"] = f"""WITH {VALIDATED} SELECT count(*) FILTER (WHERE kind = 'label') AS classified,
 count(*) FILTER (WHERE kind = 'fail') AS failed FROM ({EVENTS} FROM checked WHERE fb_type IS NOT NULL) e"""


def keyword_case(field: int, body: str = "body") -> str:
    rules = [(words, values[field]) for words, *values in KEYWORD_RULES]
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({body}), {text(word)})" for word in words) + f" THEN {text(value) if isinstance(value, str) else value}"
        for words, value in rules
    )
    default = KEYWORD_DEFAULT[field]
    return f"CASE {cases} ELSE {text(default) if isinstance(default, str) else default} END"


ORACLES["keyword_labels"] = "SELECT id, " + ", ".join(
    f"CAST({keyword_case(at)} AS {kind}) AS {field}"
    for at, (field, kind) in enumerate(zip(LABEL_FIELDS, ["VARCHAR", "VARCHAR", "VARCHAR", "INT", "DOUBLE"], strict=True))
) + " FROM plain_items"
ORACLES["hooked_labels"] = """SELECT id, CASE WHEN length(body) % 2 = 1 THEN 'bug' ELSE 'other' END AS fb_type,
 CASE WHEN length(body) % 2 = 1 THEN 3 ELSE 2 END AS severity, CASE WHEN length(body) % 2 = 0 THEN '503 overloaded' END AS error FROM plain_items"""
ORACLES["error_classes"] = r"""SELECT id, regexp_matches(lower(message), '429|rate limit|rate_limit|resource_exhausted|too many requests|tokens per') AS rate_limit,
 CASE WHEN message IS NULL AND code IS NULL THEN NULL
  WHEN regexp_matches(lower(message), '429|rate limit|rate_limit|resource_exhausted|too many requests|tokens per') THEN 'rate_limit'
  WHEN code IN (500, 502, 503, 504) OR regexp_matches(lower(message), '500|502|503|504|overloaded|unavailable|timeout') THEN 'transient'
  ELSE 'permanent' END AS kind FROM failures"""

LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS back FROM label_log) b WHERE back = 1)"
FIXES = """fixes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS back FROM edits
 WHERE fb_type IN ('bug', 'feature_request', 'ux_friction', 'pricing', 'praise', 'churn_risk', 'question', 'other') AND severity BETWEEN 1 AND 4) b WHERE back = 1)"""
ORACLES["unlabeled_items"] = f"""WITH {LAST} SELECT p.id FROM plain_items p LEFT JOIN last l ON l.item_id = p.id
 WHERE l.kind IS NULL OR l.kind = 'reset'"""
ORACLES["corrections_current"] = f"WITH {FIXES} SELECT item_id, fb_type, severity FROM fixes"
ORACLES["current_state"] = f"""WITH {LAST}, {FIXES},
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS back FROM label_log WHERE kind <> 'reset') b WHERE back = 1),
chosen AS (
 SELECT p.id, x.item_id IS NOT NULL AS fixed, x.fb_type AS x_type, x.severity AS x_severity,
  CASE WHEN l.kind = 'reset' AND l.seq > x.seq THEN k.kind ELSE l.kind END AS kind,
  CASE WHEN l.kind = 'reset' AND l.seq > x.seq THEN k.fb_type ELSE l.fb_type END AS fb_type,
  CASE WHEN l.kind = 'reset' AND l.seq > x.seq THEN k.product_area ELSE l.product_area END AS product_area,
  CASE WHEN l.kind = 'reset' AND l.seq > x.seq THEN k.sentiment ELSE l.sentiment END AS sentiment,
  CASE WHEN l.kind = 'reset' AND l.seq > x.seq THEN k.severity ELSE l.severity END AS severity,
  CASE WHEN l.kind = 'reset' AND l.seq > x.seq THEN k.confidence ELSE l.confidence END AS confidence,
  r.theme_id
 FROM plain_items p LEFT JOIN last l ON l.item_id = p.id LEFT JOIN kept k ON k.item_id = p.id LEFT JOIN fixes x ON x.item_id = p.id
 LEFT JOIN theme_runs r ON r.item_id = p.id AND r.run_id = 2)
SELECT id, CASE kind WHEN 'label' THEN 'classified' WHEN 'fail' THEN 'failed' ELSE 'new' END AS status,
 CASE WHEN fixed THEN x_type ELSE fb_type END AS fb_type, product_area, sentiment, CASE WHEN fixed THEN x_severity ELSE severity END AS severity,
 confidence, CAST(fixed AS INT) AS human_corrected, theme_id FROM chosen"""
ORACLES["reset_state"] = (
    "SELECT id AS item_id, CAST(99 AS BIGINT) AS seq, 'reset' AS kind FROM feedback_items WHERE human_corrected = 0"
)

GOLDEN_SAMPLE = """SELECT id, body, fb_type AS gold_type, severity AS gold_severity, '' AS gold_notes FROM (
 SELECT *, row_number() OVER (PARTITION BY fb_type ORDER BY id) AS nth FROM feedback_items WHERE status = 'classified' AND fb_type IS NOT NULL) r WHERE nth <= 25"""
ORACLES["golden_sample"] = GOLDEN_SAMPLE
ORACLES["golden_files"] = f"""SELECT id, md5(body) AS body_md5, gold_type, CAST(gold_severity AS VARCHAR) AS gold_severity,
 CAST(NULL AS VARCHAR) AS gold_sentiment FROM ({GOLDEN_SAMPLE}) g"""
VERDICT_READ = f"read AS (SELECT *, CASE WHEN {SPAN} <> '' AND json_valid({SPAN}) THEN {SPAN} END AS span FROM verdict_replies)"
ORACLES["verdict_parse"] = f"""WITH {VERDICT_READ} SELECT item_id, fb_type,
 CASE WHEN span IS NOT NULL THEN coalesce(json_extract_string(span, '$.type_correct') IN ('true', '1'), false) END AS type_correct,
 coalesce(json_extract_string(span, '$.suggested_type'), fb_type) AS suggested_type,
 CASE WHEN span IS NULL THEN {text('judge error: ' + BROKEN_OBJECT)} ELSE substring(coalesce(json_extract_string(span, '$.reasoning'), ''), 1, 300) END AS reasoning,
 CASE WHEN span IS NULL THEN {text(BROKEN_OBJECT)} END AS error FROM read"""
CERTIFIED = """certified AS (
 SELECT f.id, f.fb_type AS predicted, trim(g.gold_type) AS gold_type, coalesce(trim(g.gold_type) = f.fb_type, false) AS human_correct,
  v.type_correct AS judge_correct,
  CASE WHEN v.type_correct = coalesce(trim(g.gold_type) = f.fb_type, false) THEN 'MATCH' ELSE 'MISMATCH' END AS result
 FROM golden g JOIN feedback_items f ON f.id = CAST(g.id AS BIGINT) JOIN verdicts v ON v.item_id = f.id
 WHERE trim(g.gold_type) <> '' AND v.type_correct IS NOT NULL)"""
ORACLES["judge_certify"] = f"WITH {CERTIFIED} SELECT * FROM certified"
ORACLES["judge_agreement"] = f"""WITH {CERTIFIED} SELECT count(*) FILTER (WHERE result = 'MATCH') AS agree, count(*) AS counted,
 CAST(count(*) FILTER (WHERE result = 'MATCH') AS DOUBLE) / count(*) AS agreement FROM certified"""
JUDGED = """judged AS (
 SELECT s.id, s.fb_type, v.type_correct, v.suggested_type, CASE WHEN v.type_correct THEN 'ok' WHEN NOT v.type_correct
  THEN concat('FLAG -> suggests ', v.suggested_type) ELSE 'judge error' END AS note
 FROM (SELECT * FROM feedback_items WHERE status = 'classified' ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id LIMIT 50) s
 LEFT JOIN verdicts v ON v.item_id = s.id)"""
ORACLES["judge_sample"] = f"WITH {JUDGED} SELECT * FROM judged"
ORACLES["sampled_accuracy"] = f"""WITH {JUDGED} SELECT count(*) FILTER (WHERE type_correct) AS correct, count(*) FILTER (WHERE NOT type_correct) AS wrong,
 count(*) FILTER (WHERE type_correct IS NULL) AS errors,
 CAST(count(*) FILTER (WHERE type_correct) AS DOUBLE) / count(type_correct) AS accuracy FROM judged"""
ORACLES["golden_accuracy"] = """SELECT fb_type, count(*) AS rows,
 CAST(count(*) FILTER (WHERE trim(gold_type) = fb_type) AS DOUBLE) / count(*) AS type_accuracy,
 CAST(count(*) FILTER (WHERE CAST(gold_severity AS INT) = severity) AS DOUBLE) / count(CAST(gold_severity AS INT) = severity) AS severity_accuracy
 FROM golden g JOIN feedback_items f ON f.id = CAST(g.id AS BIGINT) WHERE trim(gold_type) <> '' AND fb_type IS NOT NULL GROUP BY ROLLUP (fb_type)"""
ORACLES["correction_rate"] = """SELECT CAST(count(*) FILTER (WHERE status = 'classified' AND human_corrected = 1) AS DOUBLE)
  / count(*) FILTER (WHERE status = 'classified') AS correction_rate, CAST(count(theme_id) AS DOUBLE) / count(*) AS themed_share FROM feedback_items"""

ORACLES["cache_misses"] = """SELECT DISTINCT sha256(body) AS body_hash, md5(body) AS body_md5 FROM plain_items
 WHERE body NOT IN (SELECT p.body FROM plain_items p JOIN labels l ON l.doc_id = p.id)"""
ORACLES["cached_vectors"] = "SELECT id, CAST(CAST(length(body) AS FLOAT) AS DOUBLE) AS chars FROM plain_items"
ORACLES["theme_k"] = """SELECT items, CAST(greatest(4, least(8, round_even(items / 18.0::DOUBLE, 0))) AS INT) AS k FROM (
 SELECT count(*) AS items FROM feedback_items WHERE status = 'classified' AND fb_type <> 'praise') n"""
AREAS = """areas AS (SELECT theme_id, area FROM (
 SELECT theme_id, area, row_number() OVER (PARTITION BY theme_id ORDER BY n DESC, first_id) AS nth FROM (
  SELECT theme_id, coalesce(nullif(product_area, ''), 'general') AS area, count(*) AS n, min(id) AS first_id
  FROM feedback_items WHERE theme_id IS NOT NULL GROUP BY ALL) c) r WHERE nth = 1)"""
ORACLES["theme_top_area"] = f"WITH {AREAS} SELECT * FROM areas"
ORACLES["theme_names"] = f"""WITH {AREAS}, named AS (SELECT a.theme_id, a.area, CASE WHEN {SPAN} <> '' THEN {SPAN} END AS span
  FROM areas a LEFT JOIN name_replies r ON r.theme_id = a.theme_id)
 SELECT theme_id AS id, CASE WHEN span IS NULL THEN concat(upper(substring(area, 1, 1)), lower(substring(area, 2)), ' issues')
   ELSE substring(coalesce(json_extract_string(span, '$.name'), 'Unnamed'), 1, 60) END AS name,
  CASE WHEN span IS NULL THEN {text(UNNAMED_SUMMARY)} ELSE substring(coalesce(json_extract_string(span, '$.summary'), ''), 1, 200) END AS summary FROM named"""
ORACLES["theme_sample_text"] = """SELECT theme_id, string_agg(concat('- ', substring(body, 1, 160)), chr(10) ORDER BY id) AS sample FROM (
 SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY id) AS nth FROM feedback_items WHERE theme_id IS NOT NULL) r WHERE nth <= 12 GROUP BY theme_id"""
FLAT = """flat AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS mean FROM flat GROUP BY label, pos)"""
ORACLES["theme_centroids"] = f"WITH {FLAT} SELECT label AS theme_id, CAST(pos - 1 AS INT) AS pos, round_even(mean * 1000000, 0) / 1000000 AS mean FROM means"
ORACLES["nearest_centroid"] = f"""WITH {FLAT}, far AS (
 SELECT f.vec_id, m.label, round(sum((f.x - m.mean) * (f.x - m.mean)), 6) AS distance FROM flat f JOIN means m ON m.pos = f.pos GROUP BY f.vec_id, m.label)
SELECT vec_id AS id, CAST(label AS BIGINT) AS theme_id, distance FROM (
 SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) AS nth FROM far) r WHERE nth = 1"""
ORACLES["silhouette"] = f"""WITH {FLAT}, sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
norms AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS norm FROM flat GROUP BY vec_id),
unit AS (SELECT f.vec_id, f.label, f.pos, f.x / n.norm AS x FROM flat f JOIN norms n ON n.vec_id = f.vec_id),
centers AS (SELECT label, pos, avg(x) AS mean FROM unit GROUP BY label, pos),
apart AS (SELECT u.vec_id, u.label AS own, c.label AS other, 1 - sum(u.x * c.mean) AS distance FROM unit u JOIN centers c ON c.pos = u.pos GROUP BY ALL),
sides AS (SELECT vec_id, any_value(CASE WHEN s.n > 1 THEN s.n END) AS n,
  max(CASE WHEN own = other THEN distance * s.n / (s.n - 1) END) AS within, min(CASE WHEN own <> other THEN distance END) AS beyond
  FROM apart JOIN sizes s ON s.label = own GROUP BY vec_id)
SELECT round(avg((beyond - within) / greatest(beyond, within)), 6) AS silhouette FROM sides"""

POOL = """pool AS (SELECT theme_id, CAST(nth AS INT) AS rank, id, fb_type, severity, body FROM (
 SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY severity DESC NULLS LAST, id) AS nth FROM feedback_items WHERE theme_id IS NOT NULL) r WHERE nth <= 30)"""
SIBLINGS = f"""{POOL}, related AS (SELECT * FROM (
 SELECT f.id, CAST(row_number() OVER (PARTITION BY f.id ORDER BY p.rank) AS INT) AS rank, p.id AS sibling_id, p.fb_type, p.severity, p.body
 FROM feedback_items f JOIN pool p ON p.theme_id = f.theme_id AND p.id <> f.id AND p.rank <= 7) r WHERE rank <= 6)"""
ORACLES["evidence_top30"] = f"WITH {POOL} SELECT * FROM pool"
ORACLES["siblings"] = f"WITH {SIBLINGS} SELECT id, rank, sibling_id FROM related"
ORACLES["sibling_preview"] = f"""WITH {SIBLINGS} SELECT id, string_agg(concat('**[#', CAST(sibling_id AS VARCHAR), ']** (', fb_type, ', sev ',
 CAST(severity AS VARCHAR), '): ', substring(body, 1, 220)), chr(10) ORDER BY rank) AS preview FROM related GROUP BY id"""


def cites(drafts: str, keys: str) -> str:
    return f"""cites AS (SELECT DISTINCT {keys}, CAST(unnest(regexp_extract_all(markdown, '#([0-9]+)', 1)) AS BIGINT) AS cited FROM {drafts})"""


THEME_CITES = f"""{POOL}, {cites('theme_drafts', 'theme_id, draft')},
judged AS (SELECT c.theme_id, c.draft, c.cited, p.id, p.fb_type, p.severity, p.body FROM cites c LEFT JOIN pool p ON p.theme_id = c.theme_id AND p.id = c.cited)"""
REVIEW_CITES = f"""{SIBLINGS}, {cites('review_drafts', 'item_id')},
shown AS (SELECT id AS item_id, id, fb_type, severity, body FROM feedback_items
 UNION ALL SELECT id AS item_id, sibling_id, fb_type, severity, body FROM related),
judged AS (SELECT c.item_id, c.cited, s.id, s.fb_type, s.severity, s.body FROM cites c LEFT JOIN shown s ON s.item_id = c.item_id AND s.id = c.cited)"""
COUNTS = "CAST(count(*) AS INT) AS n_cited, CAST(count(id) AS INT) AS n_valid, CAST(count(*) FILTER (WHERE id IS NULL) AS INT) AS n_hallucinated"
ORACLES["citation_check"] = f"WITH {THEME_CITES} SELECT theme_id, draft, {COUNTS} FROM judged GROUP BY theme_id, draft"
ORACLES["review_citation_check"] = f"WITH {REVIEW_CITES} SELECT item_id, {COUNTS} FROM judged GROUP BY item_id"
ORACLES["citation_ids"] = f"""WITH {THEME_CITES} SELECT theme_id, draft, string_agg(CAST(cited AS VARCHAR), ',' ORDER BY cited) AS cited,
 coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE id IS NOT NULL), '') AS valid,
 coalesce(string_agg(CAST(cited AS VARCHAR), ',' ORDER BY cited) FILTER (WHERE id IS NULL), '') AS hallucinated FROM judged GROUP BY theme_id, draft"""


def report(drafts: str, keys: str, judged: str) -> str:
    flagged = "string_agg(CAST(cited AS VARCHAR), ', ' ORDER BY cited) FILTER (WHERE id IS NULL)"
    line = "concat(chr(10), '- **[#', CAST(id AS VARCHAR), ']** (', fb_type, ', sev ', CAST(severity AS VARCHAR), '): \"', substring(body, 1, 280), '\"')"
    return f"""WITH {judged}, parts AS (SELECT {keys}, {COUNTS}, {flagged} AS flagged,
  coalesce(string_agg({line}, '' ORDER BY id) FILTER (WHERE id IS NOT NULL), '') AS evidence FROM judged GROUP BY {keys})
 SELECT {keys}, concat({strip('d.markdown')}, chr(10), {text(REPORT_HEAD)}, chr(10), {text(REPORT_FOUND)}, CAST(n_cited AS VARCHAR), '**', chr(10),
  {text(REPORT_VALID)}, CAST(n_valid AS VARCHAR), '**', chr(10), {text(REPORT_HALLUCINATED)}, CAST(n_hallucinated AS VARCHAR), '**',
  CASE WHEN flagged IS NULL THEN ' - none' ELSE concat(' - flagged: [', flagged, ']') END, chr(10), {text(EVIDENCE_HEAD)}, evidence, chr(10)) AS markdown
 FROM {drafts} d JOIN parts p USING ({keys})"""


ORACLES["citation_report"] = report("theme_drafts", "theme_id, draft", THEME_CITES)
ORACLES["review_report"] = report("review_drafts", "item_id", REVIEW_CITES)
ORACLES["report_files"] = f"WITH {THEME_CITES} SELECT CAST(theme_id * 1000000 + draft AS BIGINT) AS target_id, {COUNTS} FROM judged GROUP BY theme_id, draft"
ORACLES["report_counters"] = f"""SELECT doc_id, CAST(nullif(regexp_extract(markdown, 'Citations found: \\*\\*([0-9]+)', 1), '') AS INT) AS n_cited,
 CAST(nullif(regexp_extract(markdown, 'Valid [^:]*: \\*\\*([0-9]+)', 1), '') AS INT) AS n_valid,
 CAST(nullif(regexp_extract(markdown, 'Hallucinated[^:]*: \\*\\*([0-9]+)', 1), '') AS INT) AS n_hallucinated FROM reports"""
ORACLES["quote_check"] = r"""WITH runs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\p{L} ,]+')) AS quote FROM documents),
pairs AS (SELECT doc_id, doc_id AS item_id, quote FROM runs UNION ALL SELECT doc_id, doc_id + 1, quote FROM runs)
SELECT p.doc_id, p.item_id, p.quote, coalesce(contains(x.text, p.quote), false) AS found FROM pairs p LEFT JOIN documents x ON x.doc_id = p.item_id"""


def item_line(item: str, chars: int) -> str:
    return f"concat('[#', CAST({item} AS VARCHAR), '] (', fb_type, ', sev ', CAST(severity AS VARCHAR), '): ', substring(body, 1, {chars}))"


GUIDANCE = "'\n\nGuidance from the product manager, to be reflected in the sections it concerns:\nAndroid first\n'"
ORACLES["theme_pack"] = f"""WITH {SCORED}, {POOL}, shown AS (SELECT theme_id, string_agg({item_line('id', packs.THEME_CHARS)}, chr(10) ORDER BY rank) AS evidence FROM pool GROUP BY theme_id)
 SELECT n.theme_id, concat('Theme to write about: ', name, chr(10), 'What it is about: ', summary, chr(10), 'Size: ', CAST(reach AS VARCHAR), ' items; mean severity (1 to 4): ',
  CAST(impact AS VARCHAR), '; score: ', printf('%.1f', rice_score), chr(10), chr(10), 'Items, each under the number that cites it:', chr(10), evidence, chr(10), {GUIDANCE}) AS pack
 FROM ({NAMED}) n LEFT JOIN shown s ON s.theme_id = n.theme_id"""
ORACLES["review_pack"] = f"""WITH {SIBLINGS}, shown AS (SELECT id, string_agg({item_line('sibling_id', packs.SIBLING_CHARS)}, chr(10) ORDER BY rank) AS others FROM related GROUP BY id)
 SELECT f.id, concat('Item to write about, cited as [#', CAST(f.id AS VARCHAR), ']. Label: ', f.fb_type, '; severity (1 to 4): ', CAST(f.severity AS VARCHAR), '. In full:', chr(10), '\"\"\"', f.body, '\"\"\"', chr(10),
  CASE WHEN others IS NULL THEN '' ELSE concat(chr(10), 'Related feedback of the same theme, which may be cited too:', chr(10), others, chr(10)) END) AS pack
 FROM feedback_items f LEFT JOIN shown s ON s.id = f.id WHERE f.status = 'classified'"""
ORACLES["memo_document"] = f"""WITH {SCORED}, {LINES}, panel AS (SELECT string_agg(concat('## ', fb_type, chr(10), CAST(items AS VARCHAR), ' items'), concat(chr(10), chr(10)) ORDER BY fb_type) AS parts
  FROM (SELECT fb_type, count(*) AS items FROM feedback_items WHERE status = 'classified' GROUP BY fb_type) t)
 SELECT 'memo' AS target_kind, concat('# Prioritization Boardroom — Decision Memo', chr(10), chr(10), '## Roadmap considered', chr(10),
  (SELECT string_agg(line, chr(10) ORDER BY position) FROM lines), chr(10), chr(10), '# Panel debate', chr(10), (SELECT parts FROM panel), chr(10), chr(10), '---', chr(10), 'Done.', chr(10)) AS markdown"""
PANEL = """(SELECT string_agg(concat('### ', fb_type, chr(10), CAST(items AS VARCHAR), ' items'), concat(chr(10), chr(10)) ORDER BY fb_type)
  FROM (SELECT fb_type, count(*) AS items FROM feedback_items WHERE status = 'classified' GROUP BY fb_type) t)"""
ROADMAP = "(SELECT string_agg(line, chr(10) ORDER BY position) FROM lines)"
ORACLES["decision_pack"] = f"""WITH {SCORED}, {LINES} SELECT concat('Themes, the best score first:', chr(10), {ROADMAP}, chr(10), chr(10), 'What each role says:', chr(10),
 {PANEL}, chr(10)) AS pack"""
ORACLES["opinion_packs"] = f"""WITH {SCORED}, {LINES} SELECT fb_type AS position, fb_type AS role, concat('Speak for this role: ', fb_type, '. ', CAST(items AS VARCHAR), ' items',
 chr(10), chr(10), 'Themes, the best score first:', chr(10), {ROADMAP}, chr(10)) AS pack
 FROM (SELECT fb_type, count(*) AS items FROM feedback_items WHERE status = 'classified' GROUP BY fb_type) t"""
ORACLES["brief_pack"] = f"""WITH {BRIEF} SELECT concat('Last day counted: ', week_ending, '. Items of the week in themes: ', CAST(total_recent AS VARCHAR), '.', chr(10), chr(10),
 'Each theme, the week before and this week:', chr(10), movement, chr(10), chr(10), 'Best score: ', top_theme, ', with ', top_score, '.', chr(10)) AS pack FROM brief"""
JUDGE_PROMPT = f"concat({text(evaluation.JUDGE_HEAD)}, body, {text(evaluation.JUDGE_MIDDLE)}, fb_type, {text(evaluation.JUDGE_TAIL)})"
ORACLES["hooked_verdicts"] = f"""SELECT id AS item_id, fb_type, CASE WHEN length({JUDGE_PROMPT}) % 2 = 0 THEN true END AS type_correct,
 CASE WHEN length({JUDGE_PROMPT}) % 2 = 1 THEN 'quota' END AS error FROM feedback_items WHERE status = 'classified'"""
ORACLES["theme_docs"] = f"""WITH {SCORED}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY updated_at DESC) AS back
  FROM versions WHERE target_kind = 'theme') v WHERE back = 1)
 SELECT s.theme_id, s.rice_score, n.markdown AS draft_prd, n.updated_at FROM scored s LEFT JOIN newest n ON n.target_id = s.theme_id"""

WRITTEN = f"""{POOL}, hooked AS (SELECT p.theme_id, concat('Plan: ', string_agg(concat('[#', CAST(p.id AS VARCHAR), ']'), ' ' ORDER BY p.rank), ' and [#999999999]') AS markdown
  FROM pool p JOIN themes t ON t.id = p.theme_id WHERE t.name <> 'theme 3' GROUP BY p.theme_id), {cites('hooked', 'theme_id')},
 judged AS (SELECT c.theme_id, c.cited, p.id, p.fb_type, p.severity, p.body FROM cites c LEFT JOIN pool p ON p.theme_id = c.theme_id AND p.id = c.cited)"""
ORACLES["theme_document_run"] = f"""WITH drafted AS ({report('hooked', 'theme_id', WRITTEN)}), {SCORED}
 SELECT s.theme_id, r.markdown, CASE WHEN t.name = 'theme 3' THEN 'quota' END AS error
 FROM scored s JOIN themes t ON t.id = s.theme_id LEFT JOIN drafted r ON r.theme_id = s.theme_id"""
REVIEWED = f"""{SIBLINGS}, hooked AS (SELECT f.id AS item_id, concat('Plan: [#', CAST(f.id AS VARCHAR), ']',
   coalesce(string_agg(concat(' [#', CAST(r.sibling_id AS VARCHAR), ']'), '' ORDER BY r.rank) FILTER (WHERE r.sibling_id IS NOT NULL), ''), ' and [#999999999]') AS markdown
  FROM feedback_items f LEFT JOIN related r ON r.id = f.id WHERE f.status = 'classified' GROUP BY f.id), {cites('hooked', 'item_id')},
 shown AS (SELECT id AS item_id, id, fb_type, severity, body FROM feedback_items UNION ALL SELECT id AS item_id, sibling_id, fb_type, severity, body FROM related),
 judged AS (SELECT c.item_id, c.cited, s.id, s.fb_type, s.severity, s.body FROM cites c LEFT JOIN shown s ON s.item_id = c.item_id AND s.id = c.cited)"""
ORACLES["review_document_run"] = f"SELECT item_id, markdown, CAST(NULL AS VARCHAR) AS error FROM ({report('hooked', 'item_id', REVIEWED)}) r"
ORACLES["brief_run"] = ORACLES["brief_document"]
ORACLES["memo_run"] = (
    ORACLES["memo_document"]
    .replace("CAST(items AS VARCHAR), ' items')", "'Speak for this role: ', fb_type, '. ', CAST(items AS VARCHAR), ' items')")
    .replace("'Done.'", "(SELECT concat(CAST(count(DISTINCT fb_type) AS VARCHAR), ' voices.') FROM feedback_items WHERE status = 'classified')")
)
APPROVED = f"SELECT id AS item_id, CASE WHEN length({JUDGE_PROMPT}) % 2 = 0 THEN true END AS type_correct, fb_type AS suggested_type FROM feedback_items WHERE status = 'classified'"
ORACLES["golden_run"] = ORACLES["judge_certify"].replace(" verdicts ", f" ({APPROVED}) ")
ORACLES["sample_run"] = ORACLES["judge_sample"].replace(" verdicts ", f" ({APPROVED}) ")

KEPT = f"""kept AS (SELECT source, external_id, author, {strip('body')} AS body FROM (
 SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY id) AS nth FROM feedback_items WHERE length({strip('body')}) >= 20) r WHERE nth = 1)"""
ORACLES["batch_runs"] = f"""WITH {KEPT}, typed AS (SELECT *, {keyword_case(0)} AS fb_type, {keyword_case(3)} AS severity FROM kept)
 SELECT source, external_id, author, 'classified' AS status, CASE WHEN fb_type = 'question' THEN 'bug' ELSE fb_type END AS fb_type,
  CAST(CASE WHEN fb_type = 'question' THEN 4 ELSE severity END AS INT) AS severity, CAST(fb_type = 'question' AS INT) AS human_corrected FROM typed"""
ORACLES["retry_run"] = f"WITH {KEPT} SELECT source, external_id, CAST(1 + length(body) % 3 AS BIGINT) AS seq, 'bug' AS fb_type FROM kept"
ORACLES["theme_run"] = ORACLES["theme_restart"] = f"""WITH {KEPT}, typed AS (SELECT *, {keyword_case(0)} AS fb_type FROM kept),
 counted AS (SELECT count(*) AS n FROM typed WHERE fb_type <> 'praise')
 SELECT source, external_id, fb_type, fb_type <> 'praise' AS themed,
  CAST(greatest(4, least(8, round_even(n / 18.0::DOUBLE, 0))) AS INT) AS themes, CAST(n AS INT) AS reach FROM typed CROSS JOIN counted"""


def _mixed(x: str) -> str:
    """splitmix64 of an unsigned 64-bit expression; products are taken in 128 bits."""
    word = "18446744073709551616::UHUGEINT"
    z = f"(({x})::UHUGEINT + 11400714819323198485::UHUGEINT) % {word}"
    for shift, factor in ((30, 13787848793156543929), (27, 10723151780598845931)):
        z = f"(xor(({z})::UBIGINT, ({z})::UBIGINT >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {word}"
    return f"xor(({z})::UBIGINT, ({z})::UBIGINT >> 31)"


def kmeans_sql(k: int = 8, seeds: range = range(42, 52), steps: int = 20) -> str:
    """k-means in SQL: a race of hashed draws for each further centre, then a chain of Lloyd steps on whole numbers."""
    apart = "(list_inner_product({0}, {0}) + list_inner_product({1}, {1}) - 2 * list_inner_product({0}, {1}))"
    draws = ", ".join(f"({seed}::BIGINT, {number}, {(seed << 32) + number}::UBIGINT)" for seed in seeds for number in range(k))
    parts = [
        "p AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda v: floor(v::DOUBLE * 16777216 + 0.5)) AS x FROM embeddings)",
        f"salts AS MATERIALIZED (SELECT seed, number, {_mixed('salt')} AS salt FROM (VALUES {draws}) t(seed, number, salt))",
        f"mixed_ids AS MATERIALIZED (SELECT id, {_mixed('id::UBIGINT')} AS m FROM p)",
        "salted AS MATERIALIZED (SELECT seed, number, id, xor(m, salt) AS s FROM mixed_ids, salts)",
        f"draws AS MATERIALIZED (SELECT seed, number, id, -ln((({_mixed('s')} >> 11)::DOUBLE + 0.5) / 9007199254740992.0::DOUBLE) AS t FROM salted)",
        "w0 AS MATERIALIZED (SELECT seed, arg_min(x, t) AS x FROM p JOIN draws USING (id) WHERE number = 0 GROUP BY seed)",
        f"d0 AS MATERIALIZED (SELECT seed, id, p.x, {apart.format('p.x', 'w0.x')} AS d FROM p, w0)",
    ]
    for at in range(1, k):
        parts += [
            f"w{at} AS MATERIALIZED (SELECT seed, arg_min(x, t / d) AS x FROM d{at - 1} JOIN draws USING (seed, id) WHERE number = {at} AND d > 0 GROUP BY seed)",
            f"d{at} AS MATERIALIZED (SELECT seed, id, o.x, least(o.d, {apart.format('o.x', f'w{at}.x')}) AS d FROM d{at - 1} o JOIN w{at} USING (seed))",
        ]
    parts.append("m0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT seed, {at} AS c, x FROM w{at}" for at in range(k)) + ")")
    for step in range(steps + 1):
        nearest = f"min(struct_pack(d := {apart.format('p.x', f'm{step}.x')}, c := c))"
        parts.append(f"a{step} AS MATERIALIZED (SELECT seed, id, any_value(p.x) AS x, {nearest} AS best FROM p, m{step} GROUP BY seed, id)")
        if step < steps:
            sums = f"SELECT seed, c, place, floor((2 * sum(v) + count(*)) / (2 * count(*))) AS v FROM (SELECT seed, best.c AS c, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM a{step}) GROUP BY seed, c, place"
            moved = f"SELECT seed, c, list(v ORDER BY place) AS x FROM ({sums}) GROUP BY seed, c"
            kept = f"SELECT seed, c, x FROM m{step} ANTI JOIN (SELECT DISTINCT seed, best.c AS c FROM a{step}) USING (seed, c)"
            parts.append(f"m{step + 1} AS MATERIALIZED ({moved} UNION ALL {kept})")
    parts.append(f"costs AS (SELECT seed, sum(best.d::HUGEINT) AS cost FROM a{steps} GROUP BY seed ORDER BY cost, seed LIMIT 1)")
    return f"WITH {', '.join(parts)} SELECT id, best.c::INTEGER AS cluster, seed AS start, cost::VARCHAR AS cost FROM a{steps} JOIN costs USING (seed)"


ORACLES["bucketed_state"] = ORACLES["current_state"]
ORACLES["kmeans_themes"] = kmeans_sql()
ORACLES["filtered_imports"] = f"""WITH batches AS (
  SELECT CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = u.id) THEN 1 WHEN source = 'en' THEN 2 ELSE 3 END::BIGINT AS import_no,
         source, external_id, id AS arrival FROM {USABLE} u),
 firsts AS (SELECT source, external_id, min(struct_pack(import_no := import_no, arrival := arrival)) AS f FROM batches GROUP BY source, external_id)
 SELECT row_number() OVER (ORDER BY f) - 1 AS id, source, external_id, f.import_no AS import_no FROM firsts"""
ORACLES["script_vectors"] = "SELECT id, CAST(1.0 AS DOUBLE) AS squared_length FROM plain_items WHERE body <> ''"
ORACLES["overlong_citations"] = """SELECT id, concat(CAST(id AS VARCHAR), ',', least_one, ',', most) AS cited, CAST(id AS VARCHAR) AS valid,
 concat(least_one, ',', most) AS hallucinated FROM (
 SELECT id, concat('1', repeat('0', 25), CAST(id AS VARCHAR)) AS most, concat(repeat('9', 25), CAST(id AS VARCHAR)) AS least_one FROM plain_items) n"""
ORACLES["huge_numbers"] = """SELECT item_id, CAST([4, 1, 4, 2, 2, 1][1 + item_id % 6] AS INT) AS severity,
 CAST([1.0, 0.0, 1.0, 1.0, 1.0, 7e-310][1 + item_id % 6] AS DOUBLE) AS confidence FROM replies"""
ORACLES["stream_ingest"] = f"""WITH {KEPT} SELECT source, external_id, author, 'classified' AS status, {keyword_case(0)} AS fb_type,
 CAST({keyword_case(3)} AS INT) AS severity FROM kept"""

ORACLES = {name: with_views(sql) for name, sql in ORACLES.items()}
