"""Queries of the answering operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers
from ..functions import text as fn
from ..operators import answers, metrics
from .common import CHUNKS, asked, chunk_table, table, tokens_sql


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Each question's results with their text, scored by the reranker's score."""
    found = table(spark, d, "search_results").groupBy("query_id", "query_text", "chunk_id").agg(F.max(F.when(~F.isnan("rerank_score"), F.col("rerank_score"))).alias("score"))
    return found.join(chunk_table(spark, d).select("chunk_id", "url", "domain", "heading", "text"), "chunk_id")


def evidence_select(spark: SparkSession, d: str) -> DataFrame:
    return answers.evidence(_results(spark, d)).select("query_id", "source", "chunk_id", F.length("snippet").alias("chars"))


def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    """The best sentences as the answer to every question."""
    return answers.extractive_answers(_results(spark, d)).select("query_id", "source", "sentence")


def process_answer(spark: SparkSession, d: str) -> DataFrame:
    """The steps told in the results of every question."""
    return answers.process_steps(_results(spark, d))


def _payload(spark: SparkSession, d: str) -> DataFrame:
    results = _results(spark, d)
    bullets = answers.extractive_answers(results).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source", "sentence"))).alias("l"))  # five at most
    told = bullets.select("query_id", F.array_join(F.transform("l", lambda x: F.concat(x["sentence"], F.lit(" [source "), x["source"].cast("string"), F.lit("]"))), "\n").alias("answer"))
    return answers.answer_payload(asked(spark, d).select("query_id").join(told, "query_id", "left"), answers.evidence(results))


def answer_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Answers with linked citations."""
    return _payload(spark, d).select("query_id", "answer", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"), "insufficient")


def answer_events(spark: SparkSession, d: str) -> DataFrame:
    """The answers as a stream of events."""
    return answers.answer_events(providers.upgrade_questions(asked(spark, d)), _results(spark, d), _payload(spark, d))


def generated_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the offline generator: the extractive ones, or that the evidence isn't enough."""
    results = _results(spark, d)
    bullets = answers.extractive_answers(results).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source", "bullet"))).alias("l"))  # five at most
    told = bullets.select("query_id", F.array_join(F.transform("l", lambda x: x["bullet"]), "\n").alias("extractive"))
    asked_for = answers.prompts(asked(spark, d), answers.evidence(results)).join(told, "query_id", "left")
    return providers.generate(asked_for).select("query_id", "answer")


def answer_event_texts(spark: SparkSession, d: str) -> DataFrame:
    """The order and kind of the events, with the words of the answers and the whole answers."""
    text = F.when(F.col("type") == "delta", F.get_json_object("payload", "$.delta")).when(F.col("type") == "final", F.get_json_object("payload", "$.answer"))
    return answer_events(spark, d).select("query_id", "seq", "type", text.alias("text"))


def unsupported_values(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the answers that stand in none of their evidence, here after every answer was given a year."""
    payload = _payload(spark, d).where("answer IS NOT NULL").withColumn("answer", F.concat("answer", F.lit(" In 2031.")))
    return metrics.unsupported_values(payload, answers.evidence(_results(spark, d)))


def answer_quality(spark: SparkSession, d: str) -> DataFrame:
    """Answers, those without enough evidence, and the mean number of citations."""
    told = _payload(spark, d)
    return told.agg(F.count("*").alias("answers"), F.count_if("insufficient").alias("refused"), F.round(F.avg(F.size("citations")), 6).alias("citations"))


def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    return answers.prompts(asked(spark, d), answers.evidence(_results(spark, d)))


def citation_parse(spark: SparkSession, d: str) -> DataFrame:
    """Source numbers cited in a text, here that of the chunks with their positions cited."""
    said = chunk_table(spark, d).select("chunk_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" [source "), F.col("position").cast("string"), F.lit("] [Source  2](x) [source "), (F.col("position") % 3).cast("string"), F.lit("]")).alias("answer"))
    return said.select("chunk_id", F.explode(fn.citations_col(F.col("answer"))).alias("source"))


QUERIES = {f.__name__: f for f in (evidence_select, extractive_answer, process_answer, answer_payloads, answer_events, answer_prompts, generated_answers, answer_event_texts, unsupported_values, answer_quality, citation_parse)}

_RESULTS = f"""
    f AS (SELECT query_id, query_text, chunk_id, max(CASE WHEN NOT isnan(rerank_score) THEN rerank_score END) AS score FROM search_results GROUP BY ALL),
    r AS (SELECT query_id, query_text, chunk_id, score, url, domain, heading, text FROM f JOIN ({CHUNKS}) USING (chunk_id) WHERE score IS NOT NULL)"""
_SPACES = r"[\s\pZ\x{85}\x{0B}\x{1c}-\x{1f}]+"

_EVIDENCE = f"""
    es AS (SELECT *, trim(regexp_replace(text, '{_SPACES}', ' ', 'g')) AS t FROM r),
    ec AS (SELECT *, CASE WHEN length(t) > 1800 THEN substr(t, 1, 1800) || '...' ELSE t END AS snippet FROM es WHERE t <> ''),
    eu AS (SELECT * FROM ec QUALIFY row_number() OVER (PARTITION BY query_id, url, heading ORDER BY score DESC, chunk_id) = 1),
    en AS (SELECT *, row_number() OVER w AS source, sum(length(snippet)) OVER w AS total FROM eu WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING)),
    ev AS (SELECT * FROM en WHERE source <= 6 AND (source = 1 OR total <= 2600))"""
_TOLD = rf"""
    g AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM r WHERE trim(coalesce(text, '')) <> ''),
    k AS (SELECT * FROM g WHERE score >= greatest(0.18, 0.55 * top)
          UNION ALL SELECT * FROM (SELECT * FROM g WHERE top < greatest(0.18, 0.55 * top) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 2)),
    u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id, url, lower(trim(coalesce(heading, ''))), lower(trim(substr(trim(text), 1, 180))) ORDER BY score DESC, chunk_id) = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS source FROM u QUALIFY source <= 5),
    p AS (SELECT query_id, source, text, list_distinct({tokens_sql('query_text')}) AS q, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS xs FROM n),
    e AS (SELECT query_id, source, text, q, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM p),
    sc AS (SELECT query_id, source, text, x, i, CASE WHEN len({tokens_sql('x')}) > 0 THEN len(list_filter({tokens_sql('x')}, lambda t: list_contains(q, t)))::DOUBLE / len({tokens_sql('x')}) ELSE 0 END AS share FROM e),
    b AS (SELECT query_id, source, CASE WHEN share > 0 THEN x ELSE substr(trim(text), 1, 280) END AS sentence FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY share DESC, i) = 1),
    told AS (SELECT query_id, source, sentence FROM b QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(regexp_replace(sentence, '{_SPACES}', ' ', 'g'))) ORDER BY source) = 1)"""
_PAYLOAD = rf"""
    {_RESULTS}, {_EVIDENCE}, {_TOLD},
    raw AS (SELECT query_id, string_agg(sentence || ' [source ' || source || ']', chr(10) ORDER BY source) AS answer FROM told GROUP BY query_id),
    known AS (SELECT query_id, list(source ORDER BY source) AS sources FROM ev GROUP BY query_id),
    linked AS (SELECT t.query_id, string_agg(sentence || ' [source ' || t.source || ']' || CASE WHEN ev.url IS NOT NULL THEN '(' || ev.url || ')' ELSE '' END, chr(10) ORDER BY t.source) AS answer,
      list_sort(list_distinct(list(t.source) FILTER (ev.source IS NOT NULL))) AS cited FROM told t LEFT JOIN ev ON ev.query_id = t.query_id AND ev.source = t.source GROUP BY t.query_id),
    payload AS (SELECT a.query_id, linked.answer, known.sources IS NULL OR coalesce(regexp_matches(linked.answer, '(?i)\b(not enough evidence|insufficient evidence|cannot determine|can''t determine|don''t have enough evidence)\b'), true) AS insufficient, linked.cited
      FROM (SELECT DISTINCT query_id FROM search_results) a LEFT JOIN known USING (query_id) LEFT JOIN linked USING (query_id)),
    paid AS (SELECT query_id, answer, insufficient, CASE WHEN insufficient THEN [] ELSE coalesce(cited, []) END AS citations FROM payload)"""
_STEP = r"""^[\s\x{0B}]*(?:step[\s\x{0B}]*\d+|stage[\s\x{0B}]*\d+|\d+[.)]|[-*])[\s\x{0B}]*"""
_RULE_LINES = " || chr(10) || ".join("'" + r.replace("'", "''") + "'" for r in answers.RULES)

SQL = {
    "evidence_select": f"""
        WITH {_RESULTS},
        s AS (SELECT *, trim(regexp_replace(text, '{_SPACES}', ' ', 'g')) AS t FROM r),
        c AS (SELECT *, CASE WHEN length(t) > 1800 THEN 1803 ELSE length(t) END AS chars FROM s WHERE t <> ''),
        u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, url, heading ORDER BY score DESC, chunk_id) = 1),
        n AS (SELECT *, row_number() OVER w AS source, sum(chars) OVER w AS total FROM u WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING))
        SELECT query_id, source::INT AS source, chunk_id, chars::INT AS chars FROM n WHERE source <= 6 AND (source = 1 OR total <= 2600)""",
    "extractive_answer": rf"""
        WITH {_RESULTS},
        g AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM r WHERE trim(coalesce(text, '')) <> ''),
        k AS (SELECT * FROM g WHERE score >= greatest(0.18, 0.55 * top)
              UNION ALL SELECT * FROM (SELECT * FROM g WHERE top < greatest(0.18, 0.55 * top) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 2)),
        u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id, url, lower(trim(coalesce(heading, ''))), lower(trim(substr(trim(text), 1, 180))) ORDER BY score DESC, chunk_id) = 1),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS source FROM u QUALIFY source <= 5),
        p AS (SELECT query_id, source, text, list_distinct({tokens_sql('query_text')}) AS q, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS xs FROM n),
        e AS (SELECT query_id, source, text, q, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM p),
        sc AS (SELECT query_id, source, text, x, i, CASE WHEN len({tokens_sql('x')}) > 0 THEN len(list_filter({tokens_sql('x')}, lambda t: list_contains(q, t)))::DOUBLE / len({tokens_sql('x')}) ELSE 0 END AS share FROM e),
        b AS (SELECT query_id, source, CASE WHEN share > 0 THEN x ELSE substr(trim(text), 1, 280) END AS sentence FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY share DESC, i) = 1)
        SELECT query_id, source::INT AS source, sentence FROM b QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(regexp_replace(sentence, '{_SPACES}', ' ', 'g'))) ORDER BY source) = 1""",
    "answer_payloads": f"WITH {_PAYLOAD} SELECT query_id, answer, array_to_string(citations, ',') AS citations, insufficient FROM paid",
    "answer_event_texts": rf"""
        WITH {_PAYLOAD}, t AS (SELECT query_id, CASE WHEN trim(coalesce(answer, '')) = '' THEN 'Insufficient evidence.' ELSE answer END AS answer FROM paid),
        w AS (SELECT query_id, regexp_extract_all(answer, '^[\s\x{{0B}}]+|[^\s\x{{0B}}]+[\s\x{{0B}}]*') AS l, answer FROM t)
        SELECT query_id, s AS seq, k AS type, NULL AS text FROM t, (SELECT unnest([0, 1, 2]) AS s, unnest(['query_upgrade', 'retrieval', 'prompt']) AS k)
        UNION ALL SELECT query_id, 2 + unnest(range(1, len(l) + 1)), 'delta', unnest(l) FROM w UNION ALL SELECT query_id, 3 + len(l), 'final', answer FROM w""",
    "generated_answers": f"""
        WITH {_RESULTS}, {_TOLD}, w AS (SELECT told.query_id, string_agg('- ' || sentence || ' [source ' || told.source || '](' || n.url || ')', chr(10) ORDER BY told.source) AS answer FROM told JOIN n ON n.query_id = told.query_id AND n.source = told.source GROUP BY told.query_id)
        SELECT query_id, coalesce(answer, 'Insufficient evidence.') AS answer FROM (SELECT DISTINCT query_id FROM search_results) LEFT JOIN w USING (query_id)""",
    "answer_quality": f"WITH {_PAYLOAD} SELECT count(*) AS answers, count(*) FILTER (insufficient) AS refused, round(avg(len(citations)), 6) AS citations FROM paid",
    "answer_prompts": f"""
        WITH {_RESULTS}, {_EVIDENCE},
        l AS (SELECT query_id, string_agg('[source ' || source || ']' || chr(10) || 'URL: ' || coalesce(url, '') || chr(10) || 'Domain: ' || coalesce(domain, '') || chr(10) || 'Heading: ' || coalesce(heading, '') || chr(10) || 'Text: ' || snippet, chr(10) || chr(10) ORDER BY source) AS body FROM ev GROUP BY query_id)
        SELECT query_id, 'Question:' || chr(10) || trim(query_text) || chr(10) || chr(10) || 'Evidence:' || chr(10) || coalesce(body, '(none)') || chr(10) || chr(10) || {_RULE_LINES} AS prompt
        FROM (SELECT DISTINCT query_id, query_text FROM search_results) LEFT JOIN l USING (query_id)""",
    "unsupported_values": rf"""
        WITH {_PAYLOAD},
        said AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(regexp_replace(answer || ' In 2031.', '(?i)\[source\s+\d+\]', '', 'g'), '(\d+(?:[.,]\d+)*)', 1)) AS value FROM paid WHERE answer IS NOT NULL),
        has AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(snippet, '(\d+(?:[.,]\d+)*)', 1)) AS value FROM ev)
        SELECT query_id, value FROM said ANTI JOIN has USING (query_id, value)""",
    "process_answer": rf"""
        WITH {_RESULTS},
        ln AS (SELECT query_id, chunk_id, score, url, heading, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(trim(x), '(?i){_STEP}', ''))), lambda x: length(x) >= 24) AS l,
          list_filter(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), lambda x: length(x) >= 32) AS s FROM r),
        x AS (SELECT query_id, chunk_id, score, url, heading, CASE WHEN len(l) > 0 THEN l ELSE s END AS t, CASE WHEN coalesce(regexp_matches(heading, '(?i)\b(step|stage|application|process|how to apply|guide)\b'), false) THEN 1 ELSE 0 END AS m FROM ln),
        y AS (SELECT query_id, chunk_id, score, url, heading, m, unnest(t) AS text, unnest(range(len(t))) AS pos FROM x),
        o AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(regexp_replace(text, '{_SPACES}', ' ', 'g'))) ORDER BY m DESC, score DESC, chunk_id, pos) = 1),
        st AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, score DESC, chunk_id, pos) AS step FROM o QUALIFY step <= 6),
        so AS (SELECT query_id, url, heading, row_number() OVER (PARTITION BY query_id ORDER BY min(step)) AS source FROM st GROUP BY query_id, url, heading)
        SELECT st.query_id, step::INT AS step, CASE WHEN source <= 5 THEN source::INT END AS source, text FROM st JOIN so ON so.query_id = st.query_id AND so.url IS NOT DISTINCT FROM st.url AND so.heading IS NOT DISTINCT FROM st.heading""",
    "citation_parse": rf"""
        SELECT DISTINCT chunk_id, unnest(list_transform(regexp_extract_all(a, '(?i)\[source\s+(\d+)\]', 1), lambda x: x::INT)) AS source
        FROM (SELECT chunk_id, coalesce(text, '') || ' [source ' || position || '] [Source  2](x) [source ' || (position % 3) || ']' AS a FROM ({CHUNKS}))""",
}
