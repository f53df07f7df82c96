"""Evidence, extractive answers, citations and answer events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from .ranking import top_k_per_group

# Fixed value: what an answer says when the evidence isn't enough.
INSUFFICIENT = r"(?i)\b(not enough evidence|insufficient evidence|cannot determine|can't determine|don't have enough evidence)\b"
# A step's marker at the start of a line, the end of a sentence, and the rules and the system's role of a prompt.
STEP_MARK = r"(?i)^\s*(?:step\s*\d+|stage\s*\d+|\d+[.)]|[-*])\s*"
SENTENCE_END = r"(?<=[.!?])\s+"
RULES = (
    "Rules:",
    "- Use only evidence above.",
    "- Include citations in-line as markdown links: [source N](URL).",
    "- If at least one relevant fact exists, answer with those facts and cite them.",
    "- Say 'Insufficient evidence.' only when none of the evidence is relevant.",
)
NO_ANSWER = "Insufficient evidence."


def evidence(results: DataFrame, query: str = "query_id", most: int = 6, chunk_chars: int = 1800, total_chars: int = 2600) -> DataFrame:
    """``query, source, chunk_id, url, domain, heading, snippet``: the results an answer is made from.

    ``results`` has ``query, chunk_id, url, heading, text, score`` and perhaps ``domain``.  In the order of scores, of
    each (url, heading) the first; at most ``most``; up to the first snippet with which the
    characters exceed ``total_chars``, the first one in any case.  Lengths aren't negative, so
    the running sum decides the break.  Blank texts and null scores are left out.
    """
    snippet = fn.snippet_col(fn.squeezed_col(F.col("text")), chunk_chars)
    usable = results.withColumn("snippet", snippet).where("score IS NOT NULL AND NOT isnan(score) AND snippet <> ''")
    # the first of each (url, heading): combined on the map side
    domain = F.col("domain") if "domain" in results.columns else F.lit(None).cast("string")
    best = F.min_by(F.struct("chunk_id", "score", "snippet", domain.alias("domain")), F.struct((-F.col("score")).alias("s"), "chunk_id"))
    unique = usable.groupBy(query, "url", "heading").agg(best.alias("b")).select(query, "url", "heading", "b.*")
    first = top_k_per_group(unique, [query], [F.desc("score"), F.asc("chunk_id")], most)
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.asc("chunk_id"))
    summed = first.withColumn("source", F.row_number().over(order)).withColumn("chars", F.sum(F.length("snippet")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return summed.where((F.col("source") == 1) | (F.col("chars") <= total_chars)).select(query, "source", "chunk_id", "url", "domain", "heading", "snippet")


def above_floor(results: DataFrame, query: str = "query_id", least: float = 0.18, share: float = 0.55, fallback: int = 2) -> DataFrame:
    """Results with a score of at least max(``least``, ``share`` of the question's best); where
    none reaches it, the first ``fallback``."""
    top = results.groupBy(query).agg(F.max("score").alias("__top")).withColumn("__floor", F.greatest(F.lit(least), share * F.col("__top")))
    known = results.join(top, query)
    good = known.where(F.col("score") >= F.col("__floor"))
    none = known.where(F.col("__top") < F.col("__floor"))
    return good.unionByName(top_k_per_group(none, [query], [F.desc("score"), F.asc("chunk_id")], fallback)).drop("__top", "__floor")


def sentences_col(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def extractive_answers(results: DataFrame, query: str = "query_id", most: int = 5) -> DataFrame:
    """``query, source, sentence, bullet``: of each of the first results its best sentence.

    ``results`` has ``query, query_text, chunk_id, url, heading, text, score``.  Results below
    the floor fall out, then repeats of (url, heading, first 180 characters) without case.  A
    sentence's score is the share of its tokens that are question terms, the earliest wins; with
    none above 0 the first 280 characters stand in.  A repeated sentence is skipped, its source
    number stays used.
    """
    lower = lambda c, n=None: F.lower(F.trim(F.coalesce(c if n is None else F.substring(c, 1, n), F.lit(""))))
    usable = above_floor(results.where("score IS NOT NULL AND NOT isnan(score) AND trim(coalesce(text, '')) <> ''"), query)
    best = F.min_by(F.struct("query_text", "chunk_id", "score", "url", "heading", "text"), F.struct((-F.col("score")).alias("s"), "chunk_id"))
    unique = usable.groupBy(query, F.col("url").alias("k1"), lower(F.col("heading")).alias("k2"), lower(F.trim("text"), 180).alias("k3")).agg(best.alias("b")).select(query, "b.*")
    first = top_k_per_group(unique, [query], [F.desc("score"), F.asc("chunk_id")], most)
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.asc("chunk_id"))
    numbered = first.withColumn("source", F.row_number().over(order))
    terms = F.array_distinct(fn.tokens_col(F.col("query_text")))
    scored = numbered.withColumn("terms", terms).withColumn("s", F.transform(sentences_col(F.col("text")), lambda x, i: F.struct(F.when(F.size(fn.tokens_col(x)) > 0, F.size(F.filter(fn.tokens_col(x), lambda t: F.array_contains(F.col("terms"), t))) / F.size(fn.tokens_col(x))).otherwise(0.0).alias("share"), (-i).alias("at"), x.alias("x"))))
    chosen = F.array_max("s")
    sentence = F.when(chosen["share"] > 0, chosen["x"]).otherwise(F.substring(F.trim("text"), 1, 280))
    told = scored.select(query, "source", "url", sentence.alias("sentence"))
    again = Window.partitionBy(query, F.lower(fn.squeezed_col(F.col("sentence")))).orderBy("source")
    return told.withColumn("n", F.row_number().over(again)).where("n = 1").select(query, "source", "sentence", F.concat(F.lit("- "), F.col("sentence"), F.lit(" [source "), F.col("source").cast("string"), F.lit("]("), F.col("url"), F.lit(")")).alias("bullet"))


def process_steps(results: DataFrame, query: str = "query_id", most: int = 6, cited: int = 5) -> DataFrame:
    """``query, step, source, text``: steps found in the results, those under process headings first.

    A step is a line of 24 or more characters without its marker; a text without such lines
    gives its sentences of 32 or more.  Steps equal but for case and white space count once.
    Sources are numbered by the first step that uses a (url, heading); steps from later sources
    than ``cited`` keep the number null.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), STEP_MARK, ""))), lambda x: F.length(x) >= 24)
    told = F.when(F.size(lines) > 0, lines).otherwise(F.filter(sentences_col(F.coalesce("text", F.lit(""))), lambda x: F.length(x) >= 32))
    usable = results.where("score IS NOT NULL AND NOT isnan(score)").withColumn("match", fn.process_heading_col(F.col("heading")).cast("int"))
    parts = usable.select(query, "match", "score", "chunk_id", "url", "heading", F.posexplode(told).alias("at", "text"))
    place = F.struct((-F.col("match")).alias("m"), (-F.col("score")).alias("s"), "chunk_id", "at")
    unique = parts.groupBy(query, F.lower(fn.squeezed_col(F.col("text"))).alias("key")).agg(F.min(F.struct(place.alias("p"), "text", "url", "heading")).alias("b")).select(query, "b.*")
    first = top_k_per_group(unique, [query], [F.asc("p")], most)
    order = Window.partitionBy(query).orderBy("p")
    numbered = first.withColumn("step", F.row_number().over(order))
    sources = numbered.groupBy(query, "url", "heading").agg(F.min("step").alias("since"))
    sources = sources.withColumn("source", F.row_number().over(Window.partitionBy(query).orderBy("since")))
    told, known = numbered.alias("n"), sources.select(F.col(query).alias("sq"), F.col("url").alias("su"), F.col("heading").alias("sh"), "source")
    same = (F.col("n." + query) == F.col("sq")) & F.col("n.url").eqNullSafe(F.col("su")) & F.col("n.heading").eqNullSafe(F.col("sh"))
    return told.join(known, same).select("n." + query, "step", F.when(F.col("source") <= cited, F.col("source")).alias("source"), "n.text")


def prompts(questions: DataFrame, found: DataFrame, query: str = "query_id") -> DataFrame:
    """``query, prompt``: question, numbered evidence (``(none)`` without any) and rules for a generator."""
    said = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    part = F.concat_ws("\n", F.concat(F.lit("[source "), F.col("source").cast("string"), F.lit("]")), said("URL", F.col("url")), said("Domain", F.col("domain")), said("Heading", F.col("heading")), said("Text", F.col("snippet")))
    listed = found.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("source", part.alias("part")))).alias("l"))  # a few sources each
    body = F.coalesce(F.array_join(F.transform("l", lambda x: x["part"]), "\n\n"), F.lit("(none)"))
    return questions.join(listed, query, "left").select(query, F.concat(F.lit("Question:\n"), F.trim("query_text"), F.lit("\n\nEvidence:\n"), body, F.lit("\n\n" + "\n".join(RULES))).alias("prompt"))


def answer_payload(answers: DataFrame, found: DataFrame, query: str = "query_id") -> DataFrame:
    """``query, answer, citations, insufficient``: citations of known sources linked and listed in
    ascending order; an answer that says so, or one without evidence, is insufficient and cites nothing."""
    known = found.groupBy(query).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "url")))).alias("urls"))
    joined = answers.join(known, query, "left")
    missing = F.col("urls").isNull() | F.coalesce(F.col("answer").rlike(INSUFFICIENT), F.lit(True))
    cited = F.filter(fn.citations_col(F.col("answer")), lambda n: F.map_contains_key(F.col("urls"), n))
    linked = F.when(F.col("urls").isNull(), F.col("answer")).otherwise(fn.linked_citations_col(F.col("answer"), F.col("urls")))
    return joined.select(query, linked.alias("answer"), F.when(missing, F.array().cast("array<int>")).otherwise(cited).alias("citations"), missing.alias("insufficient"))


def answer_events(questions: DataFrame, results: DataFrame, payload: DataFrame, query: str = "query_id") -> DataFrame:
    """``query, seq, type, payload``: an answer as the events of its making, as JSON.

    ``query_upgrade`` (the question and what it was rewritten to), ``retrieval`` (the results by
    rank), ``prompt`` (the rules), a ``delta`` for every word of the answer, and ``final`` with
    the whole.  An answer that is empty is told as one delta that says so.
    ``questions``: query, original, upgraded; ``results``: as :func:`evidence` takes them.
    """
    order = F.struct((-F.col("score")).alias("s"), "chunk_id", "url", "heading", F.round("score", 4).alias("score"))
    ranked = results.where("score IS NOT NULL").groupBy(query).agg(F.array_sort(F.collect_list(order)).alias("l"))  # a question's results
    documents = F.transform("l", lambda x, n: F.struct((n + 1).alias("rank"), x["url"].alias("url"), x["heading"].alias("heading"), x["score"].alias("score"), x["chunk_id"].alias("chunk_id")))
    joined = questions.join(payload, query).join(ranked, query, "left").withColumn("answer", F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", NO_ANSWER).otherwise(F.col("answer")))
    event = lambda kind, body: F.struct(F.lit(kind).alias("type"), F.to_json(body).alias("payload"))
    before = F.array(
        event("query_upgrade", F.struct(F.col("original").alias("original_question"), F.col("upgraded").alias("upgraded_question"))),
        event("retrieval", F.struct(F.coalesce(documents, F.array().cast("array<struct<rank:int,url:string,heading:string,score:double,chunk_id:string>>")).alias("documents"))),
        event("prompt", F.struct(F.lit("\n".join(RULES)).alias("rules"))),
    )
    deltas = F.transform(F.split("answer", r"(?<=\s)(?=\S)"), lambda w: event("delta", F.struct(w.alias("delta"))))
    final = F.array(event("final", F.struct("answer", "citations", "insufficient", F.col("original").alias("original_question"), F.col("upgraded").alias("upgraded_question"))))
    return joined.select(query, F.posexplode(F.concat(before, deltas, final)).alias("seq", "e")).select(query, "seq", "e.type", "e.payload")
