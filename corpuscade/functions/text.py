"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a question or heading one about a process, and what a question is then extended by.
PROCESS_QUESTION = r"(?i)\b(step|steps|stage|stages|process|how\s+to\s+apply|application\s+guide|application\s+process|guide)\b"
PROCESS_HEADING = r"(?i)\b(step|stage|application|process|how to apply|guide)\b"
PROCESS_SUFFIX = " steps stage process application guide how to apply"
CITATION = r"(?i)\[source\s+(\d+)\]"


def tokens_col(text: Column) -> Column:
    """ASCII letter and digit runs in lower case, repeats kept; no token for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([a-zA-Z0-9]+)"), F.lit(1)), F.lower)


def squeezed_col(text: Column) -> Column:
    """White space runs, Unicode's included, as one space, none outside."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words_col(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def token_estimate_col(text: Column) -> Column:
    """Estimated tokens: words times 1.3, cut to an integer."""
    return (F.size(words_col(text)) * F.lit(1.3)).cast("int")


def first_line_col(text: Column) -> Column:
    """First line that isn't blank, without outer quotes and backticks, white space squeezed."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)\S"))
    return squeezed_col(F.regexp_replace(F.trim(F.get(lines, F.lit(0))), "^[\"'`]+|[\"'`]+$", ""))


def snippet_col(text: Column, limit: int = 1800) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def token_hash_col(token: Column) -> Column:
    """What is stored of a secret token."""
    return F.sha2(token, 256)


def url_label_col(url: Column, limit: int = 56) -> Column:
    """Address without scheme and closing slash, cut to ``limit`` characters."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?i)^https?://", ""), "/$", "")
    return F.when(F.length(bare) > limit, F.concat(F.substring(bare, 1, limit - 3), F.lit("..."))).otherwise(bare)


def process_question_col(question: Column) -> Column:
    return F.coalesce(question.rlike(PROCESS_QUESTION), F.lit(False))


def process_heading_col(heading: Column) -> Column:
    return F.coalesce(heading.rlike(PROCESS_HEADING), F.lit(False))


def expanded_question_col(question: Column) -> Column:
    return F.when(process_question_col(question), F.concat(question, F.lit(PROCESS_SUFFIX))).otherwise(question)


def citations_col(answer: Column) -> Column:
    """Distinct cited source numbers, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1)), lambda n: n.cast("int"))))


def linked_citations_col(answer: Column, urls: Column) -> Column:
    """``[source N]`` not followed by ``(`` with the url of ``urls`` (a map by number) behind it."""
    return F.reduce(F.map_entries(urls), answer, lambda acc, e: F.regexp_replace(acc, F.concat(F.lit(r"(?i)(\[source\s+"), e["key"].cast("string"), F.lit(r"\])(?!\()")), F.concat(F.lit("$1("), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")), F.lit(")"))))


def embedding_input_col(trail: Column, text: Column) -> Column:
    """Text with its heading trail in front."""
    return F.when(F.size(trail) > 0, F.concat(F.array_join(trail, " > "), F.lit("\n\n"), text)).otherwise(text)


def heuristic_rerank_col(question: Column, text: Column, heading: Column) -> Column:
    """min(1, 4 * text tokens in the question / text tokens + 0.4 * question terms in the heading
    / question terms + 0.2 if the text contains the question); 0 where either has no token."""
    asked, body = F.array_distinct(tokens_col(question)), tokens_col(text)
    overlap = F.size(F.filter(body, lambda t: F.array_contains(asked, t)))
    in_heading = F.size(F.array_intersect(asked, tokens_col(heading)))
    contains = F.when(F.contains(F.lower(text), F.lower(F.trim(question))), 0.2).otherwise(0.0)
    score = overlap * 4.0 / F.size(body) + in_heading * 0.4 / F.size(asked) + contains
    return F.when((F.size(asked) == 0) | (F.size(body) == 0), 0.0).otherwise(F.least(F.lit(1.0), score))
