"""Replaceable services with offline defaults: embedders, rerankers, generators, entity extractors."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import embedding_input_col, first_line_col
from .functions.vectors import digest_vector
from .operators.answers import NO_ANSWER
from .operators.tables import cache_split


class TooLarge(Exception):
    """A provider's answer to a batch it can't take as a whole."""


class Embedder(Protocol):
    model_id: str

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class DigestEmbedder:
    """Vectors from digests: deterministic, of length 1, without meaning."""

    def __init__(self, dim: int = 128) -> None:
        self.dim, self.model_id = dim, f"digest-{dim}"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [digest_vector(t, self.dim).tolist() for t in texts]


class IdentityUpgrader:
    """The offline upgrader: a question as it is."""

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return list(prompts)


class HeuristicReranker:
    """The offline reranker: no model, so the heuristic's score stands alone."""

    def score(self, pairs: Sequence[tuple[str, str]]) -> list[float] | None:
        return None


class EvidenceGenerator:
    """The offline generator: says nothing, so the extractive answer is given."""

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return ["" for _ in prompts]


_REGISTRY: dict[tuple[str, str], Callable] = {("embedder", "digest"): DigestEmbedder, ("upgrader", "identity"): IdentityUpgrader, ("reranker", "heuristic"): HeuristicReranker, ("reranker", "none"): HeuristicReranker, ("generator", "extractive"): EvidenceGenerator}


def register(kind: str, name: str, make: Callable) -> None:
    _REGISTRY[kind, name] = make


def provider(kind: str, name: str, **options):  # noqa: ANN003, ANN201
    """A provider by kind and name; a name that isn't registered is an error."""
    if (kind, name) not in _REGISTRY:
        raise ValueError(f"no {kind} named {name}")
    return _REGISTRY[kind, name](**options)


def provider_or(kind: str, name: str, fallback: str, **options):  # noqa: ANN003, ANN201
    """A provider by name; ``auto`` is the first one registered beside the fallback that can be made, else the fallback."""
    if name != "auto":
        return provider(kind, name, **options)
    for known, other in _REGISTRY:
        if known == kind and other not in (fallback, "none"):
            try:
                return provider(kind, other, **options)
            except (ImportError, OSError):
                continue
    return provider(kind, fallback)


def completed(rows: DataFrame, kind: str, name: str, prompt: str, out: str, batch: int = 32) -> DataFrame:
    """``rows`` with ``out``: what the provider makes of ``prompt``; it is made once a task."""
    schema = rows.schema.simpleString()[len("struct<") : -1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) if schema else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider(kind, name)
        for part in batches:
            told: list[str] = []
            for at in range(0, len(part), batch):
                told += model.complete([p or "" for p in part[prompt].iloc[at : at + batch]])
            yield part.assign(**{out: told})

    return rows.mapInPandas(run, f"{fields}, `{out}` string")


def generate(prompts: DataFrame, name: str = "extractive", prompt: str = "prompt", instead: str = "extractive", out: str = "answer") -> DataFrame:
    """``prompts`` with ``out``: a generator's answers.  A blank answer is asked for once more;
    where it stays blank, and with the offline generator, the column ``instead`` stands in, and
    without that the statement that the evidence isn't enough."""
    told = completed(prompts, "generator", name, prompt, "__first")
    blank = F.trim(F.coalesce(F.col("__first"), F.lit(""))) == ""
    again = completed(told.withColumn("__ask", F.when(blank, F.col(prompt))), "generator", name, "__ask", "__second")
    given = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)
    return again.withColumn(out, F.coalesce(given(F.col("__first")), F.when(blank, given(F.col("__second"))), given(F.col(instead)), F.lit(NO_ANSWER))).drop("__first", "__second", "__ask")


def upgrade_questions(questions: DataFrame, name: str = "identity") -> DataFrame:
    """``query_id, original, upgraded``: questions of at least three characters as an upgrader
    rewrites them, on one line without outer quotes.  A rewriting of under three characters is an error."""
    asked = questions.where(F.length(F.trim("query_text")) >= 3).select("query_id", F.col("query_text").alias("original"))
    told = completed(asked, "upgrader", name, "original", "raw")
    line = first_line_col(F.col("raw"))
    return told.select("query_id", "original", F.when(F.length(line) >= 3, line).otherwise(F.raise_error(F.lit("the upgrader returned no question"))).alias("upgraded"))


def rerank(scored: DataFrame, name: str = "auto", group: str = "query_id") -> DataFrame:
    """``scored`` (query_text, text, heuristic_score) with ``rerank``: the heuristic's score, blended
    with a reranker's where one is registered."""
    from .operators.fusion import blended_rerank

    model = provider_or("reranker", name, "heuristic")
    if model.score([]) is None:
        return scored.withColumn("rerank", F.col("heuristic_score"))

    @F.pandas_udf("double")
    def judged(questions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(provider_or("reranker", name, "heuristic").score(list(zip(questions, texts))))

    return blended_rerank(scored.withColumn("model_score", judged("query_text", "text")), group).drop("model_score")


def embed_batch(embedder: Embedder, texts: Sequence[str], retries: int = 3, pause: float = 1.0) -> list[list[float]]:
    """A batch with retries at doubling pauses; a batch that is too large is halved."""
    for attempt in range(retries + 1):
        try:
            return embedder.embed(texts)
        except TooLarge:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return embed_batch(embedder, texts[:half], retries, pause) + embed_batch(embedder, texts[half:], retries, pause)
        except OSError:
            if attempt == retries:
                raise
            time.sleep(pause * 2**attempt)
    raise AssertionError


def embed_missing(chunks: DataFrame, cache: DataFrame, make: Callable[[], Embedder], model_id: str, batch: int = 128, trail: str = "heading_trail", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(chunks with ``content_hash`` and ``embedding``, the cache with what was missing).

    The input is the heading trail and the text; equal inputs are embedded once; the cache is
    keyed by digest and model, so models don't overwrite each other.  ``make`` is called once a
    task.  Null texts get no embedding.
    """
    keyed = chunks.withColumn("__input", embedding_input_col(F.col(trail), F.col(text))).withColumn("content_hash", F.sha2("__input", 256)).withColumn("model_id", F.lit(model_id))
    wanted = keyed.where("__input IS NOT NULL").select("content_hash", "model_id", "__input").dropDuplicates(["content_hash"])
    _, missing = cache_split(wanted.select("content_hash", "model_id"), cache, ["content_hash", "model_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = make()
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                yield pd.DataFrame({"content_hash": part["content_hash"], "model_id": part["model_id"], "embedding": embed_batch(embedder, part["__input"].tolist())})

    fresh = wanted.join(missing, ["content_hash", "model_id"], "left_semi").mapInPandas(run, "content_hash string, model_id string, embedding array<double>")
    whole = cache.select("content_hash", "model_id", "embedding").unionByName(fresh)
    return keyed.drop("__input").join(whole, ["content_hash", "model_id"], "left"), whole


_NAME = re.compile(r"\b(?:Dr|Prof|Mr|Ms)\.?\s+(?:[A-Z]\.\s+)*([A-Z][\w-]+)")


def pattern_entities(texts: Sequence[str]) -> list[list[dict]]:
    """The offline extractor: people after a title."""
    return [[{"entity_type": "person", "name": n} for n in dict.fromkeys(_NAME.findall(t or ""))] for t in texts]


def extract_entities(chunks: DataFrame, extract: Callable[[Sequence[str]], list[list[dict]]] = pattern_entities, version: str = "pattern-1", batch: int = 20) -> DataFrame:
    """``chunk_id, document_id, entity_type, name, version``: what ``extract`` finds in batches of chunks.

    A batch that fails gives nothing; entries with a blank type or name are left out; an entity
    counts once a document, type, name without case and version, at its first chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                try:
                    found = extract(part["text"].tolist())
                except (OSError, ValueError, KeyError):
                    found = []
                out = [(c, d, e.get("entity_type"), e.get("name")) for c, d, es in zip(part["chunk_id"], part["document_id"], found) for e in es]
                yield pd.DataFrame(out, columns=["chunk_id", "document_id", "entity_type", "name"])

    found = chunks.select("chunk_id", "document_id", "text").mapInPandas(run, "chunk_id string, document_id string, entity_type string, name string")
    good = found.where("trim(coalesce(entity_type, '')) <> '' AND trim(coalesce(name, '')) <> ''")
    return good.groupBy("document_id", "entity_type", F.lower("name").alias("key")).agg(F.min(F.struct("chunk_id", "name")).alias("b")).select("b.chunk_id", "document_id", "entity_type", "b.name", F.lit(version).alias("version"))
