"""Keyed mutations as plans: merge, classify, replace, cascade, cache split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the row with the largest ``order``; combined on the map side, so a key's rows
    never gather, and null keys are keys like others."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(_row(df, rest), F.struct(*[o.alias(f"o{n}") for n, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest]).select(*df.columns)


def merge(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Stored rows with those of ``incoming`` over them, the last by key.

    ``update`` names the columns a stored row takes from an incoming one; the others keep what
    is stored, and a new row has all its own.  All columns are updated unless given.  The
    incoming rows must be unique by key (see :func:`latest`).
    """
    columns = stored.columns
    change = set(update if update is not None else [c for c in columns if c not in keys])
    old, new = stored.withColumn("__old", F.lit(True)).alias("s"), incoming.withColumn("__new", F.lit(True)).alias("i")
    same = None
    for k in keys:
        part = F.col(f"s.{k}").eqNullSafe(F.col(f"i.{k}"))
        same = part if same is None else same & part
    both = old.join(new, same, "full_outer")
    return both.select(*[F.when(F.col("__old") & (F.lit(c not in change) | F.col("__new").isNull()), F.col(f"s.{c}")).otherwise(F.col(f"i.{c}")).alias(c) for c in columns])


def classify(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], digest: str = "content_hash", status: str = "status", active: str = "active") -> DataFrame:
    """``keys, outcome``: incoming rows as ``new``, ``unchanged`` (equal digest without case, stored
    row active) or ``changed``.  Both sides must be unique by key."""
    s = stored.select(*[F.col(k).alias(f"__{k}") for k in keys], F.lower(digest).alias("__d"), F.col(status).alias("__s"), F.lit(True).alias("__known"))
    same = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = part if same is None else same & part
    outcome = F.when(F.col("__known").isNull(), "new").when(F.col("__d").eqNullSafe(F.lower(digest)) & F.col("__s").eqNullSafe(F.lit(active)), "unchanged").otherwise("changed")
    return incoming.join(s, same, "left").select(*keys, outcome.alias("outcome"))


def upsert_documents(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], seen: str = "last_crawled", digest: str = "content_hash", status: str = "status") -> DataFrame:
    """The stored table after a crawl: unchanged rows get the new ``seen`` only, changed and new
    ones all incoming columns and become active; what wasn't crawled stays."""
    fresh = incoming.withColumn(status, F.lit("active")).select(*stored.columns)
    outcome = classify(stored, incoming, keys, digest, status)
    touched = outcome.where("outcome = 'unchanged'").select(*keys)
    same = fresh.join(touched, list(keys), "left_semi")
    other = fresh.join(touched, list(keys), "left_anti")
    return merge(merge(stored, other, keys), same, keys, [seen])


def replace_children(children: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children without those of the parents ``incoming`` has, and the incoming ones."""
    kept = children.join(incoming.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(incoming.select(*children.columns))


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, links: Sequence[tuple[str, str, str]], root: str, key: str) -> dict[str, DataFrame]:
    """The tables without the root rows in ``gone`` (column ``key``) and all that hangs on them.

    ``links``: (child table, its foreign key, parent table's key) in the order of the cascade.
    """
    out = dict(tables)
    dead = {root: tables[root].join(gone.select(key).distinct(), key, "left_semi")}
    out[root] = tables[root].join(gone.select(key).distinct(), key, "left_anti")
    parent = root
    for child, foreign, parent_key in links:
        ids = dead[parent].select(F.col(parent_key).alias(foreign)).distinct()
        dead[child] = tables[child].join(ids, foreign, "left_semi")
        out[child] = tables[child].join(ids, foreign, "left_anti")
        parent = child
    return out


def cache_split(wanted: DataFrame, cache: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows found in the cache with its columns, distinct keys that are missing)."""
    known = cache.dropDuplicates(list(keys))
    return wanted.join(known, list(keys)), wanted.select(*keys).distinct().join(known, list(keys), "left_anti")


def expired(df: DataFrame, until: str, now: Column) -> DataFrame:
    return df.where(F.col(until) <= now)
