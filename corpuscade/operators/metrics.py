"""Retrieval quality, monitoring and content upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import grouped_lag, grouped_running_max, grouped_running_sum, top_k_per_group


def retrieval_metrics(run: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, recall, mrr, ndcg`` at ``k`` of every query with a relevant item.

    ``run``: query_id, item, score (ties by item); ``relevant``: query_id, item, each pair once.
    """
    first = top_k_per_group(run, ["query_id"], [F.desc("score"), F.asc("item")], k)
    ranked = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "item"))).alias("l")).select("query_id", F.posexplode("l").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.item")  # k at most
    totals = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = ranked.join(relevant, ["query_id", "item"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, n: s + 1 / F.log2(n + 1))
    joined = totals.join(hits, "query_id", "left").na.fill(0, ["hits"]).na.fill(0.0, ["dcg"])
    return joined.select("query_id", (F.col("hits") / F.col("relevant")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / ideal).alias("ndcg"))


def percentile_report(events: DataFrame, group: str, value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``group, events`` and exact interpolated percentiles.

    Values are counted by distinct value, and a running count over range partitions gives the
    places each of them fills; the values at the two places of a percentile are picked by an
    aggregation.  No group's values, however many, meet in one task.
    """
    counted = events.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    placed = grouped_running_sum(counted, [group], [value], "c", "upto")
    totals = counted.groupBy(F.col(group).alias("__g")).agg(F.sum("c").alias("events"))
    known = placed.join(totals, F.col(group).eqNullSafe(F.col("__g")))
    fills = lambda at: F.max(F.when((F.col("upto") - F.col("c") <= at) & (at < F.col("upto")), F.col(value).cast("double")))
    place = lambda p: F.lit(p) * (F.col("events") - 1)
    ends = [fills(cut(place(p))).alias(f"{name}{k}") for k, p in enumerate(points) for name, cut in (("lo", F.floor), ("hi", F.ceil))]
    picked = known.groupBy(group, "events").agg(*ends)
    return picked.select(group, "events", *[(F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (place(p) - F.floor(place(p)))).alias(f"p{round(p * 100)}") for k, p in enumerate(points)])


def citation_accuracy(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id, cited, supported``: cited sentences and those that stand in the text they cite.

    ``answers``: query_id, source, sentence; ``evidence``: query_id, source, snippet.  White space
    and case don't count; a citation of an unknown source isn't supported.
    """
    from ..functions.text import squeezed_col

    told = answers.join(evidence.select("query_id", "source", "snippet"), ["query_id", "source"], "left")
    stands = F.coalesce(F.contains(F.lower("snippet"), F.lower(squeezed_col(F.col("sentence")))), F.lit(False))
    return told.groupBy("query_id").agg(F.count("*").alias("cited"), F.count_if(stands).alias("supported"))


def unsupported_values(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id, value``: numbers of an answer that stand in none of its evidence."""
    number = F.lit(r"(\d+(?:[.,]\d+)*)")
    said = answers.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("answer", r"(?i)\[source\s+\d+\]", ""), number, F.lit(1)))).alias("value"))
    known = evidence.select("query_id", F.explode(F.regexp_extract_all("snippet", number, F.lit(1))).alias("value")).distinct()
    return said.join(known, ["query_id", "value"], "left_anti")


def never_retrieved(chunks: DataFrame, results: DataFrame, key: str = "chunk_id") -> DataFrame:
    return chunks.select(key).distinct().join(results.select(key).distinct(), key, "left_anti")


def stale(documents: DataFrame, now: Column, days: int, seen: str = "last_crawled") -> DataFrame:
    return documents.where(F.datediff(now, F.col(seen)) > days)


def tenant_mismatches(children: DataFrame, parents: DataFrame, key: str, tenant: str) -> DataFrame:
    """Children whose tenant isn't their parent's; an empty result is the proof of isolation."""
    p = parents.select(F.col(key), F.col(tenant).alias("__tenant")).distinct()
    known = children.join(p.groupBy(key).agg(F.collect_set("__tenant").alias("__tenants")), key)
    return known.where(~F.array_contains("__tenants", F.col(tenant))).drop("__tenants")


def slow_events(events: DataFrame, duration: str, threshold: float) -> DataFrame:
    return events.where(F.col(duration) > threshold)


def throughput(events: DataFrame, width: str, ts: str = "ts", group: str | None = None) -> DataFrame:
    """``window_start, events`` by tumbling windows."""
    keys = [F.window(ts, width).alias("w"), *([F.col(group)] if group else [])]
    out = events.groupBy(*keys).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("window_start"), *([group] if group else []), "events")


def hill_climb(samples: DataFrame, group: str, order: str, value: str, start: int = 32, floor: int = 1, step: int = 1) -> DataFrame:
    """``group, seq, size``: a pool's size after each sample of its throughput.

    The size goes on in its direction as long as throughput doesn't fall, and turns when it does;
    it never falls below ``floor``.  The direction is the parity of the falls so far; the size is
    the sum of the moves, lifted by the most that it has gone below the floor up to there.  So
    running sums and a running maximum give the fold, and a group may span many tasks.
    """
    falls = grouped_lag(samples.select(group, order, F.col(value).cast("double").alias("__v")), [group], [order], "__v", "__before_v").withColumn("__fall", F.when(F.col("__v") < F.col("__before_v"), 1).otherwise(0)).withColumn("__one", F.lit(1))
    turned = grouped_running_sum(falls, [group], [order], "__fall", "__falls").withColumn("__move", F.when(F.col("__falls") % 2 == 0, step).otherwise(-step))
    moved = grouped_running_sum(turned, [group], [order], "__move", "__sum").withColumn("__free", F.lit(start) + F.col("__sum")).withColumn("__under", F.lit(floor) - F.col("__free"))
    lifted = grouped_running_max(moved, [group], [order], "__under", "__lift")
    ranked = grouped_running_sum(lifted, [group], [order], "__one", "seq")
    return ranked.select(group, F.col("seq").cast("int").alias("seq"), (F.col("__free") + F.greatest(F.lit(0), F.col("__lift"))).cast("int").alias("size"))
