"""Stored index, sessions, providers and running values on small tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpuscade import providers
from corpuscade.operators import metrics, ranking, sessions
from corpuscade.operators.index import ChunkIndex


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_a_stored_index_answers_as_a_fresh_one(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{n}", f"d{n % 3}", "ab"[n % 2], f"alpha {'beta ' * (n % 4)} x{n}", "h", n) for n in range(20)] + [("none", "d", "a", None, None, 0)], "chunk_id string, document_id string, domain string, text string, heading string, position int")
    written = ChunkIndex.write(chunks, f"file://{tmp_path}/index")
    read = ChunkIndex.load(spark, f"file://{tmp_path}/index")
    q = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None), (4, "unknown"), (5, "x7 x7")], "query_id long, query_text string")
    got = rows(read.lexical(q, 5), "query_id", "chunk_id")
    assert got == rows(written.lexical(q, 5), "query_id", "chunk_id") and {g[0] for g in got} == {1, 5} and (5, "c7") in got
    legs = read.scan(q, 5)
    assert {r["query_id"] for r in legs.collect()} <= {1, 4, 5} and rows(legs.where("leg = 'sparse' AND query_id = 5"), "chunk_id") == [("c7",)]
    assert {r["chunk_id"] for r in read.scan(q, 30, None, ["a"]).collect()} <= {f"c{n}" for n in range(0, 20, 2)}
    # few terms are a filter of the scan
    assert "In(term" in read.lexical(q)._jdf.queryExecution().toString() or "term IN" in read.lexical(q)._jdf.queryExecution().toString()
    assert read.scan(q.limit(0), 5).count() == 0
    empty = ChunkIndex.write(chunks.limit(0), f"file://{tmp_path}/empty")
    assert empty.scan(q, 5).count() == 0 and empty.scan(q, 5, (0.5, 0.5)).count() == 0 and empty.lexical(q).count() == 0


def test_running_values_over_a_hot_group(spark):
    rng = random.Random(3)
    data = [("hot" if n % 3 else rng.choice("ab"), n, rng.choice([None, *range(9)])) for n in range(200)]
    df = spark.createDataFrame(data, "g string, n int, v int").repartition(5)
    lag = {r["n"]: r["b"] for r in ranking.grouped_lag(df, ["g"], ["n"], "v", "b").collect()}
    top = {r["n"]: r["m"] for r in ranking.grouped_running_max(df, ["g"], ["n"], "v", "m").collect()}
    for g in ("a", "b", "hot"):
        before, most = None, None
        for _, n, v in (d for d in data if d[0] == g):
            most = v if most is None else most if v is None else max(most, v)
            assert lag[n] == before and top[n] == most
            before = v
    numbers = spark.createDataFrame([("x", float(v)) for v in [5, 1, 1, 9, 3, 3, 3]] + [("y", 2.0), ("z", None)], "k string, v double")
    assert rows(metrics.percentile_report(numbers, "k", "v", (0.0, 0.5, 0.9)), "k", "events", "p0", "p50", "p90") == [("x", 7, 1.0, 3.0, pytest.approx(6.6)), ("y", 1, 2.0, 2.0, 2.0)]


def test_work_tables_are_removed(spark):
    from corpuscade.session import local_path, scratch, shared_dir, written

    root = local_path(shared_dir(spark)) + "/corpuscade"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with scratch(spark):
        kept = written(spark.range(5), "kept").count()
        assert len(set(os.listdir(root)) - before) == 1
    assert kept == 5 and not set(os.listdir(root)) - before


def test_sessions_and_conversations(spark):
    sent = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("c", None), ("d", "t9")], "caller string, token string")
    stored = spark.createDataFrame([("u1", "t1", "2025-01-02 00:00:00"), ("u2", "t2", "2024-12-31 00:00:00")], "user_id string, token string, until string").select("user_id", F.sha2("token", 256).alias("token_hash"), F.col("until").cast("timestamp").alias("expires_at"))
    now = spark.createDataFrame([("2025-01-01 00:00:00",)], "n string").select(F.col("n").cast("timestamp").alias("now"))
    assert rows(sessions.authenticated(sent, stored, now), "caller", "user_id") == [("a", "u1")]
    turns = spark.createDataFrame([("c", n, f"q{n}", f"r{n}") for n in (2, 1)], "conversation string, turn int, question string, reply string")
    first = sessions.append_turns(None, turns)
    assert rows(first, "seq", "role", "content") == [(1, "user", "q1"), (2, "assistant", "r1"), (3, "user", "q2"), (4, "assistant", "r2")]
    more = sessions.append_turns(first, turns.where("turn = 1"))
    assert rows(more.where("seq > 4"), "seq", "content") == [(5, "q1"), (6, "r1")]


def test_replaceable_services(spark):
    q = spark.createDataFrame([(1, "how to apply"), (2, "ab"), (3, None)], "query_id int, query_text string")
    assert rows(providers.upgrade_questions(q), "query_id", "upgraded") == [(1, "how to apply")]
    scored = spark.createDataFrame([(1, "q", "good", 0.5), (1, "q", "bad", 0.9)], "query_id int, query_text string, text string, heuristic_score double")
    assert rows(providers.rerank(scored), "text", "rerank") == [("bad", 0.9), ("good", 0.5)]
    with pytest.raises(ValueError, match="no reranker"):
        providers.rerank(scored, "missing")
    assert providers.provider("generator", "extractive").complete(["x"]) == [""]
    assert providers.provider_or("reranker", "auto", "heuristic").score([]) is None


def _shared_word(spark, tmp_path, n):
    """An index of ``n`` chunks and as many questions that all share two words and tie."""
    chunks = spark.sql(f"SELECT concat('c', lpad(id, 4, '0')) AS chunk_id, concat('d', {n} - id) AS document_id, 'x' AS domain, concat('cost of w', id % 40) AS text, 'h' AS heading, 0 AS position FROM range({n})")
    return ChunkIndex.write(chunks, f"file://{tmp_path}/index"), spark.sql(f"SELECT id AS query_id, concat('cost of w', id % 40) AS query_text FROM range({n})")


def test_the_best_of_an_index_are_found_without_a_row_for_each_pair(spark, tmp_path):
    index, asked = _shared_word(spark, tmp_path, 1000)
    found = index.lexical(asked, 10)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found, "query_id", "chunk_id") == sorted(((q, f"c{q % 40 + 40 * n:04}") for q in range(1000) for n in range(10)), key=repr)
    some = asked.where("query_id % 100 = 3")
    joined = ranking.top_k_per_group(index.lexical(some).withColumn("score", F.round("score", 9)), ["query_id"], [F.desc("score"), F.asc("chunk_id")], 120)
    assert rows(index.lexical(some, 120), "query_id", "chunk_id", "score") == rows(joined, "query_id", "chunk_id", "score")


def test_lexical_queries_write_no_forward_table(spark, tmp_path):
    from corpuscade.plans import retrieval

    _shared_word(spark, tmp_path, 20)[0].chunks.withColumns({"university_id": F.lit("u"), "url": F.lit("y")}).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.sql("SELECT 1L AS query_id, 'cost of w3' AS query_text").write.parquet(f"{tmp_path}/search_results.parquet")
    assert retrieval.index_search(spark, str(tmp_path)).first()["chunk_id"] == "c0003"
    index = retrieval.stored_index(spark, str(tmp_path), forward=False)
    assert index.stats() == (20, 3.0) and not index.has("forward")
    assert retrieval.stored_index(spark, str(tmp_path)).has("forward") and index.has("forward")


def _asked(spark, tmp_path, n):
    index, asked = _shared_word(spark, tmp_path, n)
    index.chunks.withColumns({"university_id": F.lit("u"), "url": F.lit("y")}).write.parquet(f"{tmp_path}/chunks.parquet")
    asked.write.parquet(f"{tmp_path}/search_results.parquet")
    return str(tmp_path)


def test_multi_query_fusion_makes_no_row_for_each_pair(spark, tmp_path):
    from corpuscade.plans import retrieval

    found = retrieval.multi_query_fusion(spark, _asked(spark, tmp_path, 1000))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found, "query_id", "chunk_id") == sorted(((q, f"c{q % 40 + 40 * n:04}") for q in range(1000) for n in range(8)), key=repr)


def test_sparse_candidates_make_no_row_for_each_pair(spark, tmp_path):
    index, asked = _shared_word(spark, tmp_path, 300)
    found = index.every_lexical(asked, 120)
    assert "qtf" not in found._jdf.queryExecution().optimizedPlan().toString()  # questions' terms don't meet postings in a join
    documents = [(f"d{300 - n}", n) for n in range(300)]
    expected = [(q, f"c{n:04}", place) for q in range(300) for place, (_, _, n) in enumerate(sorted((n % 40 != q % 40, d, n) for d, n in documents)[:120], 1)]
    assert rows(found, "query_id", "chunk_id", "place") == sorted(expected, key=repr)
    none = index.every_lexical(spark.createDataFrame([(1, "unheard"), (2, "w3"), (3, "")], "query_id long, query_text string"), 120)
    assert {r["query_id"]: r["count"] for r in none.groupBy("query_id").count().collect()} == {1: 120, 2: 120}
