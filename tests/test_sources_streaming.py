"""Sources, sinks, providers and streaming jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpuscade import providers
from corpuscade.sources import files
from corpuscade.streaming import jobs


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


def test_page_metadata_and_links(spark, tmp_path):
    put(tmp_path, "p/a/metadata.json", {"url": "u", "normalized_url": "n", "status_code": 202, "depth": 3})
    put(tmp_path, "p/b/metadata.json", "{broken")
    put(tmp_path, "p/c/metadata.json", {"url": "u"})
    got = files.page_metadata(spark, f"{tmp_path}/p")
    assert sorted((r["url"] or "", r["corrupt"]) for r in got.collect()) == [("", True), ("u", False), ("u", True)]
    put(tmp_path, "l/1.json", {"source_normalized_url": "s", "outgoing_links": ["b", "a"], "redirect_to": "r"})
    put(tmp_path, "l/2.json", {"source_normalized_url": "t", "edges": [{"target": "x", "type": "link"}]})
    put(tmp_path, "l/3.json", "nonsense")
    from corpuscade.operators import graph

    edges = graph.edges_of(files.page_links(spark, f"{tmp_path}/l"))
    assert sorted((r["source"], r["target"], r["type"]) for r in edges.collect()) == [("s", "a", "link"), ("s", "b", "link"), ("s", "r", "redirect"), ("t", "x", "link")]
    files.write_links(edges, f"{tmp_path}/out")
    again = graph.edges_of(spark.read.schema(files.LINKS).json(f"{tmp_path}/out").select(F.col("source_normalized_url").alias("source"), "edges", "redirect_to", "outgoing_links"))
    assert again.count() == 4


def test_html_curated_queue_checkpoint_manifest(spark, tmp_path):
    put(tmp_path, "h/a.html", "<p>x</p>")
    put(tmp_path, "h/b.html", " \n ")
    put(tmp_path, "h/c.html", "")
    assert files.page_html(spark, f"{tmp_path}/h").count() == 1
    put(tmp_path, "i.json", [{"path": "a", "url": "u"}, {"filename": "b", "url": "v", "final_url": "w"}, {"url": "z"}])
    assert sorted(r["file"] for r in files.curated_index(spark, f"{tmp_path}/i.json").collect()) == ["a", "b"]
    put(tmp_path, "q/1.json", {"unique_key": "k", "url": "u", "user_data": {"__crawlee": {"crawlDepth": 2}}, "handled_at": None})
    row = files.crawl_queue(spark, f"{tmp_path}/q").first()
    assert row["user_data"]["__crawlee"]["crawlDepth"] == 2
    put(tmp_path, "k/1.json", {"root_url": "r", "queue": [["u", 1], ["v", "x"]], "visited": ["r"], "pages_saved": 1, "pages_skipped": 0, "errors": 0})
    queue = files.frontier_checkpoint(spark, f"{tmp_path}/k").first()["queue"]
    assert [(q["url"], q["depth"]) for q in queue] == [("u", 1), ("v", None)]
    put(tmp_path, "m.json", {"university_name": "x", "pages_skipped": 4})
    assert tuple(files.manifest_counts(spark, f"{tmp_path}/m.json", 9).first()) == (9, 4, 0)


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("t", "u1", "x"), ("t", "u2", "x"), ("s", "u3", None)], "university_id string, url string, html string")
    files.write_pages(pages, f"{tmp_path}/pages")
    files.write_pages(pages, f"{tmp_path}/pages")  # again: nothing is added
    assert sorted(r["url"] for r in spark.read.parquet(f"{tmp_path}/pages/pages").collect()) == ["u1", "u2", "u3"]
    assert [(r["university_id"], r["html"]) for r in files.raw_html(spark, f"{tmp_path}/pages/html").collect()] == [("t", "x")]
    files.write_url_list(pages, f"{tmp_path}/urls")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/urls").collect()] == ["u1", "u2", "u3"]
    files.write_events(spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "query_id int, seq int, type string"), f"{tmp_path}/events")
    assert [r["type"] for r in spark.read.json(f"{tmp_path}/events").collect()] == ["a", "b"]


class Picky:
    """An embedder that takes two texts at most and fails once."""

    model_id = "picky"
    calls = 0
    failed = False

    def embed(self, texts):
        if not Picky.failed:
            Picky.failed = True
            raise OSError("once")
        if len(texts) > 2:
            raise providers.TooLarge
        Picky.calls += 1
        return [[float(len(t))] for t in texts]


def test_embed_batch_retries_and_halves():
    got = providers.embed_batch(Picky(), ["a", "bb", "ccc", "dddd", "e"], pause=0)
    assert got == [[1.0], [2.0], [3.0], [4.0], [1.0]] and Picky.calls == 3
    with pytest.raises(ValueError, match="no embedder named x"):
        providers.provider("embedder", "x")


def test_embed_missing_fills_the_cache_once(spark):
    chunks = spark.createDataFrame([("c1", ["Programs", "MSc"], "t"), ("c2", [], "t"), ("c3", [], "t"), ("c4", [], None)], "chunk_id string, heading_trail array<string>, text string")
    empty = spark.createDataFrame([], "content_hash string, model_id string, embedding array<double>")
    done, cache = providers.embed_missing(chunks, empty, lambda: providers.provider("embedder", "digest", dim=8), "digest-8")
    got = {r["chunk_id"]: r["embedding"] for r in done.collect()}
    assert got["c2"] == got["c3"] != got["c1"] and got["c4"] is None and cache.count() == 2
    _, again = providers.embed_missing(chunks, cache, lambda: 1 / 0, "digest-8")
    assert again.count() == 2


def test_entities(spark):
    chunks = spark.createDataFrame([("c1", "d", "Dr. M. Flemik met Prof. Flemik and dr nobody"), ("c2", "d", "Dr Flemik"), ("c3", "e", None)], "chunk_id string, document_id string, text string")
    got = providers.extract_entities(chunks).collect()
    assert [(r["chunk_id"], r["document_id"], r["entity_type"], r["name"]) for r in got] == [("c1", "d", "person", "Flemik")]
    assert providers.extract_entities(chunks, lambda texts: {}["bad"]).count() == 0


def test_stream_ingestion_is_incremental_and_repeatable(spark, tmp_path):
    day = dt.datetime(2025, 1, 1)
    schema = "university_id string, url string, html string, status_code int, fetched_at timestamp"
    source, target, check = f"{tmp_path}/in", f"file://{tmp_path}/docs", f"{tmp_path}/check"
    spark.createDataFrame([("t", "a", "1", 200, day), ("t", "a", "2", 200, day + dt.timedelta(1)), ("t", "b", "1", 500, day)], schema).write.parquet(source)
    run = lambda: jobs.ingest(spark.readStream.schema(schema).parquet(source), target, check).awaitTermination()
    run()
    assert [(r["url"], r["last_crawled"]) for r in jobs.documents(spark, target).collect()] == [("a", day + dt.timedelta(1))]
    spark.createDataFrame([("t", "a", "0", 200, day), ("t", "c", "1", 200, day)], schema).write.mode("append").parquet(source)
    run()
    run()
    got = {r["url"]: r["last_crawled"] for r in jobs.documents(spark, target).collect()}
    assert got == {"a": day + dt.timedelta(1), "c": day}


def test_stream_sessions_and_throughput(spark, tmp_path):
    start = dt.datetime(2025, 1, 1)
    at = lambda minutes: start + dt.timedelta(minutes=minutes)
    schema = "user_id long, ts timestamp"
    source = f"{tmp_path}/events"
    spark.createDataFrame([(1, at(0)), (1, at(5)), (1, at(30)), (2, at(1))], schema).coalesce(1).write.parquet(source)
    spark.createDataFrame([(3, at(10_000))], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def collect(df, name):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()

    ended = collect(jobs.sessions(stream, 600, "0 seconds"), "ended")
    assert {(r["user_id"], r["events"], r["first_seen"]) for r in ended} >= {(1, 2, at(0))}
    counted = collect(jobs.throughput(stream, "10 minutes", "0 seconds"), "counted")
    assert {(r["window_start"], r["events"]) for r in counted} >= {(at(0), 3), (at(30), 1)}
