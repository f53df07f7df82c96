"""Core operators against brute force on small and dirty tables."""

import datetime as dt
import gzip
import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from corpuscade.operators import answers, capture, compaction, crawl, fusion, graph, lexical, metrics, ranking, tables, vector_search
from corpuscade.plans import retrieval


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_grouped_rank_equals_a_window(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), n, rng.choice([1, 2, None])) for n in range(300)]
    df = spark.createDataFrame(data, "g string, x int, id int, v int").repartition(5)
    ranked = {r["id"]: r["r"] for r in ranking.grouped_rank(df, ["g"], ["x", "id"], "r").collect()}
    summed = {r["id"]: r["s"] for r in ranking.grouped_running_sum(df, ["g"], ["x", "id"], "v", "s").collect()}
    for group in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == group), key=lambda d: d[1:3])
        total = 0
        for n, d in enumerate(own, 1):
            total += d[3] or 0
            assert ranked[d[2]] == n and summed[d[2]] == total
    assert ranking.grouped_rank(df.limit(0), ["g"], ["x", "id"], "r").count() == 0


def test_top_k_per_group(spark):
    df = spark.createDataFrame([(g, n) for g in "ab" for n in range(20)], "g string, n int").repartition(7)
    got = ranking.top_k_per_group(df, ["g"], [F.desc("n")], 3)
    assert rows(got, "g", "n") == sorted([(g, n) for g in "ab" for n in (17, 18, 19)], key=repr)


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, "")], "id long, t string")
    queries = spark.createDataFrame([(0, "B b a"), (1, "nothing")], "q long, s string")
    got = {(r["q"], r["id"]): r["score"] for r in lexical.scores(docs, queries, "id", "t", "q", "s").collect()}
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    norm = lambda dl: 1.5 * (0.25 + 0.75 * dl / 1.25)
    assert got[0, 1] == pytest.approx(2 * idf(2) * 2 * 2.5 / (2 + norm(3)) + idf(1) * 2.5 / (1 + norm(3)))
    assert got[0, 2] == pytest.approx(2 * idf(2) * 2.5 / (1 + norm(2))) and set(got) == {(0, 1), (0, 2)}


def test_exact_top_k_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    vecs = [(n, [float(x) for x in rng.standard_normal(4)], n % 3) for n in range(60)]
    dirty = [(100, None, 0), (101, [1.0], 0), (102, [0.0] * 4, 0), (103, [float("nan")] * 4, 0), (5, vecs[5][1], 2)]
    df = spark.createDataFrame(vecs + dirty, "id long, v array<double>, t int").repartition(3)
    got = rows(vector_search.exact_top_k(df.where("id % 10 = 0"), df, 4, "id", "v", 4, block=4), "query_id", "id")
    m = np.array([v[1] for v in vecs])
    m /= np.linalg.norm(m, axis=1)[:, None]
    want = sorted(((q, int(i)) for q in range(0, 60, 10) for i in [j for j in np.argsort(-(m @ m[q])) if j != q][:4]), key=repr)
    assert got == want
    tenant = vector_search.exact_top_k(df.where("id = 10"), df, 100, "id", "v", 4, tenant_col="t")
    assert {r["id"] % 3 for r in tenant.collect()} == {1}
    assert vector_search.exact_top_k(df.limit(0), df, 4, "id", "v", 4).count() == 0


def test_neighbour_context(spark):
    df = spark.createDataFrame([("d", "c0", 0, " a "), ("d", "c1", 1, None), ("d", "c2", 2, "b"), ("d", "c4", 4, "e"), ("x", "c9", 1, "z")], "document_id string, chunk_id string, position int, text string")
    got = {r["chunk_id"]: r["context"] for r in fusion.neighbour_context(df).collect()}
    assert got == {"c0": "a", "c1": "a\nb", "c2": "b", "c4": "e", "c9": "z"}


def test_hybrid_and_fused_retrieval_take_blank_questions_and_domains(spark):
    chunks = spark.createDataFrame([(f"c{n}", f"d{n // 2}", "a" if n % 2 else "b", f"how to apply step {n} alpha", "Step", n % 2) for n in range(12)] + [("cx", "dx", "a", None, None, 0)], "chunk_id string, document_id string, domain string, text string, heading string, position int")
    q = spark.createDataFrame([(0, "how to apply alpha"), (1, " ")], "query_id long, query_text string")
    got = retrieval.hybrid_search(chunks, q, domains=["a"]).collect()
    assert {r["query_id"] for r in got} == {0} and len(got) == 6
    assert {r["query_id"] for r in retrieval.fused_retrieval(chunks, q).collect()} == {0}


def test_evidence_stops_at_the_budget(spark):
    data = [(1, f"c{n}", f"u{n // 2}", None, "x" * size, float(10 - n)) for n, size in enumerate((1000, 900, 1500, 1, 2, 3))]
    df = spark.createDataFrame(data + [(2, "z", "u", "h", "y" * 5000, 1.0), (3, "n", "u", "h", " ", 1.0), (3, "m", "u", "h", "t", None)], "query_id int, chunk_id string, url string, heading string, text string, score double")
    got = rows(answers.evidence(df), "query_id", "source", "chunk_id")
    assert got == [(1, 1, "c0"), (1, 2, "c2"), (1, 3, "c4"), (2, 1, "z")]


def test_answers(spark):
    data = [(1, "How to apply", "c1", "u1", "Steps", "1. Fill in the long form today please.\nshort\n- Send the form to the office now.", 0.9), (1, "How to apply", "c2", "u2", None, "We apply. Nothing here.", 0.8), (1, "How to apply", "c3", "u2", None, "We apply.", 0.1)]
    df = spark.createDataFrame(data, "query_id int, query_text string, chunk_id string, url string, heading string, text string, score double")
    best = answers.extractive_answers(df).collect()
    assert [(r["source"], r["sentence"]) for r in sorted(best, key=lambda r: r["source"])][1] == (2, "We apply.")
    steps = sorted(answers.process_steps(df).collect(), key=lambda r: r["step"])
    assert [(s["source"], s["text"]) for s in steps] == [(1, "Fill in the long form today please."), (1, "Send the form to the office now.")]
    found = answers.evidence(df)
    said = spark.createDataFrame([(1, "So [source 2] and [source 9]."), (2, "x [source 1]")], "query_id int, answer string")
    payload = {r["query_id"]: r for r in answers.answer_payload(said, found).collect()}
    assert payload[1]["citations"] == [2] and "[source 2](u2)" in payload[1]["answer"] and not payload[1]["insufficient"]
    assert payload[2]["insufficient"] and payload[2]["citations"] == []
    asked = spark.createDataFrame([(1, "How to apply", "How to apply")], "query_id int, original string, upgraded string")
    events = answers.answer_events(asked, df, answers.answer_payload(said, found)).orderBy("seq").collect()
    assert [e["type"] for e in events][:3] == ["query_upgrade", "retrieval", "prompt"] and events[-1]["type"] == "final"
    assert "".join(json.loads(e["payload"])["delta"] for e in events[3:-1]).startswith("So [source 2]")
    assert [x["rank"] for x in json.loads(events[1]["payload"])["documents"]] == [1, 2, 3]
    nothing = answers.answer_events(asked, df, answers.answer_payload(said.withColumn("answer", F.lit(" ")), found)).where("type = 'delta'")
    assert "".join(json.loads(e["payload"])["delta"] for e in nothing.orderBy("seq").collect()) == answers.NO_ANSWER
    assert "(none)" in answers.prompts(spark.createDataFrame([(7, "q")], "query_id int, query_text string"), found).first()["prompt"]


def brute_depths(edges, root, cost):
    best = {root: 0}
    for _ in range(50):
        for s, t, k in edges:
            if s in best and best[s] + cost(k) < best.get(t, 10**9):
                best[t] = best[s] + cost(k)
    return best


def test_graph(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.choice(["link", "redirect"])) for _ in range(45)]
    df, root = spark.createDataFrame(edges, "source string, target string, type string"), spark.createDataFrame([("n0",)], "node string")
    assert dict(rows(graph.depths(df, root), "node", "depth")) == brute_depths(edges, "n0", lambda k: 1)
    assert dict(rows(graph.crawl_depths(df, root), "node", "depth")) == brute_depths(edges, "n0", lambda k: k == "link")
    assert max(r["depth"] for r in graph.all_depths(df, root).collect()) == max(brute_depths(edges, "n0", lambda k: 1).values()) + (len({x for e in edges for x in e[:2]}) > len(brute_depths(edges, "n0", lambda k: 1)))
    scope = df.select(F.col("source").alias("node")).where("node < 'n2'").distinct()
    scoped = {r["node"]: (r["depth"], r["outside_hops"]) for r in graph.scoped_depths(df, root, scope, 1, 5).collect()}
    inside = {r["node"] for r in scope.collect()}
    states, level = {("n0", 0 if "n0" in inside else 1)}, {("n0", 0 if "n0" in inside else 1)}
    want = {"n0": (0, min(h for _, h in states))}
    for depth in range(1, 6):
        level = {(t, 0 if t in inside else h + 1) for n, h in level for s, t, _ in edges if s == n}
        level = {x for x in level if x[1] <= 1} - states
        states |= level
        for n, h in sorted(level):
            want.setdefault(n, (depth, h))
    assert scoped == want
    old = spark.createDataFrame([("a", None, "r", ["x", ""]), ("b", [("y", "link"), ("z", "other")], "r", ["q"])], "source string, edges array<struct<target:string,type:string>>, redirect_to string, outgoing_links array<string>")
    assert rows(graph.edges_of(old), "source", "target", "type") == [("a", "r", "redirect"), ("a", "x", "link"), ("b", "y", "link")]


def test_merge_replace_and_cascade(spark):
    s = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], "k int, v string, w int")
    i = spark.createDataFrame([(2, "B", 9), (3, "C", 9), (None, None, 9)], "k int, v string, w int")
    assert rows(tables.merge(s, i, ["k"], ["v"]), "k", "v", "w") == sorted([(1, "a", 1), (2, "B", 1), (3, "C", 9), (None, None, 1)], key=repr)
    assert rows(tables.merge(s, i, ["k"]), "k", "v", "w") == sorted([(1, "a", 1), (2, "B", 9), (3, "C", 9), (None, None, 9)], key=repr)
    again = tables.merge(tables.merge(s, i, ["k"]), i, ["k"])
    assert rows(again, "k", "v", "w") == rows(tables.merge(s, i, ["k"]), "k", "v", "w")
    assert tables.merge(s.limit(0), i, ["k"]).count() == 3 and tables.merge(s, i.limit(0), ["k"]).count() == 3
    assert rows(tables.latest(s.unionByName(i), ["k"], [F.col("w")]), "k", "w") == sorted([(1, 1), (2, 9), (3, 9), (None, 9)], key=repr)
    children = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c3", "p2")], "c string, p string")
    assert rows(tables.replace_children(children, children.where("c = 'c2'"), "p"), "c") == [("c2",), ("c3",)]
    left = tables.delete_cascade({"p": spark.createDataFrame([("p1",), ("p2",)], "p string"), "c": children}, spark.createDataFrame([("p1",)], "p string"), [("c", "p", "p")], "p", "p")
    assert rows(left["c"], "c") == [("c3",)] and rows(left["p"], "p") == [("p2",)]


def test_upsert_is_idempotent(spark):
    day = dt.datetime(2025, 1, 1)
    schema = "t string, url string, content_hash string, last_crawled timestamp, status string"
    stored = spark.createDataFrame([("t", "a", "H1", day, "active"), ("t", "b", "h2", day, "stale"), ("t", "z", "h9", day, "active")], schema)
    later = day + dt.timedelta(1)
    incoming = spark.createDataFrame([("t", "a", "h1", later, None), ("t", "b", "h2", later, None), ("t", "c", "h3", later, None)], schema)
    assert rows(tables.classify(stored, incoming, ["t", "url"]), "url", "outcome") == [("a", "unchanged"), ("b", "changed"), ("c", "new")]
    once = tables.upsert_documents(stored, incoming, ["t", "url"])
    twice = tables.upsert_documents(once, incoming, ["t", "url"])
    assert rows(once, *once.columns) == rows(twice, *once.columns)
    assert rows(once, "url", "status") == [("a", "active"), ("b", "active"), ("c", "active"), ("z", "active")]


@pytest.mark.parametrize("target", [1, 60, 10_000])
def test_compaction_keeps_every_byte(spark, tmp_path, target):
    rng = random.Random(target)
    files = [(f"/d/{n:03d}.json", ("\n".join(json.dumps({"n": n, "k": k}) for k in range(rng.randrange(4))) + rng.choice(["", "\n"])).encode() if n % 7 else b"") for n in range(40)]
    df = spark.createDataFrame([(p, bytearray(b)) for p, b in files] + [(None, bytearray(b"x")), ("/d/null", None)], "path string, content binary").withColumn("bin", F.lit("clash")).repartition(4)
    out = f"file://{tmp_path}/out"
    manifest = compaction.compact(df, out, target)
    checked = compaction.validate(manifest).collect()
    assert all(r["ok"] for r in checked) and sum(r["fragments"] for r in checked) == 40
    got = sorted((r["n"], r["k"]) for r in spark.read.schema("n int, k int").json(out).collect())
    want = sorted((json.loads(x)["n"], json.loads(x)["k"]) for _, b in files for x in b.decode().split("\n") if x)
    assert got == want and max(r["bytes_out"] for r in checked) <= target + 200
    compaction.compact(df, out, target).collect()  # again: the same files
    assert spark.read.schema("n int, k int").json(out).count() == len(want)


def test_compaction_of_csv_and_zstandard(spark, tmp_path):
    import zstandard

    csv = spark.createDataFrame([("a", bytearray(b"\xef\xbb\xbfx,y\r\n1,2")), ("b", bytearray(b"x,y\n3,4\n")), ("c", bytearray(b"5,6\n"))], "path string, content binary").coalesce(1)
    compaction.compact(csv, f"{tmp_path}/csv", 1000, "csv").collect()
    assert next((tmp_path / "csv").glob("part-*.csv")).read_bytes() == b"x,y\r\n1,2\n3,4\n5,6\n"
    frames = spark.createDataFrame([(n, bytearray(zstandard.compress(f'{{"n":"{n}"}}\n'.encode()))) for n in "abc"], "path string, content binary").coalesce(1)
    compaction.compact(frames, f"{tmp_path}/z", 1000, "zstd").collect()
    whole = next((tmp_path / "z").glob("part-*.zst")).read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read() == b'{"n":"a"}\n{"n":"b"}\n{"n":"c"}\n'
    with pytest.raises(Exception, match="zstandard frame"):
        compaction.compact(spark.createDataFrame([("a", bytearray(gzip.compress(b"x")))], "path string, content binary"), f"{tmp_path}/bad", 1000, "zstd").collect()
    assert compaction.compact(frames.limit(0), f"{tmp_path}/none", 1000).count() == 0


def test_frames_and_headers_are_followed_to_their_end():
    import zstandard

    plain, big = b"some text " * 50, random.Random(1).randbytes(400_000)
    frames = [zstandard.ZstdCompressor(write_checksum=c, write_content_size=w).compress(x) for c in (True, False) for w in (True, False) for x in (plain, big, b"", b"a" * 300_000)]
    skippable = (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"hello"
    whole = frames[0] + skippable + b"".join(frames[1:])
    for step in (1, 7, 4096, len(whole)) if len(whole) < 2_000_000 else (4096,):
        walker = compaction.FrameWalker()
        for k in range(0, len(whole), step):
            walker.feed(whole[k : k + step])
        walker.finish()
    for bad in (frames[0][:-1], frames[1][:1000], skippable[:9], whole + b"\x28\xb5"):
        walker = compaction.FrameWalker()
        walker.feed(bad)
        with pytest.raises(ValueError, match="cut off"):
            walker.finish()
    for step in (1, 3, 100):
        cut = lambda x: [x[k : k + step] for k in range(0, len(x), step)]  # noqa: B023, E731
        joiner = compaction.Joiner("csv")
        out = [b"".join(joiner.part(cut(x))) for x in (b'\xef\xbb\xbf"a\n""b",c\r\n1,2', b'"a\n""b",c\n3,"4\n5"\n', b'"a\n""b",c', b"", b"6,7")]
        assert out == [b'"a\n""b",c\r\n1,2\n', b'3,"4\n5"\n', b"", b"", b"6,7\n"]
        with pytest.raises(ValueError, match="quotation"):
            list(joiner.part(cut(b'1,"2\n')))
        joiner = compaction.Joiner("ndjson")
        assert b"".join(x for f in (b"\xef\xbb\xbf{}", b"\xef", b"", b"{}\n") for x in joiner.part(cut(f))) == b"{}\n\xef\n{}\n"


def test_a_folder_of_small_files(spark, tmp_path):
    rng = random.Random(9)
    want = []
    for n in range(300):
        folder = tmp_path / "in" / f"host{n % 7}" / f"day{n % 3}" if n % 5 else tmp_path / "in"
        folder.mkdir(parents=True, exist_ok=True)
        lines = [json.dumps({"n": n, "k": k, "t": "x" * rng.randrange(200)}) for k in range(rng.randrange(4))]
        want += lines
        (folder / f"f{n}.json").write_text("\n".join(lines) + rng.choice(["", "\n"] if lines else [""]))
    (tmp_path / "in" / "_SUCCESS").write_text("x")
    (tmp_path / "in" / "host1" / ".hidden.json").write_text("x")
    listed = compaction.list_files(spark, f"file://{tmp_path}/in", ".json")
    assert listed.count() == 300
    manifest = compaction.compact_files(listed, f"file://{tmp_path}/out", 8000)
    got = manifest.collect()
    assert all(r["checked"] for r in got) and sum(r["files"] for r in got) == 300 and 3 < len(got) < 20
    assert sorted(x for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()) == sorted(want)
    # no content in an exchange
    bins = compaction.plan_bins(listed, 8000)
    assert bins.columns == ["path", "size", "bin"]
    # a source that changes afterwards is noticed
    victim = next((tmp_path / "in" / "host2").rglob("f*.json"))
    victim.write_text("y" * len(victim.read_text()))
    assert sum(not r["checked"] for r in manifest.collect()) == 1 or not victim.read_text()
    with pytest.raises(Exception, match="bytes long"):
        compaction.compact_files(listed.withColumn("size", F.col("size") + 1), f"file://{tmp_path}/bad", 8000)
    assert compaction.compact_files(listed.limit(0), f"file://{tmp_path}/none").count() == 0


FETCH = "page_id long, url string, html string, status_code int, fetched_at timestamp, ingested_at timestamp"
DOC = "document_id string, url string, content_hash string, last_crawled timestamp, status string"


def _day(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(n)


def test_capture_takes_each_record_once(spark, tmp_path):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    fetches = [(1, "a", "x", 200, 1, 1), (2, "a", "y", 200, 2, 2), (3, "b", "x", 404, 1, 1), (4, "c", None, 200, 1, None), (5, None, "q", 200, 1, 1), (5, None, "q", 200, 1, 1), (6, "d", "same", 200, 1, 1), (7, "e", "old", 200, 1, 9)]
    docs = [("1", "d", sha("same").upper(), 1, "active"), ("2", "d", "0", 0, "active"), ("3", "e", sha("old"), 1, "stale")]
    f = spark.createDataFrame([(*r[:4], _day(r[4]), _day(r[5])) for r in fetches], FETCH)
    s = spark.createDataFrame([(*r[:3], _day(r[3]), r[4]) for r in docs], DOC)
    log = capture.ChangeLog(spark, f"file://{tmp_path}/log", partitions=3)
    feed = capture.ChangeCapture(spark, log, f"file://{tmp_path}/feed")
    process = lambda part: capture.changed_fetches(part, s)
    assert feed.run(process) == -1
    log.append(capture.fetch_records(f.where("page_id < 7")))
    first = feed.run(process)
    assert rows(feed.changes(first), "page_id", "change") == sorted([(2, "new"), (4, "new"), (5, "new")], key=repr)

    def fail(_):
        raise RuntimeError("lost")

    log.append(capture.fetch_records(f.where("page_id = 7")))
    with pytest.raises(RuntimeError):
        feed.run(process, before_commit=fail)
    # null, late and equal arrival instants, a smaller id
    log.append(capture.fetch_records(spark.createDataFrame([(8, "g", "n", 200, _day(0), _day(20)), (9, "h", "n", 200, _day(0), None), (0, "i", "n", 200, _day(0), _day(2)), (10, "j", "n", 200, None, _day(1))], FETCH)))
    second = feed.run(process)  # the planned batch, without what came since
    assert second == first + 1 and rows(feed.changes(second), "page_id", "change") == [(7, "inactive")]
    third = feed.run(process)
    assert rows(feed.changes(third), "page_id") == [(0,), (10,), (8,), (9,)]
    assert feed.run(process) == third
    assert len(rows(feed.state(), "url")) == 8
    log = capture.ChangeLog(spark, f"file://{tmp_path}/empty")
    empty = capture.ChangeCapture(spark, log)
    log.append(capture.fetch_records(f.limit(0)))
    assert empty.changes(empty.run(process)).count() == 0


def test_two_runners_and_two_writers(spark, tmp_path):
    f = lambda n: capture.fetch_records(spark.createDataFrame([(n, f"u{n}", "x", 200, _day(1), _day(1))], FETCH))
    s = spark.createDataFrame([], DOC)
    log = capture.ChangeLog(spark, f"file://{tmp_path}/log")
    assert [log.manifests.publish("segment", 7, {"by": n}) for n in "ab"] == [True, False] and log.manifests.read("segment", 7) == {"by": "a"}
    log = capture.ChangeLog(spark, f"file://{tmp_path}/second")
    log.append(f(1))
    one, two = (capture.ChangeCapture(spark, log, f"file://{tmp_path}/feed") for _ in range(2))
    process = lambda part: capture.changed_fetches(part, s)

    def overtaken(_):
        log.append(f(2))  # another writer, and another runner that commits first
        two.run(process)

    number = one.run(process, before_commit=overtaken)
    assert number == 0 and rows(one.changes(0), "page_id") == [(1,)]
    assert len([p for p in (tmp_path / "feed/sink").iterdir()]) == 1
    assert rows(two.changes(two.run(process)), "page_id") == [(2,)] and one.run(process) == 1


def test_capture_opens_new_segments_only(spark, tmp_path):
    log = capture.ChangeLog(spark, f"file://{tmp_path}/log", partitions=2)
    feed = capture.ChangeCapture(spark, log, f"file://{tmp_path}/feed", merge_every=2)
    s = spark.createDataFrame([], DOC)
    for n in range(6):
        log.append(capture.fetch_records(spark.createDataFrame([(n, f"u{n % 4}", f"x{n}", 200, _day(n), _day(1))], FETCH)))
        read = feed.records(feed.plan()[1])
        assert len({p.rsplit("/", 1)[0] for p in read.inputFiles()}) == 1
        assert "GreaterThan(__row,-1)" in read._jdf.queryExecution().toString()
        feed.run(lambda part: capture.resolved_fetches(part, s, feed.latest()))
    assert rows(feed.state(), "url", "page_id") == [("u0", 4), ("u1", 5), ("u2", 2), ("u3", 3)]
    assert feed.log.read("commit", 5)["state"] and len(feed.log.read("commit", 5)["since"]) < 3
    # a part of a segment: as far as a given offset
    ends = log.end()
    assert log.between(0, 5, {}, ends).count() == 6 and log.between(0, 5, ends, ends).count() == 0


def test_capture_in_batches_equals_one_batch(spark, tmp_path):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rng = random.Random(4)
    # by hand: a late older fetch over a change (a) and over stored content (b), back to the stored content (c), the same content again (d)
    fetches = [(1, "a", "new", 200, 5, 1), (2, "a", "old", 200, 3, 9), (3, "b", "kept", 200, 5, 1), (4, "b", "x", 200, 3, 9), (5, "c", "x", 200, 1, 1), (6, "c", "kept", 200, 2, 9), (7, "d", "x", 200, 1, 1), (8, "d", "x", 200, 2, 9)]
    fetches += [(n, rng.choice("efghijkl"), rng.choice(["kept", "x", "y"]), rng.choice([200, 200, 404]), rng.choice([None, *range(9)]), rng.choice([None, *range(1, 20)])) for n in range(10, 90)]
    f = spark.createDataFrame([(*r[:4], _day(r[4]), _day(r[5])) for r in fetches], FETCH)
    s = spark.createDataFrame([(u, u, sha("kept"), _day(1), "active") for u in "abcdefghi"], DOC)

    def fed(name, *parts):
        log = capture.ChangeLog(spark, f"file://{tmp_path}/{name}-log", partitions=3)
        feed = capture.ChangeCapture(spark, log, f"file://{tmp_path}/{name}")
        numbers = []
        for part in parts:
            log.append(capture.fetch_records(f.where(part)))
            numbers.append(feed.run(lambda new: capture.resolved_fetches(new, s, feed.latest())))
        return feed, numbers

    want = rows(fed("whole", "true")[0].state(), "url", "page_id", "change")
    log = capture.ChangeLog(spark, f"file://{tmp_path}/once")
    once = capture.ChangeCapture(spark, log)
    log.append(capture.fetch_records(f))
    assert want == rows(once.changes(once.run(lambda part: capture.changed_fetches(part, s))), "url", "page_id", "change")
    for name, cuts in (("a", [5]), ("b", [8]), ("c", [3, 12])):
        at = F.coalesce(F.datediff("ingested_at", F.lit(_day(0))), F.lit(99))
        edges = [-1, *cuts, 100]
        feed, numbers = fed(name, *[(at > low) & (at <= high) for low, high in itertools.pairwise(edges)])
        assert rows(feed.state(), "url", "page_id", "change") == want
        if len(cuts) == 1:
            assert {(r["url"], r["change"]) for r in feed.changes(numbers[0]).collect() if r["url"] in "abcd"} == {("a", "changed"), ("c", "changed"), ("d", "changed")}
            assert {(r["url"], r["change"]) for r in feed.changes(numbers[1]).collect() if r["url"] in "abcd"} == {("c", "withdrawn")}
    # the same records appended again are recognised
    again, _ = fed("again", "true", "true")
    assert rows(again.state(), "url", "page_id", "change") == want and again.changes(1).count() == 0


def test_crawl_operators(spark):
    robots = spark.createDataFrame([("a.example", 200, "User-agent: *\nDisallow: /private\nAllow: /private/open\nSitemap: https://a.example/s1.xml\n sitemap: https://a.example/s2.xml"), ("b.example", 404, "Disallow: /")], "domain string, status int, body string")
    pages = spark.createDataFrame([("https://a.example/private/x",), ("https://www.a.example/private/open/x",), ("https://a.example/y",), ("https://b.example/y",)], "url string")
    assert [r["allowed"] for r in crawl.robots_allowed(pages, crawl.robots_rules(robots)).orderBy("url").collect()] == [False, True, True, True]
    starts = crawl.robots_sitemaps(robots)
    assert rows(starts, "sitemap") == [("https://a.example/s1.xml",), ("https://a.example/s2.xml",), ("https://b.example/sitemap.xml",)]
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    maps = [("https://a.example/s1.xml", 200, f"<sitemapindex {ns}><sitemap><loc>https://a.example/s3.xml</loc></sitemap></sitemapindex>"), ("https://a.example/s2.xml", 200, f"<urlset {ns}><url><loc>u1</loc></url><url><loc> u2 </loc></url></urlset>"), ("https://a.example/s3.xml", 200, f"<urlset {ns}><url><loc>u2</loc></url><url><loc>u3</loc></url></urlset>")]
    found = crawl.sitemap_urls(starts.where("domain = 'a.example'"), spark.createDataFrame(maps, "url string, status int, xml string"))
    assert [r["url"] for r in found.orderBy("ord").collect()] == ["u2", "u3", "u1"]
    scopes = spark.createDataFrame([(["h1", "h2"], ["/a", "b"]), (["h3"], [])], "hosts array<string>, paths array<string>")
    assert rows(crawl.seed_urls(scopes), "url") == [("https://h1/a",), ("https://h1/b",), ("https://h2/a",), ("https://h2/b",), ("https://h3/",)]
    url, base = F.lit("https://x.a.example:80/p/q"), F.lit("a.example")
    got = spark.range(1).select(crawl.scope_col(url, base), crawl.scope_col(url, base, F.array(F.lit("x.a.example"))), crawl.scope_col(url, base, F.array().cast("array<string>"), F.array(F.lit("/p"))), crawl.scope_col(url, F.lit("other"))).first()
    assert tuple(got) == (True, False, True, False)
    checkpoints = spark.createDataFrame([("r", [("u", 1)], ["u"], 1, 0, 0), ("r", [("u", None)], ["u"], 1, 0, 0), ("q", [], [], 0, 0, 0), ("r", None, [], 0, 0, 0)], "root_url string, queue array<struct<url:string,depth:int>>, visited array<string>, pages_saved int, pages_skipped int, errors int")
    assert [r["state"] for r in crawl.checkpoint_state(checkpoints, "r").collect()] == ["ok", "corrupt", "incompatible-root-url", "corrupt"]
    reasons = crawl.first_reason([("a", F.col("x") > 1), ("b", F.col("x") > 0)])
    assert [r[0] for r in spark.createDataFrame([(2,), (1,), (0,), (None,)], "x int").select(reasons).collect()] == ["a", "b", None, None]


def test_metrics(spark):
    run = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0), (2, "a", 1.0)], "query_id int, item string, score double")
    gold = spark.createDataFrame([(1, "b"), (1, "z"), (2, "q")], "query_id int, item string")
    got = {r["query_id"]: r for r in metrics.retrieval_metrics(run, gold, 2).collect()}
    assert got[1]["recall"] == 0.5 and got[1]["mrr"] == 0.5 and 0 < got[1]["ndcg"] < 1 and got[2]["recall"] == 0 == got[2]["ndcg"]
    samples = spark.createDataFrame([("g", n, v) for n, v in enumerate([5, 6, 4, 5, 1])], "g string, n int, v int")
    assert [r["size"] for r in metrics.hill_climb(samples, "g", "n", "v", 3).orderBy("seq").collect()] == [4, 5, 4, 3, 4]
    kids = spark.createDataFrame([("c1", "d1", "t1"), ("c2", "d1", "t2")], "c string, d string, t string")
    assert rows(metrics.tenant_mismatches(kids, spark.createDataFrame([("d1", "t1")], "d string, t string"), "d", "t"), "c") == [("c2",)]


def test_every_query_has_a_stable_name():
    from corpuscade import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert len(list(itertools.chain(queries.queries()))) > 60


def _crowd(spark, seed, docs=700, questions=150):
    """Texts that nearly all share some words, with ties, repeated ids, blank texts; questions with repeats, without a match, blank."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["of"] * 6 + ["for"] * 4 + [f"w{int(rng.paretovariate(0.6)) % 90}"] * 3) for _ in range(n))
    texts = [(f"c{rng.randrange(10**6):06}", text(rng.choice([3, 3, 5, 9]))) for _ in range(docs)]
    texts += [("c5", "of w1"), ("c5", "of w2"), ("c5", "of of w1 w3 w4"), ("c6", None), ("c7", "")]
    asked = [(n, text(rng.choice([1, 2, 4, 7]))) for n in range(questions)] + [(997, "unheard"), (998, ""), (999, None), (7, "of w3")]
    return spark.createDataFrame(texts, "id string, t string").repartition(3), spark.createDataFrame(asked, "q long, s string")


@pytest.mark.parametrize("limit", [1, 8, 120])
def test_best_scores_in_blocks_equal_the_joined_ones(spark, monkeypatch, limit):
    for name, size in (("FIRST", 16), ("HELD", 128), ("FEW", 8), ("QUESTIONS", 50)):
        monkeypatch.setattr(lexical, name, size)
    docs, asked = _crowd(spark, limit)
    joined = ranking.top_k_per_group(lexical.scores(docs, asked, "id", "t", "q", "s").withColumn("score", F.round("score", 6)), ["q"], [F.desc("score"), F.asc("id")], limit)
    got = lexical.best_scores(docs, asked, "id", "t", "q", "s", limit, 6)
    assert rows(got, "q", "id", "score") == rows(joined, "q", "id", "score")
    empty = docs.limit(0)
    assert lexical.best_scores(empty, asked, "id", "t", "q", "s", limit).count() == 0 and lexical.best_scores(docs, asked.limit(0), "id", "t", "q", "s", limit).count() == 0


def test_bm25_search_topk_makes_no_row_for_each_pair(spark, tmp_path):
    """1,000 questions and 1,000 chunks that share a word: no join or shuffle of a million pairs."""
    from corpuscade.plans.lexical import bm25_search_topk

    chunk = "concat('c', lpad(id, 4, '0')) AS chunk_id, concat('d', id) AS document_id, 'u' AS university_id, 'x' AS domain, 'y' AS url, 'h' AS heading, concat('cost of w', id % 40) AS text, 0 AS position"
    spark.sql(f"SELECT {chunk} FROM range(1000)").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.sql("SELECT id AS query_id, concat('cost of w', id % 40) AS query_text FROM range(1000)").write.parquet(f"{tmp_path}/search_results.parquet")
    found = bm25_search_topk(spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = rows(found, "query_id", "chunk_id")
    assert got == sorted(((q, f"c{q % 40 + 40 * n:04}") for q in range(1000) for n in range(8)), key=repr)
