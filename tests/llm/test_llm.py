"""Training-text operators against brute force on small, dirty tables."""

import collections
import itertools
import math
import random
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscade.llm import boilerplate, leakage, leximin, neardup, packing, repeated_lines, sentences, similar

WORDS = ["".join(chr(97 + int(c)) for c in f"{n:03d}") + "ow" for n in range(400)]


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# --- near duplicates


def shingles(text, size):
    w = neardup.WORD.findall((text or "").lower())
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def edited(rng, text, rate):
    return " ".join(rng.choice(WORDS) if rng.random() < rate else w for w in text.split())


@pytest.mark.parametrize(("size", "threshold", "limit"), [(3, 0.6, 400), (5, 0.8, 400), (3, 0.6, 3)])
def test_near_duplicates_equal_brute_force(spark, size, threshold, limit):
    rng = random.Random(size)
    frame = " ".join(rng.choice(WORDS) for _ in range(25))
    texts = []
    for _ in range(25):
        base = " ".join(rng.choice(WORDS) for _ in range(rng.choice([4, 30, 120, 400])))
        texts += [base, *(edited(rng, base, rng.choice([0.0, 0.02, 0.05, 0.1])) for _ in range(3)), f"{frame} {base[:60]}", base.upper()]
    data = [(n, t, "x") for n, t in enumerate(texts)] + [(900, None, "x"), (901, " ", "x"), (902, "a b", "x"), (903, "a b", "x"), (0, texts[0], "x"), (None, texts[0], "x")]
    df = spark.createDataFrame(data, "id long, body string, cls string").repartition(3)
    found = neardup.NearDuplicates(df, "id", "body", size=size, threshold=threshold, list_limit=limit)
    sets = {n: shingles(t, size) for n, t, _ in data if n is not None}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    assert set(rows(found.pairs(), "doc_a", "doc_b")) == want
    groups = {r["doc"]: r for r in found.groups().collect()}
    assert set(groups) == {n for n, s in sets.items() if s}
    reach = {n: n for n in groups}
    for _ in range(len(reach)):
        for a, b in want:
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert {n: r["group_id"] for n, r in groups.items()} == reach
    assert sum(r["members"] for r in groups.values()) == sum(len([m for m in groups.values() if m["class_id"] == r["class_id"]]) for r in groups.values())


def test_a_template_meets_pairs_in_proportion(spark):
    """Pages of one template with more content of their own don't all meet one another."""
    rng = random.Random(5)
    frame = [f"t{n}" for n in range(600)]
    met = {}
    for count in (500, 1000):
        data = [(p, " ".join(frame + [f"o{p}x{n}" for n in range(450)])) for p in range(count)]
        data += [(count + p, data[p][1] + " " + " ".join(rng.choice(WORDS) for _ in range(20))) for p in range(20)]
        found = neardup.NearDuplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), size=3, threshold=0.6)
        slim = found._classes()
        postings = found._postings(slim)
        met[count] = found._candidates(postings).count() + found._crowded(postings).count()
        assert set(rows(found.pairs(), "doc_a", "doc_b")) == {(p, count + p) for p in range(20)}
    assert met[500] < 2 * 500 and met[1000] < 2 * 1000 and met[1000] < 2 * met[500]


def test_groups_have_a_row_for_every_document(spark):
    data = [(1, "One two"), (2, "one, TWO"), (3, "one"), (4, None), (5, " "), (6, "a b c d"), (7, "a b c d"), (8, "--"), (2, "one, TWO"), (9, "two one"), (None, "one")]
    same = spark.createDataFrame([(3, 4), (5, 6)], "a long, b long")
    found = neardup.NearDuplicates(spark.createDataFrame(data, "doc_id long, text string"), size=3, threshold=0.6).groups(same, every=True)
    want = [(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 3), (4, 4, 1, 3), (5, 5, 1, 5), (6, 6, 2, 5), (7, 6, 2, 5), (8, 8, 1, 8), (9, 9, 1, 9)]
    assert sorted(map(tuple, found.select("doc", "class_id", "members", "group_id").collect())) == want


def test_near_duplicates_of_nothing(spark):
    found = neardup.NearDuplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert found.pairs().count() == 0 and found.groups().count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(n, n + 1) for n in range(400, 440)] + [(500, n) for n in range(501, 560)]
    got = dict(rows(neardup.components(spark.createDataFrame(edges, "u long, v long")), "cls", "root"))
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


# --- leximin


def test_leximin_equals_brute_force(spark):
    rng = random.Random(3)
    data = []
    for q in (1, 2, None):
        for i in range(30 if q == 1 else 7):
            data.append((q, f"c{i}", rng.choice([None, float("nan"), float(rng.randrange(6)), math.inf]), float(rng.randrange(5)) * 1000, -rng.random(), 9))
    data.append(data[0])
    df = spark.createDataFrame(data, "q long, c string, a double, b double, s double, n int").repartition(4)
    got = {(r["q"], r["place"]): r["c"] for r in leximin.leximin_top(df, "q", "c", ("a", "b", "s"), 3).collect()}
    whole = {(r["q"], r["place"]): r["c"] for r in leximin.leximin_ranking(df, "q", "c", ("a", "b", "s")).collect()}
    assert len(whole) == 44
    for q in (1, 2, None):
        own = sorted({d[1]: d for d in data if d[0] == q}.values())
        clean = [[None if v is None or math.isnan(v) else v for v in d[2:5]] for d in own]
        profile = lambda k: sorted(0.0 if clean[k][j] is None else (sum(1 for x in clean if x[j] is not None and x[j] < clean[k][j]) + sum(1 for x in clean if x[j] == clean[k][j]) / 2) / len(own) for j in range(3))  # noqa: E731, B023
        want = sorted(range(len(own)), key=lambda k: ([-x for x in profile(k)], own[k][1]))[:3]
        assert [got[q, n + 1] for n in range(3)] == [own[k][1] for k in want]
        assert [whole[q, n + 1] for n in range(3)] == [own[k][1] for k in want]
    assert leximin.leximin_top(df.limit(0), "q", "c", ("a", "b"), 3).count() == 0


def test_leximin_does_not_look_at_scales(spark):
    data = [(1, f"c{n}", float(n), float(9 - n)) for n in range(10)]
    df = spark.createDataFrame(data, "q int, c string, a double, b double")
    one = leximin.leximin_top(df, "q", "c", ("a", "b"), 10)
    two = leximin.leximin_top(df.withColumn("a", F.exp("a") * 1e6).withColumn("b", F.col("b") / 1e9 - 5), "q", "c", ("a", "b"), 10)
    assert rows(one, "c", "place") == rows(two, "c", "place") and one.where("place = 1").first()["c"] in ("c4", "c5")


# --- repeated lines


def page_table(spark):
    rng = random.Random(5)
    data = []
    for n in range(40):
        site = "https://WWW.A.example:80/x" if n % 3 else "http://b.example/y"
        lines = ["Home 12", " HOME  7", "About us", f"own {WORDS[n]} {n}", "", "©  2020 Owner", "12", "Straße"] if n % 2 else [f"only {WORDS[n]}", "STRASSE", "© 2021 owner"]
        data.append((n, f"{site}/{n}", "\n".join(lines)))
    data += [(40, None, "home"), (41, "https://a.example", None), (42, "https://a.example", " \n\n"), data[1], data[1]]
    rng.shuffle(data)
    return spark.createDataFrame([(*d, 1, "x") for d in data], "page_id long, url string, text string, doc int, site string").repartition(4), data


def brute_key(line):
    return "".join(ch for ch in line.lower().replace("ß", "ss") if not ch.isspace() and unicodedata.category(ch) != "Nd")


def brute_repeated(data, least):
    docs = collections.defaultdict(set)
    lines = {}
    for p, url, text in set(data):
        if text is None:
            continue
        host = "" if url is None else url.split("//")[1].split("/")[0].lower().split(":")[0].removeprefix("www.")
        for n, line in enumerate(text.split("\n")):
            if brute_key(line):
                docs[host, brute_key(line)].add(p)
                lines[p, n] = (host, brute_key(line))
    return {k for k, v in lines.items() if len(docs[v]) >= least}, lines


def test_repeated_lines_equal_brute_force(spark):
    df, data = page_table(spark)
    want, _ = brute_repeated(data, 10)
    got = repeated_lines.repeated_lines(df, 10)
    assert set(rows(got, "doc", "line_no")) == want and want
    cleaned = dict(rows(repeated_lines.without_repeated_lines(df, 10), "page_id", "text"))
    for p, _, text in set(data):
        assert cleaned[p] == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (p, n) not in want))
    assert repeated_lines.repeated_lines(df.limit(0), 10).count() == 0


def test_blocks_over_many_batches(spark):
    """Runs of one prefix go over many batches and partitions; a document holds a line twice."""
    rng = random.Random(3)
    data = [(p, f"https://{'ab'[p % 4 == 0]}.example/", "\n".join(["Home", rng.choice("xyz"), f"w{'abcdefgh'[p % 8]}{'q' * (p % 29)}", "Home", rng.choice("xyz"), "Foot"])) for p in range(400)]
    data += [(p, "https://few.example/", "Home\nx\nHome\nx") for p in range(900, 906)]
    df = spark.createDataFrame(data, "page_id long, url string, text string").repartition(3)
    want, _ = brute_repeated(data, 10)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows(repeated_lines.repeated_lines(df, 10), "doc", "line_no")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) == want and len(got) == len(want) and not any(p >= 900 for p, _ in got)


def test_longest_blocks_are_exact(spark):
    rng = random.Random(6)
    notice = [f"{a} notice {b}" for a, b in itertools.product("abcdefghij", "klmnopqrst")][:70]
    data = []
    for p in range(24):
        cut = [70, 70, 45, 7, 6, 5, 3][p % 7] if p < 21 else 0
        own = [f"own {'xyz'[p % 3]} {chr(97 + p)} {k * 'q'}" for k in range(3)]
        data.append((p, "https://a.example/x", "\n".join(own + notice[:cut] + own[::-1] + notice[rng.randrange(60) :][:6])))
    df = spark.createDataFrame(data, "page_id long, url string, text string").repartition(3)
    for least, window in ((3, 4), (5, 4), (5, 1)):
        seqs, spans = {p: [brute_key(x) for x in t.split("\n")] for p, _, t in data}, collections.defaultdict(set)
        for p, s in seqs.items():
            for k in range(len(s)):
                for length in range(1, len(s) - k + 1):
                    spans[tuple(s[k : k + length])].add(p)
        want = {}
        for p, s in seqs.items():
            for k in range(len(s)):
                fit = [m for m in range(1, len(s) - k + 1) if len(spans[tuple(s[k : k + m])]) >= least]
                if fit:
                    want[p, k] = (max(fit), len(spans[tuple(s[k : k + max(fit)])]))
        got = {(r["doc"], r["line_no"]): (r["block_lines"], r["docs"]) for r in repeated_lines.repeated_blocks(repeated_lines.site_documents(df), least, window).collect()}
        assert got == want and max(m for m, _ in want.values()) > 32


# --- packing


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_valid_and_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 50, 512]))
    histogram = dict(collections.Counter(int(x) for x in rng.integers(1, capacity + 1, int(rng.choice([0, 1, 9, 400])))))
    plan = packing.plan_containers(histogram, capacity)
    load, seen = collections.Counter(), collections.defaultdict(list)
    for size, first, count, container, each in plan.runs:
        for k in range(count):
            load[container + k // each] += size
            seen[size].append(first + k)
    assert all(v <= capacity for v in load.values()) and set(load) == set(range(plan.containers))
    assert {s: sorted(v) for s, v in seen.items()} == {s: list(range(c)) for s, c in histogram.items()}
    total = sum(s * c for s, c in histogram.items())
    assert plan.containers <= 11 / 9 * max(1, -(-total // capacity)) + 4 or seed


def optimal(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for n in {b: n for n, b in enumerate(bins) if b + sizes[k] <= capacity}.values():
            place(k + 1, bins[:n] + [bins[n] + sizes[k]] + bins[n + 1 :])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_reduction_costs_no_container(seed):
    """Where the dominance reduction fixes everything, the packing is optimal; best fit stays within one."""
    rng = random.Random(seed)
    sizes = [rng.randrange(2, 21) for _ in range(rng.randrange(1, 10))]
    plan = packing.plan_containers(dict(collections.Counter(sizes)), 20)
    exact = optimal(sizes, 20)
    assert exact <= plan.containers <= exact + (plan.fixed < plan.containers)


def test_reduction_keeps_an_optimum():
    """Fixed containers plus an optimal packing of the rest need no more than an optimal packing."""
    rng = random.Random(7)
    fixed = 0
    for _ in range(1500):
        capacity = rng.randint(8, 40)
        low = rng.choice([1, 1, capacity // 6 + 1, capacity // 4 + 1])
        sizes = [rng.randint(low, capacity) for _ in range(rng.randint(2, 7))]
        plan = packing.plan_containers(dict(collections.Counter(sizes)), capacity)
        rest = [size for size, _, count, container, each in plan.runs for k in range(count) if container + k // each >= plan.fixed]
        assert plan.fixed + (optimal(rest, capacity) if rest else 0) == optimal(sizes, capacity), (capacity, sizes)
        fixed += plan.fixed
    assert fixed > 1500
    # the largest item can't be fixed and stays a candidate beside the others
    plan = packing.plan_containers(dict.fromkeys([1, 2, 7, 14, 18, 25, 28, 29, 32], 1), 38)
    assert plan.containers == 5


def test_plan_rows_depend_on_sizes_only():
    n = 10_000_000
    plan = packing.plan_containers({52: n, 45: n, 20: 2 * n}, 100)
    assert len(plan.runs) < 10 and plan.containers == n + 2 * n // 5
    rng = random.Random(2)
    sizes = rng.sample(range(1, 2049), 900)
    runs = [len(packing.plan_containers({s: rng.randint(1, 9) * scale for s in sizes}, 2048).runs) for scale in (10, 10_000)]
    assert max(runs) < 10 * len(sizes)


def test_packing_of_a_table(spark):
    rng = random.Random(1)
    sizes = [rng.choice([3, 3, 3, 40, 100, 101, 250, 999]) for _ in range(300)]
    data = [(n, s, 1) for n, s in enumerate(sizes)] + [(0, sizes[0], 1), (900, 0, 1), (901, None, 1)]
    df = spark.createDataFrame(data, "doc long, size long, container int").repartition(5)
    got = packing.pack(df, [(1, 100), (2, 7)]).collect()
    for window, capacity in ((1, 100), (2, 7)):
        own = [r for r in got if r["window_id"] == window]
        load = collections.Counter()
        parts = collections.defaultdict(list)
        for r in own:
            load[r["container"]] += r["token_count"]
            parts[r["doc"]].append((r["token_from"], r["token_count"]))
        assert max(load.values()) <= capacity and set(load) == set(range(len(load)))
        for n, s in enumerate(sizes):
            pieces = sorted(parts[n])
            assert [p[0] for p in pieces] == list(itertools.accumulate((p[1] for p in pieces[:-1]), initial=0)) and sum(p[1] for p in pieces) == s
            assert len(pieces) == -(-s // capacity)
        assert set(parts) == set(range(300))
    assert packing.pack(df.limit(0), [(1, 10)]).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "x y " * 200_000)], "doc_id long, text string")
    sizes = dict(rows(packing.sized(df), "doc", "size"))
    assert set(sizes) == {1, 4, 5} and sizes[1] == 2 and sizes[4] > 1 and sizes[5] > 300_000


# --- leaks


def brute_leaks(docs, items, span=12):
    out = set()
    for i, t in items:
        w = leakage.words(t or "")
        grams = {tuple(w[k : k + span]) for k in range(len(w) - span + 1)}
        for d, text in docs:
            x = leakage.words(text or "")
            if any(tuple(x[k : k + span]) in grams for k in range(len(x) - span + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("per_index", [20_000, 3])
def test_leaks_equal_brute_force(spark, per_index):
    rng = random.Random(7)
    few = WORDS[:60]
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.randrange(5, 60)))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for n in range(80):
        w = [rng.choice(few) for _ in range(rng.randrange(0, 200))]
        if n % 2:
            source = rng.choice(items[:12])[1].split()
            length = rng.choice([9, 11, 12, 13, 30])
            at = rng.randrange(max(1, len(source) - length + 1))
            place = rng.randrange(len(w) + 1)
            w[place:place] = [x.upper() + "," if rng.random() < 0.2 else x for x in source[at : at + length]]
        docs.append((n, " ".join(w)))
    docs += [(200, None), (201, " "), (202, ("zz " * 300_000) + items[0][1] + " zz" * 100)]
    d = spark.createDataFrame([(*x, 1) for x in docs + docs[:3]], "doc_id long, text string, item_id int").repartition(4)
    i = spark.createDataFrame([(*x, "x") for x in items + items[:2]], "item_id long, text string, doc_id string")
    got = leakage.leaks(d, i, items_per_index=per_index)
    assert set(rows(got, "doc_id", "item_id")) == brute_leaks(docs, items)
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_wand_finds_all_items_above_their_need():
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(WORDS[:50]) for _ in range(40))) for i in range(60)]
    index = leakage.ItemIndex(span=12, block=4).build(items)
    for _ in range(200):
        terms = rng.sample(range(len(index.terms)), 25)
        score = collections.Counter()
        for t in terms:
            for d, w in zip(index.docs[t], index.impacts[t]):
                score[d] += w
        assert sorted(index.search(terms)) == sorted(d for d, s in score.items() if s >= index.need[d])


# --- sentences

CASES = [
    ("Dr. M. Prun leads it. See Fig. 2 and pp. 16–232 of no. 7. It costs 3.5 euros.", ["Dr. M. Prun leads it.", "See Fig. 2 and pp. 16–232 of no. 7.", "It costs 3.5 euros."]),
    ("Open at 10.30 a.m. for all. Tours begin at 10 a.m. The hall is cold. pH values rose etc. iTax is closed.", ["Open at 10.30 a.m. for all.", "Tours begin at 10 a.m.", "The hall is cold.", "pH values rose etc.", "iTax is closed."]),
    ("He wrote: “Come early. Bring notes.” Research goes on. “Is it open?” asked Ann. Well... the end came?! Yes.", ["He wrote: “Come early. Bring notes.”", "Research goes on.", "“Is it open?” asked Ann.", "Well... the end came?!", "Yes."]),
    ('"We start in June. Wear boots," said Ms. K. Then (see sec. 4.8. there) we go.', ['"We start in June. Wear boots," said Ms. K. Then (see sec. 4.8. there) we go.']),
    ("Am 25. August beginnt es. Im 9. Jahrhundert, z. B. ca. 43,50 Kronen. Nr. 211 von 2020. Das ist d. h. gut.", ["Am 25. August beginnt es.", "Im 9. Jahrhundert, z. B. ca. 43,50 Kronen.", "Nr. 211 von 2020.", "Das ist d. h. gut."]),
    ("« Est-ce possible ? » demande-t-il. Quelle belle récolte ! M. D et Mme W, p. ex. ici.", ["« Est-ce possible ? » demande-t-il.", "Quelle belle récolte !", "M. D et Mme W, p. ex. ici."]),
    ("老师说：“请早点来。记得带证件。”平均为6.7分。“还有名额吗？”学生问道。（见第3.1节）好！", ["老师说：“请早点来。记得带证件。”", "平均为6.7分。", "“还有名额吗？”学生问道。", "（见第3.1节）好！"]),
    ("館（旧館。現在は休館中）は来年です。「席はありますか。」と尋ねた。", ["館（旧館。現在は休館中）は来年です。", "「席はありますか。」と尋ねた。"]),
    ("डॉ. वेमो ने जाँच की। “क्या जगह है?” कारी ने पूछा।", ["डॉ. वेमो ने जाँच की।", "“क्या जगह है?” कारी ने पूछा।"]),
    ("سأل موسى: «هل بقي مكان؟» ألقى د. داتا محاضرة.", ["سأل موسى: «هل بقي مكان؟»", "ألقى د. داتا محاضرة."]),
    ("รถออกทุก 4 นาทีจากประตู คณะเปิดรับ 52 คน", ["รถออกทุก 4 นาทีจากประตู", "คณะเปิดรับ 52 คน"]),
    ("В 2023 г. фонд оплатил. «Места есть?» — спросил он.", ["В 2023 г. фонд оплатил.", "«Места есть?» — спросил он."]),
    ("Title without mark\r\n\n1. First item. More of it\n- second\n  \n", ["Title without mark", "1. First item.", "More of it", "- second"]),
    ("An open “quote never closes. Next one.", ["An open “quote never closes.", "Next one."]),
]


@pytest.mark.parametrize(("given", "want"), CASES)
def test_sentences(given, want):
    assert [given[a:b] for a, b in sentences.sentence_spans(given)] == want


def test_sentences_cover_everything_but_white_space():
    rng = random.Random(11)
    marks = list("aB1 .!?…。”“\"'’‘«»()[]\n\r\t;:،؟กข一ア-•") + ["Mr.", "etc.", " ", "\U0001f600"]
    for _ in range(3000):
        given = "".join(rng.choice(marks) for _ in range(rng.randrange(40)))
        spans = sentences.sentence_spans(given)
        covered = {k for a, b in spans for k in range(a, b)}
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert all(given[k].isspace() for k in set(range(len(given))) - covered)
        assert all(not given[a].isspace() and not given[b - 1].isspace() and "\n" not in given[a:b] for a, b in spans)


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "At home. It rains."), (2, None), (3, " \n"), (None, "Y."), (5, "Long one. " * 100_000), (1, "At home. It rains.")], "doc_id long, text string").withColumn("sent_start", F.lit("clash"))
    got = sentences.sentences(df, with_text=True)
    count = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert count == {1: 4, None: 1, 5: 100_000} and got.where("doc_id = 1 AND sent_start = 9").first()["sentence"] == "It rains."
    assert sentences.sentences(df.limit(0)).count() == 0


# --- similar vectors


def brute_neighbours(vectors, k):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids])
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = m @ m.T
    np.fill_diagonal(s, -9)
    return {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(ids)) for b in np.argsort(-s[a], kind="stable")[:k]}


def test_recall_of_similar_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = {}
    for c in range(150):
        centre = rng.standard_normal(32)
        for n in range(8):
            vectors[c * 8 + n] = (centre + rng.standard_normal(32) * 0.35) * rng.uniform(0.1, 9)
    data = [(i, [float(x) for x in v], "x") for i, v in vectors.items()]
    dirty = [(9000, None, "x"), (9001, [1.0], "x"), (9002, [0.0] * 32, "x"), (9003, [float("nan")] * 32, "x"), (None, data[0][1], "x"), (9004, [float("inf")] * 32, "x"), (9005, [None] * 32, "x"), data[3]]
    df = spark.createDataFrame(data + dirty, "id long, v array<float>, rep string").repartition(4)
    for segment in (4096, 64):
        found = similar.SimilarVectors(df, "id", "v", 32, segment=segment).neighbours()
        got = {(min(r["id"], r["neighbour"]), max(r["id"], r["neighbour"])) for r in found.collect()}
        want = brute_neighbours(vectors, 5)
        assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


@pytest.mark.parametrize("segment", [4096, 64])
def test_recall_where_a_third_is_one_crowd(spark, segment):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(32)
    vectors = {n: centre + rng.standard_normal(32) * 0.33 for n in range(1000)}
    for c in range(250):
        own = rng.standard_normal(32)
        vectors |= {1000 + c * 8 + n: own + rng.standard_normal(32) * 0.35 for n in range(8)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "id long, v array<float>").repartition(4)
    got = collections.defaultdict(set)
    for r in similar.SimilarVectors(df, "id", "v", 32, segment=segment).neighbours().collect():
        got[r["id"]].add(r["neighbour"])
    m = np.array([vectors[n] for n in range(len(vectors))])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T
    np.fill_diagonal(near, -9)
    hits = [len(got[n] & set(np.argsort(-near[n], kind="stable")[:5].tolist())) / 5 for n in range(len(vectors))]
    assert np.mean(hits[:1000]) > 0.98 and np.mean(hits[1000:]) > 0.95


@pytest.mark.parametrize("most", [5, 20, 1000])
@pytest.mark.parametrize(("window", "threshold"), [(0, 1), (20, 1), (20, 2), (20, 3), (255, 2), (255, 4)])
def test_meetings_count_every_collision(window, threshold, most, monkeypatch):
    monkeypatch.setattr(similar, "LISTED", 300)  # several parts
    rng = np.random.default_rng(2)
    now, size, t = 3, 80, 6
    tail = np.array([rng.permutation([now, *rng.choice(np.delete(np.arange(16), now), t - 1, replace=False)]) for _ in range(size)]).astype("<u2")
    height = rng.integers(0, 256, (size, t)).astype(np.uint8)
    height[:30] //= 4
    asked = np.flatnonzero(rng.random(size) < 0.5)
    parts = list(similar.meetings(tail, height, asked, now, window, threshold, most))
    got = [(int(x), int(y), bool(f)) for part in parts for x, y, f in zip(*part[:3])]
    want = set()
    for x in asked.tolist():
        for y in range(size):
            other = dict(zip(tail[y].tolist(), height[y].tolist()))
            hits = [d for d, h in zip(tail[x].tolist(), height[x].tolist()) if d in other and abs(h - other[d]) <= window]
            if now in hits and len(hits) >= threshold:
                want.add((x, y, hits[0] == now))
    crowded = {x for x, n in collections.Counter(x for x, _, _ in want).items() if n > most}
    assert sorted(int(x) for part in parts for x in part[3]) == sorted(crowded)
    want = {w for w in want if w[0] not in crowded}
    assert len(got) == len(want) and set(got) == want


def test_rounds_read_stored_projections_only(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(n, [float(x) for x in rng.standard_normal(16)]) for n in range(40)], "id long, v array<float>")
    found = similar.SimilarVectors(df, "id", "v", 16)
    for queries in (None, spark.createDataFrame([(4,), (7,)], "rep long")):
        plan = found._candidates(queries, 1)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "vec#" not in plan


def test_copies_and_few_vectors(spark):
    one, two = [1.0, 0.0, 0.0, 0.5], [0.0, 1.0, 0.0, 0.0]
    df = spark.createDataFrame([(n, one) for n in range(9)] + [(20, two), (21, [2.0, 0.0, 0.0, 1.0])], "id long, v array<double>")
    found = collections.defaultdict(list)
    for r in similar.SimilarVectors(df, "id", "v", 4, k=3).neighbours().orderBy("id", "place").collect():
        found[r["id"]].append(r["neighbour"])
    assert found[5] == [0, 1, 2] and found[0] == [1, 2, 3] and found[21] == [0, 1, 2]
    assert similar.SimilarVectors(df.limit(0), "id", "v", 4).neighbours().count() == 0
    assert similar.SimilarVectors(df.limit(1), "id", "v", 4).neighbours().count() == 0


# --- boilerplate

RAW = "page_id long, url string, html string, status_code int"
EXTRACTED = "page_id long, url string, text string, title string"


def sites(rng, pages):
    raw, extracted, truth = [], [], set()
    for p in range(pages):
        name = ("alpha", "beta")[p % 2]
        blocks = [("<nav><a href='/x'>{}</a></nav>", "Home", 1), ("<nav><a href='/y'>{}</a></nav>", "Study with us", 1), ("<main>", None, 0), ("<h1>{}</h1>", f"About {WORDS[p]}", 0)]
        for n in range(rng.randrange(1, 6)):
            blocks.append(("<p>{}</p>", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 60))) + f" {p} {n}{WORDS[p + n]}.", 0))
        blocks += [("<ul><li>{}</li></ul>", f"{WORDS[p]} kit from {WORDS[p + 1]}", 0), ("<p class='meta'>{}</p>", f"Tell a friend about {name}", 1), ("<aside><p>{}</p></aside>", f"Related: {WORDS[p + 7]} {WORDS[p + 3]}", 1), ("</main>", None, 0), ("<footer><small>{}</small></footer>", f"© {2000 + p} University of {name}. All rights reserved.", 1)]
        lines = [b for b in blocks if b[1]]
        raw.append((p, f"https://{name}.example/{p}", "<html><head><title>t</title></head><body>" + "\n".join(b[0].format(b[1]) for b in blocks) + "</body></html>", 200))
        extracted.append((p, f"https://www.{name}.example/{p}", "\n".join(b[1] for b in lines), None))
        truth |= {(p, n) for n, b in enumerate(lines) if b[2]}
    return raw, extracted, truth


def test_boilerplate_on_pages_it_was_not_trained_on(spark):
    raw, extracted, truth = sites(random.Random(4), 60)
    more = [(900, "https://alpha.example/z", None, 200)], [(900, "https://alpha.example/z", "Study with us\n\nsome words of its own here\r", None), (901, None, None, None), (902, "https://alpha.example/q", " \n", None)]
    r = spark.createDataFrame([(*x, 0) for x in raw + more[0] + raw[:2]], RAW + ", marked int").repartition(3)
    e = spark.createDataFrame([(*x, 0) for x in extracted + more[1] + extracted[:2]], EXTRACTED + ", words int").repartition(3)
    got = boilerplate.boilerplate_lines(r, e)
    found = set(rows(got.where("boilerplate AND page_id < 900"), "page_id", "line_no"))
    assert len(found & truth) / len(truth) > 0.97 and len(found & truth) / len(found) > 0.97
    assert rows(got.where("page_id >= 900"), "page_id", "line_no", "boilerplate") == [(900, 0, True), (900, 2, False)]
    body = dict(rows(boilerplate.main_body(r, e), "page_id", "text"))
    assert body[900] == "some words of its own here\r" and "Tell a friend" not in body[1] and body[1].startswith("About ")
    assert boilerplate.boilerplate_lines(r.limit(0), e.limit(0)).count() == 0
    assert boilerplate.boilerplate_lines(r.limit(0), e).count() == got.count()


def test_tree_learns_its_table_and_holds_out():
    table = np.array(boilerplate.LABELLED, float)
    rng = np.random.default_rng(0)
    order = rng.permutation(len(table))
    parts = np.array_split(order, 5)
    right = 0
    for k in range(5):
        train = table[np.concatenate([p for n, p in enumerate(parts) if n != k])]
        tree = boilerplate.grow(train[:, :-1], train[:, -1])
        for row in table[parts[k]]:
            node = tree
            while isinstance(node, boilerplate.Split):
                node = node.low if row[node.feature] <= node.at else node.high
            right += (node.share >= 0.5) == bool(row[-1])
    assert right / len(table) > 0.93


def test_blocks_of_broken_markup():
    blocks, title, parent = boilerplate.text_blocks("<div><h1>T <b>x</b></h1><p>one<p>two <a href=q>link</a></div></div><li class=n><a>z</a> & &amp; <script>no</script><!-- no -->")
    assert [b.text for b in blocks] == ["T x", "one", "two link", "z & &"] and title == 0
    assert [b.parent == parent for b in blocks] == [True, True, True, False] and blocks[2].links == 0.5 and blocks[3].marked > 0
    assert boilerplate.text_blocks(None)[0] == [] == boilerplate.text_blocks("<")[0][1:]


def test_list_levels(spark):
    lines = ["1. Alpha. Beta.", "   a) Gamma", "   b) Delta. Epsilon", "2. (i) Zeta", "- Eta", "1.2. Theta is here.", "24.12. Iota", "Plain."]
    levels, depths, bodies = [], [], []
    for line in lines:
        at = sentences.item_body(line, 0, len(line) - len(line.lstrip()), len(line), levels)
        depths.append(len(levels))
        bodies.append(line[at:])
    assert depths == [1, 2, 2, 2, 2, 3, 3, 0]
    assert bodies == ["Alpha. Beta.", "Gamma", "Delta. Epsilon", "Zeta", "Eta", "Theta is here.", "Iota", "Plain."]
    text = "\n".join(lines)
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == ["1. Alpha.", "Beta.", "a) Gamma", "b) Delta.", "Epsilon", "2. (i) Zeta", "- Eta", "1.2. Theta is here.", "24.12. Iota", "Plain."]
    began = time.time()
    assert len(sentences.sentence_spans("(“" * 100_000 + " A. b" + ")" * 100_000)) == 1 and time.time() - began < 5


def test_many_blocks_of_items_in_one_scan(spark):
    rng = random.Random(8)
    items = [(n, " ".join(rng.choice(WORDS) for _ in range(30))) for n in range(40)]
    docs = [(n, " ".join([*(rng.choice(WORDS) for _ in range(50)), *(items[n % 40][1].split()[5 : 5 + rng.randrange(9, 16)] if n % 2 else []), *(rng.choice(WORDS) for _ in range(20))])) for n in range(120)]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), items_per_index=7)
    want = brute_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 10
    # a plan of one scan, whatever the number of blocks
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
