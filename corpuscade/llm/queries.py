"""Queries of the training-text operators by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, leakage, leximin, neardup, packing, repeated_lines, sentences, similar

SCORES = ("dense_score", "sparse_score", "rerank_score")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks of which one is among the other's five most similar."""
    found = similar.SimilarVectors(table(spark, d, "chunks"), "chunk_no", "embedding", 128).neighbours()
    return found.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar chunks of every chunk, in order."""
    found = similar.SimilarVectors(table(spark, d, "chunks"), "chunk_no", "embedding", 128).neighbours()
    return found.select(F.col("id").alias("chunk_no"), F.col("neighbour").alias("similar_no"), F.round("cos", 4).alias("cosine"), "place")


def _near_duplicates(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(table(spark, d, "extracted_pages"), "page_id", "text", size=3, threshold=0.6)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of pages whose three-word sequences agree to 0.6 or more."""
    return _near_duplicates(spark, d).pairs().select(F.col("doc_a").alias("page_a"), F.col("doc_b").alias("page_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per page: class of equal texts, its size, links to other classes, and group.

    Pages of one content hash belong together too: each is linked to the first page of its hash.
    """
    found = _near_duplicates(spark, d)
    hashed = table(spark, d, "extracted_pages").where("content_hash IS NOT NULL").select(F.lower("content_hash").alias("h"), F.col("page_id").alias("b")).distinct()
    first = hashed.groupBy("h").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").select("h", "a")
    same = hashed.join(first, "h").where("a <> b").select("a", "b")
    return found.groups(same, every=True).withColumnRenamed("doc", "page_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The three leading chunks of each query."""
    return leximin.leximin_top(table(spark, d, "search_results"), "query_id", "chunk_id", SCORES, 3).select("query_id", "chunk_id")


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The whole ranking of each query's chunks."""
    return leximin.leximin_ranking(table(spark, d, "search_results"), "query_id", "chunk_id", SCORES)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines that aren't main body."""
    return boilerplate.boilerplate_lines(table(spark, d, "raw_pages"), table(spark, d, "extracted_pages")).where("boilerplate").select("page_id", "line_no")


def p4_body(spark: SparkSession, d: str) -> DataFrame:
    """The main body of every page."""
    return boilerplate.main_body(table(spark, d, "raw_pages"), table(spark, d, "extracted_pages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all blocks that stand on ten or more pages of their host."""
    return repeated_lines.repeated_lines(table(spark, d, "extracted_pages"), 10).select(F.col("doc").alias("page_id"), "line_no")


def p6_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each repeated line with the longest repeated block that starts there."""
    documents = repeated_lines.site_documents(table(spark, d, "extracted_pages"))
    return repeated_lines.repeated_blocks(documents, 10).select(F.col("doc").alias("page_id"), "site", "line_no", "block_lines", "docs")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every page without its host's repeated lines."""
    return repeated_lines.without_repeated_lines(table(spark, d, "extracted_pages"), 10)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every text of documents in containers of each capacity."""
    windows = [(r["window_id"], r["capacity_tokens"]) for r in table(spark, d, "context_windows").where("capacity_tokens > 0").distinct().collect()]  # a fixed table of three rows
    return packing.pack(packing.sized(table(spark, d, "documents")), windows).withColumnRenamed("doc", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document that holds twelve successive words of an item."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_extent(spark: SparkSession, d: str) -> DataFrame:
    """The same with the longest run of shared words."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every text."""
    return sentences.sentences(table(spark, d, "documents"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p4_found": p4_found, "p4_body": p4_body, "p8_packed": p8_packed, "p9_found": p9_found, "p9_extent": p9_extent, "p10_found": p10_found, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_ranking": p3_ranking, "p6_found": p6_found, "p6_blocks": p6_blocks, "p6_cleaned": p6_cleaned}


_SITE_LINES = r"""
    parts AS (SELECT DISTINCT page_id, text,
      regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^.*@', ''), ':\d*$', ''), '^www\.', '') AS site
      FROM extracted_pages WHERE text IS NOT NULL),
    lines AS (SELECT page_id, site, unnest(range(len(l)))::INT AS line_no, unnest(l) AS line
      FROM (SELECT page_id, site, string_split(text, chr(10)) AS l FROM parts)),
    keyed AS (SELECT page_id, site, line_no,
      regexp_replace(replace(lower(line), 'ß', 'ss'), '[\s\pZ\x{0B}\x{1c}-\x{1f}\x{85}\p{Nd}]+', '', 'g') AS k FROM lines),
    often AS (SELECT site, k FROM keyed WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT page_id) >= 10)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            WITH u AS (SELECT DISTINCT chunk_no AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM chunks
              WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.id <> b.id),
            k AS (SELECT a, b FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) <= 5)
            SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM k""",
        "p9_found": r"""
            WITH words AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\pL\pN]+') AS w FROM documents WHERE text IS NOT NULL),
            grams AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) AS g FROM words),
            iwords AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\pL\pN]+') AS w FROM eval_items),
            igrams AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) AS g FROM iwords)
            SELECT DISTINCT doc_id, item_id FROM grams JOIN igrams USING (g)""",
        "p9_extent": r"""
            WITH words AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\pL\pN]+') AS w FROM documents WHERE text IS NOT NULL),
            iwords AS (SELECT DISTINCT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\pL\pN]+') AS w FROM eval_items),
            grams AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) AS g FROM words),
            igrams AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) AS g FROM iwords),
            hits AS (SELECT DISTINCT doc_id, item_id FROM grams JOIN igrams USING (g)),
            d AS (SELECT doc_id, item_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM hits JOIN words USING (doc_id)),
            t AS (SELECT DISTINCT item_id, unnest(w) AS word, unnest(range(len(w))) AS j FROM iwords WHERE item_id IN (SELECT item_id FROM hits)),
            m AS (SELECT doc_id, item_id, i, i - j AS diagonal FROM d JOIN t USING (item_id, word)),
            r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS run FROM m),
            c AS (SELECT doc_id, item_id, count(*) AS n FROM r GROUP BY doc_id, item_id, diagonal, run)
            SELECT doc_id, item_id, max(n)::INT AS words FROM c GROUP BY doc_id, item_id HAVING max(n) >= 12""",
        "p3_found": """
            WITH one AS (SELECT query_id, chunk_id,
                max(CASE WHEN isnan(dense_score) THEN NULL ELSE dense_score END) AS a,
                max(CASE WHEN isnan(sparse_score) THEN NULL ELSE sparse_score END) AS b,
                max(CASE WHEN isnan(rerank_score) THEN NULL ELSE rerank_score END) AS c
              FROM search_results GROUP BY query_id, chunk_id),
            mid AS (SELECT query_id, chunk_id,
                CASE WHEN a IS NULL THEN 0 ELSE rank() OVER (PARTITION BY query_id ORDER BY a NULLS LAST) - 1 + count(a) OVER (PARTITION BY query_id, a) / 2.0 END AS x,
                CASE WHEN b IS NULL THEN 0 ELSE rank() OVER (PARTITION BY query_id ORDER BY b NULLS LAST) - 1 + count(b) OVER (PARTITION BY query_id, b) / 2.0 END AS y,
                CASE WHEN c IS NULL THEN 0 ELSE rank() OVER (PARTITION BY query_id ORDER BY c NULLS LAST) - 1 + count(c) OVER (PARTITION BY query_id, c) / 2.0 END AS z
              FROM one),
            sorted AS (SELECT query_id, chunk_id, list_sort([x, y, z]) AS v FROM mid)
            SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v[1] DESC, v[2] DESC, v[3] DESC, chunk_id) AS n FROM sorted) WHERE n <= 3""",
        "p3_ranking": """
            WITH one AS (SELECT query_id, chunk_id,
                max(CASE WHEN isnan(dense_score) THEN NULL ELSE dense_score END) AS a,
                max(CASE WHEN isnan(sparse_score) THEN NULL ELSE sparse_score END) AS b,
                max(CASE WHEN isnan(rerank_score) THEN NULL ELSE rerank_score END) AS c
              FROM search_results GROUP BY query_id, chunk_id),
            mid AS (SELECT query_id, chunk_id,
                CASE WHEN a IS NULL THEN 0 ELSE rank() OVER (PARTITION BY query_id ORDER BY a NULLS LAST) - 1 + count(a) OVER (PARTITION BY query_id, a) / 2.0 END AS x,
                CASE WHEN b IS NULL THEN 0 ELSE rank() OVER (PARTITION BY query_id ORDER BY b NULLS LAST) - 1 + count(b) OVER (PARTITION BY query_id, b) / 2.0 END AS y,
                CASE WHEN c IS NULL THEN 0 ELSE rank() OVER (PARTITION BY query_id ORDER BY c NULLS LAST) - 1 + count(c) OVER (PARTITION BY query_id, c) / 2.0 END AS z
              FROM one),
            sorted AS (SELECT query_id, chunk_id, list_sort([x, y, z]) AS v FROM mid)
            SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY v[1] DESC, v[2] DESC, v[3] DESC, chunk_id) AS place FROM sorted""",
        "p6_found": f"WITH {_SITE_LINES} SELECT DISTINCT page_id, line_no FROM keyed JOIN often USING (site, k)",
        "p6_blocks": f"""
            WITH {_SITE_LINES},
            seqs AS (SELECT page_id, site, list(k ORDER BY line_no) AS ks, list(line_no ORDER BY line_no) AS ns FROM keyed WHERE k <> '' GROUP BY page_id, site),
            starts AS (SELECT page_id, site, ks, ns, unnest(range(1, len(ks) + 1)) AS i FROM seqs),
            blocks AS (SELECT page_id, site, ns[i] AS line_no, len(b) AS block_lines, array_to_string(b, chr(1)) AS b
              FROM (SELECT page_id, site, ns, i, unnest(list_transform(range(i, len(ks) + 1), lambda j: list_slice(ks, i, j))) AS b FROM starts)),
            spans AS (SELECT site, b, count(DISTINCT page_id) AS docs FROM blocks GROUP BY site, b HAVING count(DISTINCT page_id) >= 10)
            SELECT page_id, site, line_no, max(block_lines) AS block_lines, arg_max(docs, block_lines) AS docs FROM blocks JOIN spans USING (site, b) GROUP BY page_id, site, line_no""",
        "p6_cleaned": f"""
            WITH {_SITE_LINES},
            gone AS (SELECT DISTINCT page_id, line_no FROM keyed JOIN often USING (site, k)),
            kept AS (SELECT l.page_id, string_agg(line, chr(10) ORDER BY l.line_no) AS text
              FROM lines l LEFT JOIN gone g ON g.page_id = l.page_id AND g.line_no = l.line_no WHERE g.page_id IS NULL GROUP BY l.page_id)
            SELECT p.page_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
            FROM (SELECT DISTINCT page_id, text FROM extracted_pages) p LEFT JOIN kept k ON k.page_id = p.page_id""",
        "p2_groups": r"""
            WITH RECURSIVE words AS (SELECT DISTINCT page_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') AS w FROM extracted_pages),
            sets AS (SELECT page_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g, w FROM words),
            named AS (SELECT page_id, g, CASE WHEN len(w) >= 3 THEN 's' || array_to_string(list_sort(g), '|') WHEN len(w) > 0 THEN 'w' || array_to_string(w, ' ') ELSE 'n' || page_id END AS s FROM sets),
            classes AS (SELECT page_id, g, min(page_id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS members FROM named),
            grams AS (SELECT page_id, len(g) AS n, unnest(g) AS g FROM classes WHERE page_id = class_id),
            common AS (SELECT a.page_id AS a, b.page_id AS b, a.n AS x, b.n AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.page_id < b.page_id GROUP BY ALL),
            linked AS (SELECT a, b FROM common WHERE c >= 0.6 * (x + y - c)),
            degree AS (SELECT node, count(*) AS links FROM (SELECT a AS node FROM linked UNION ALL SELECT b FROM linked) GROUP BY node),
            hashed AS (SELECT DISTINCT lower(content_hash) AS h, page_id FROM extracted_pages WHERE content_hash IS NOT NULL),
            edges AS (SELECT a AS u, b AS v FROM linked UNION SELECT x.class_id, y.class_id FROM hashed p JOIN hashed q ON p.h = q.h JOIN classes x ON x.page_id = p.page_id JOIN classes y ON y.page_id = q.page_id),
            ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
            reach AS (SELECT DISTINCT class_id AS node, class_id AS root FROM classes UNION SELECT w.v, r.root FROM reach r JOIN ways w ON w.u = r.node WHERE r.root < w.v)
            SELECT c.page_id, c.class_id, any_value(c.members) AS members, coalesce(any_value(d.links), 0) AS links, min(r.root) AS group_id
            FROM classes c LEFT JOIN degree d ON d.node = c.class_id JOIN reach r ON r.node = c.class_id GROUP BY c.page_id, c.class_id""",
        "p2_found": r"""
            WITH words AS (SELECT DISTINCT page_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM extracted_pages WHERE text IS NOT NULL),
            grams AS (SELECT DISTINCT page_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM words),
            sizes AS (SELECT page_id, count(*) AS n FROM grams GROUP BY page_id),
            common AS (SELECT a.page_id AS page_a, b.page_id AS page_b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.page_id < b.page_id GROUP BY ALL)
            SELECT page_a, page_b FROM common JOIN sizes x ON x.page_id = page_a JOIN sizes y ON y.page_id = page_b WHERE c >= 0.6 * (x.n + y.n - c)""",
    }
