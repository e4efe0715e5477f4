"""One query per operator, over its whole table, and the SQL that must agree where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.alignment import alignment
from tablewright.llm.archives import archive_pages
from tablewright.llm.cosines import near_vectors
from tablewright.llm.mixing import mix_plan
from tablewright.llm.multiset import edit_likeness
from tablewright.llm.packing import pack
from tablewright.llm.passages import kept_words
from tablewright.llm.quality import quality_scores
from tablewright.llm.ranking import ranked
from tablewright.llm.search import nearest_embeddings
from tablewright.llm.sharding import byte_shards
from tablewright.llm.simhash import near_groups
from tablewright.llm.toxicity import toxicity_scores

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_passages(spark: SparkSession, folder: str) -> DataFrame:
    kept = kept_words(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op2_search(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_embeddings(_table(spark, folder, "embeddings"))


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edit_likeness(_table(spark, folder, "documents"))


def op4_archives(spark: SparkSession, folder: str) -> DataFrame:
    return archive_pages(_table(spark, folder, "pages"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_groups(_table(spark, folder, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_plan(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = byte_shards(_table(spark, folder, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_cosines(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


def op12_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


_ALL = (
    op1_passages, op2_search, op3_fingerprints, op4_archives, op5_quality, op6_toxicity, op7_packing, op8_simhash,
    op9_mixing, op10_sharding, op11_cosines, op12_ranking, op13_alignment,
)
QUERIES = {f.__name__: f for f in _ALL}

#: Words of the text, as everywhere in this package.
_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

ORACLES = {
    "op1_passages": r"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        windows AS (
            SELECT doc_id, first, md5(array_to_string(ws[first : first + 49], ' ')) AS same
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS first FROM split WHERE len(ws) >= 50)),
        lowest AS (SELECT same, min(doc_id) AS low FROM windows GROUP BY same),
        repeated AS (SELECT w.doc_id, w.first FROM windows w JOIN lowest l USING (same) WHERE w.doc_id > l.low),
        gone AS (
            SELECT doc_id, list(DISTINCT place) AS places
            FROM (SELECT doc_id, unnest(range(first, first + 50)) AS place FROM repeated) GROUP BY doc_id),
        marked AS (SELECT s.doc_id, s.ws, coalesce(g.places, []) AS places FROM split s LEFT JOIN gone g USING (doc_id)),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM marked),
        left_over AS (
            SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.place) AS kept FROM words w
            ANTI JOIN (SELECT doc_id, unnest(places) AS place FROM gone) g ON g.doc_id = w.doc_id AND g.place = w.place
            GROUP BY w.doc_id)
        SELECT m.doc_id, len(m.ws)::BIGINT AS n_words, len(m.places)::BIGINT AS n_removed,
               sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM marked m LEFT JOIN left_over k USING (doc_id)""",
    "op2_search": """
        WITH scaled AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM scaled q JOIN scaled c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5""",
    "op4_archives": """
        WITH hashed AS (
            SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest FROM pages),
        grouped AS (
            SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest,
                   CASE WHEN strlen(body) >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS first
            FROM hashed)
        SELECT page_id, payload_bytes, digest AS payload_digest,
               CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
        FROM grouped""",
    "op9_mixing": rf"""
        WITH sized AS (
            SELECT doc_id, source, text, {_SIZE} AS size,
                   length(text) - length(translate(text, '#$%&*|<>{{}}[]_=+~^@!', '')) AS symbols,
                   ('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT AS draw
            FROM documents),
        keyed AS (
            SELECT *, -ln((draw + 1) / 4503599627370497.0::DOUBLE)
                      / CASE WHEN size > 0 THEN size::DOUBLE / (size + symbols) ELSE 1 END AS key
            FROM sized),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM sized GROUP BY source),
        filled AS (
            SELECT *,
                   (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
                    - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0)::DOUBLE)
                   / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
            FROM sources
            WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        targets AS (
            SELECT source, source_size,
                   CASE WHEN 2.0 * source_size <= level * weight THEN 2.0::DOUBLE * source_size
                        ELSE (SELECT max(level) FROM filled WHERE NOT 2.0 * source_size <= level * weight) * weight
                   END::DOUBLE AS target
            FROM filled),
        placed AS (
            SELECT k.doc_id, k.size, t.source_size, t.target,
                   CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
                   sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id) - k.size AS before
            FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
        FROM placed""",
    "op11_cosines": """
        WITH RECURSIVE good AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id
            WHERE CASE WHEN len(x.v) = len(y.v) THEN list_cosine_similarity(x.v, y.v) >= 0.93 ELSE false END),
        reach AS (
            SELECT vec_id AS a, vec_id AS r FROM embeddings
            UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.r = links.a),
        lowest AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a),
        counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN lowest ON lowest.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id""",
    "op12_ranking": r"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        queries AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
        totals AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM split WHERE len(ts) > 0),
        sized AS (SELECT doc_id, ts, 75 + (25 * len(ts) * n_docs) // n_terms AS m FROM split, totals WHERE len(ts) > 0),
        postings AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(ts) AS term FROM sized) GROUP BY ALL),
        weights AS (
            SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM postings, totals GROUP BY term),
        scored AS (
            SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM queries JOIN postings USING (term) JOIN weights USING (term) GROUP BY item_id, doc_id)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 20""",
}
