"""The numbered queries: each operator over its whole table, in the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspark.llm import conversation_trie, decontaminate, extraction, knn, mixing, pii, sharding, simhash, token_counts, tokens, toxicity, warc, whitening
from clickspark.llm.storage import new_path, text_batches
from clickspark.plans.sql_rules import crc32_sql

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, least_bytes=0)
    read = warc.read_archives(spark, path, with_payload=False)
    page = lambda uri: F.col(uri).substr(10, 20).try_cast("long")  # noqa: E731  after "urn:page:"
    return read.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.when(F.col("problem").isNotNull(), F.raise_error("problem")).otherwise(F.col("record_type")).alias("record_type"),
        page("refers_to").alias("refers_to"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_text(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched_words", "item_words")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.spelled("base"), 256).alias("base_sha256"), pii.spelled("spans").alias("spans"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = conversation_trie.turn_paths(table(spark, sf_dir, "conversations"))
    return conversation_trie.trie_nodes(conversation_trie.forked_paths(paths, family=5, most=8))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_main_text": op2_main_text,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_token_files": op7_token_files,
    "op8_shards": op8_shards,
    "op9_pii": op9_pii,
    "op10_top_k": op10_top_k,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_counts": op13_token_counts,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
        firsts AS (SELECT hex, max(page_id) AS first_id FROM hashed GROUP BY hex),
        twenty AS (SELECT hex, first_id, [CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) for i in range(8)] AS parts FROM firsts)
        SELECT page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((parts[CAST(j // 4 + 1 AS BIGINT)] >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1) for j in range(32)], '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM hashed JOIN twenty USING (hex)""",
    # every alignment that shares enough words, without seeds
    "op4_decontamination": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS h FROM documents),
        items AS (SELECT item_id, t, CASE WHEN len(t) < 7 THEN len(t) ELSE least(13, len(t)) END AS wide, CASE WHEN len(t) < 7 THEN 5 ELSE 4 END AS fifths
            FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark WHERE item_id IS NOT NULL) WHERE len(t) > 0),
        doc_words AS (SELECT doc_id, unnest(h) AS word, unnest(range(len(h))) AS at FROM docs),
        item_words AS (SELECT item_id, wide, fifths, unnest(t) AS word, unnest(range(len(t))) AS at FROM items),
        alignments AS (SELECT doc_id, item_id, d.at - b.at AS shift FROM doc_words d JOIN item_words b USING (word)
            GROUP BY doc_id, item_id, shift, wide, fifths HAVING 5 * count(*) >= fifths * wide),
        aligned AS (SELECT doc_id, item_id, len(t) AS n, wide, fifths,
            [CASE WHEN h[CAST(j + shift + 1 AS BIGINT)] = t[CAST(j + 1 AS BIGINT)] THEN 1 ELSE 0 END
             for j in range(greatest(0, -shift), least(len(t), len(h) - shift))] AS agree
            FROM alignments JOIN docs USING (doc_id) JOIN items USING (item_id))
        SELECT doc_id, item_id, CAST(max(list_sum(agree)) AS INTEGER) AS matched_words, CAST(max(n) AS INTEGER) AS item_words
        FROM aligned WHERE len(agree) >= wide
            AND list_max([5 * list_sum(list_slice(agree, CAST(k + 1 AS BIGINT), CAST(k + wide AS BIGINT))) for k in range(len(agree) - wide + 1)]) >= fifths * wide
        GROUP BY doc_id, item_id""",
    "op10_top_k": """
        WITH vectors AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS place, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
        scored AS (
            SELECT q.place, q.vec_id AS query_id, d.vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.v, d.v)]) AS BIGINT) AS score
            FROM vectors q JOIN vectors d ON q.vec_id % 50 = 0 AND d.place <> q.place AND len(d.v) = len(q.v))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) <= 5""",
    "op12_prefix_trie": f"""
        WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
            coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
        rebuilt AS (SELECT c.conv_id, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place < c.h
            UNION ALL SELECT conv_id, place, role, text FROM convs JOIN turns USING (conv_id) WHERE place >= h),
        numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth,
            sha256(length(role) || ':' || role || text) AS id, octet_length(encode(text)) AS bytes FROM rebuilt),
        prefixes AS (SELECT conv_id, depth, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, bytes FROM numbered
            UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
        nodes AS (SELECT depth, path, substr(path, 1, 64 * (depth - 1)) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM prefixes GROUP BY depth, path),
        kids AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
        below AS (SELECT substr(path, 1, 64 * k) AS path, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS leaves
            FROM (SELECT nodes.*, n_children, unnest(range(depth + 1)) AS k FROM nodes LEFT JOIN kids USING (path)) GROUP BY 1),
        ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
            FROM (SELECT conv_id, max_by(path, depth) AS path FROM prefixes GROUP BY conv_id) GROUP BY path)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
            CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.above LEFT JOIN kids k ON k.path = n.path JOIN below b ON b.path = n.path LEFT JOIN ends e ON e.path = n.path""",
}
