"""The queries of this subpackage over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm.common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


SHARDS = [f"shard-{i:04d}" for i in range(1000)]


def op1_simhash(spark, sf_dir):
    from tessera.llm import simhash

    return simhash.components_of(table(spark, sf_dir, "documents"), words=3, max_bits=2)


def op2_sharding(spark, sf_dir):
    from tessera.llm import sharding

    return sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op3_embedding_dedup(spark, sf_dir):
    from tessera.llm import embeddings

    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_bpe(spark, sf_dir):
    from tessera.llm import tokens

    return tokens.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op5_token_blocks(spark, sf_dir):
    from tessera.llm import rans

    return rans.write_and_read(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op6_suffix_dedup(spark, sf_dir):
    from tessera.llm import suffixes

    return suffixes.report(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    from tessera.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=4096, end_id=1)


def op8_language_id(spark, sf_dir):
    from tessera.llm import language

    return language.identify(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark, sf_dir):
    from tessera.llm import exact

    return exact.dedup(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark, sf_dir):
    from tessera.llm import chat

    raw = chat.transcripts(table(spark, sf_dir, "conversations"))
    return chat.parse(raw.drop("role"), chat.fit(raw))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_sharding, op3_embedding_dedup, op4_bpe, op5_token_blocks, op6_suffix_dedup, op7_packing, op8_language_id, op9_exact_dedup, op10_chat_formatting)}



def _slots_sql() -> str:
    """Documents with their shard, by a table of slots that is one string of four digits a slot."""
    from tessera.llm import sharding

    table = "".join(f"{i:04d}" for i in sharding.fill(SHARDS))
    slot = f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.SLOTS}"
    return f"SELECT *, 'shard-' || substr('{table}', CAST(4 * ({slot}) + 1 AS BIGINT), 4) AS shard FROM documents"


ORACLE_SQL = {
    "op2_sharding": _slots_sql(),
    "op3_embedding_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                                THEN CAST(embedding AS DOUBLE[]) END AS v
            FROM embeddings
        ), sized AS (
            SELECT vec_id, v, CASE WHEN v IS NOT NULL THEN sqrt(list_inner_product(v, v)) END AS size FROM vectors
        ), usable AS (
            SELECT vec_id, v, size FROM sized WHERE size > 0
        ), pairs AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v)
            WHERE CASE WHEN len(a.v) = len(b.v) THEN list_inner_product(a.v, b.v) END >= 0.9 * a.size * b.size
        ), links AS (
            SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
        ), reached AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        ), counts AS (
            SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
        ), tops AS (
            SELECT a AS vec_id, least(a, min(b)) AS component_id FROM reached GROUP BY a
        )
        SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
               coalesce(component_id, vec_id) = vec_id AS kept
        FROM vectors LEFT JOIN counts USING (vec_id) LEFT JOIN tops USING (vec_id)""",
    "op6_suffix_dedup": """
        WITH docs AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, octet_length(encode(coalesce(text, ''))) AS n_bytes
            FROM documents
        ), strings AS (
            SELECT doc_id, pos, substr(digits, 2 * pos + 1, 200) AS string
            FROM docs, unnest(range(greatest(n_bytes - 99, 0))) AS u (pos)
        ), repeats AS (
            SELECT doc_id, pos FROM strings
            QUALIFY row_number() OVER (PARTITION BY string ORDER BY doc_id, pos) > 1
        ), begun AS (
            SELECT doc_id, pos, coalesce(pos > lag(pos) OVER w + 100, TRUE) AS fresh
            FROM repeats WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
        ), numbered AS (
            SELECT doc_id, pos, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM begun
        ), runs AS (
            SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b FROM numbered GROUP BY doc_id, run
        ), removed AS (
            SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
        ), starts AS (
            SELECT doc_id, 0 AS a FROM docs UNION ALL SELECT doc_id, b FROM runs
        ), pieces AS (
            SELECT s.doc_id, s.a, min(r.a) AS b
            FROM starts s LEFT JOIN runs r ON r.doc_id = s.doc_id AND r.a >= s.a GROUP BY s.doc_id, s.a
        ), kept AS (
            SELECT doc_id, sha256(unhex(string_agg(substr(digits, 2 * a + 1, 2 * (coalesce(b, n_bytes) - a)), '' ORDER BY a))) AS kept_sha256
            FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               coalesce(n_spans, 0) AS n_spans, kept_sha256
        FROM docs JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
