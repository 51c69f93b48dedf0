"""Thin queries over the operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import conversation_digests, format_turns

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("select cast(-7 as bigint) conv_id, t turn, r role, '</s>[INST] ok [/INST]' text from values (0L, 'user'), (1L, 'assistant') as v(t, r)")
    return conversation_digests(format_turns(rows.unionByName(own)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"), width=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_chat_format": op5_chat_format,
    "op6_decontamination": op6_decontamination,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL = {
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        v AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: {'i': i, 'g': md5(array_to_string(w[i:i + 12], ' '))})) AS v FROM w WHERE len(w) >= 13),
        f AS (SELECT v.g AS g, min(doc_id) AS lo FROM v GROUP BY 1),
        m AS (SELECT v.doc_id, list(v.v.i) AS hits FROM v JOIN f ON v.v.g = f.g AND f.lo < v.doc_id GROUP BY 1),
        r AS (SELECT doc_id, list_distinct(flatten(list_transform(hits, lambda i: range(i, i + 13)))) AS gone FROM m),
        k AS (SELECT w.doc_id, w.w, coalesce(r.gone, []) AS gone FROM w LEFT JOIN r USING (doc_id)),
        q AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM k) z
              WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS i FROM r) y WHERE y.doc_id = z.doc_id AND y.i = z.i)),
        t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM q GROUP BY 1)
        SELECT k.doc_id, CAST(len(k.w) AS BIGINT) AS n_words, CAST(len(k.gone) AS BIGINT) AS n_removed, sha256(coalesce(t.t, '')) AS kept_sha256
        FROM k LEFT JOIN t USING (doc_id)""",
    "op5_chat_format": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
        )
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(9 + length(role) + length(regexp_replace(role, '[^\[\]<\\]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\[<\\]', '', 'g'))) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
        w AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS g FROM d)
        SELECT doc_id, keep_id, g AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM w""",
    "op9_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id
              WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
              GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r(node, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.x = e.a),
        c AS (SELECT node, min(x) AS component_id FROM r GROUP BY node)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON s.doc_id = c.node""",
}
