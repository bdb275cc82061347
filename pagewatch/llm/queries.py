"""The operators' queries, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm import byte_bpe, chat, collocations, learned_partitions, licenses, packing, periodic_runs, quality, simhash, substring, token_counts, vectors, wrappers

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_main_text(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embedding_groups(table(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(control).alias("text")) for k, role in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    return chat.conversation_digests(chat.format_conversations(turns.union(own), window=chat.CHATML_WINDOW))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.document_lengths(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return token_counts.length_histogram(lengths)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return learned_partitions.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"), plant=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_best_fit_packing, op3_license_scan, op4_html_extraction, op5_substring_dedup, op6_embedding_dedup, op7_chat_format, op8_token_counts, op9_byte_bpe, op10_simhash, op11_collocations, op12_nearest_neighbours, op13_periodic_runs)
    return {f.__name__: f for f in own}


#: The queries that SQL can say as well. Tokenizers, hashes of other libraries, fitted weights and markup it can't.
SQL = {
    "op5_substring_dedup": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT r, i, array_to_string(ws[i : i + 34], ' ') AS k FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 33)) AS i)),
        g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
        x AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
        s AS (SELECT r, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY x.j) FILTER (g.j IS NULL) AS kept FROM x LEFT JOIN g USING (r, j) GROUP BY r)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)""",
    "op6_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95), reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op11_collocations": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p), n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
        g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k), LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i)),
        f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS ws FROM g GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT lang, k, phrase, a, cut, array_to_string(ws[1 : cut], ' ') AS lp, array_to_string(ws[cut + 1 : k], ' ') AS rp FROM f, LATERAL (SELECT unnest(range(1, k)) AS cut) WHERE k > 1),
        s AS (SELECT c.lang, c.k, c.phrase, c.a, l.a AS l, r.a AS r, cut, ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = lp JOIN f r ON r.lang = c.lang AND r.phrase = rp),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        x AS (SELECT lang, a AS longer, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM f, (SELECT unnest([2, 3]) AS m), LATERAL (SELECT unnest(range(1, k - m + 2)) AS i) WHERE m < k),
        y AS (SELECT lang, phrase, max(longer) AS longer FROM x GROUP BY 1, 2), o AS (SELECT b.* FROM b LEFT JOIN y USING (lang, phrase) WHERE NOT coalesce(100 * longer >= 80 * a, false))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op12_nearest_neighbours": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op7_chat_format": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
        e AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_start|><|im_end|>') + 2 AS n FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars, false AS rewrites FROM e GROUP BY conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
