"""The registered queries of the llm operators: thin layers that apply them to whole tables and derive the digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, lm, packing, secrets, simhash, substring, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]
SEQUENCE_TOKENS, END_ID, LANG_FOLDS, LANG_HELD, TOXIC = 4096, 1, 4, 2, 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def fold(doc: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit(""))) % folds


def op1_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels.where(fold("doc_id", 3) != 1))
    found = toxicity.score(documents, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"), F.size("offending").alias("n_offending"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)), in_order=True)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 10) != 0)
    return found.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), SEQUENCE_TOKENS, END_ID)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), radius=3, shingle=3)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.RULES if r.base]
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(shown(of(*base)), 256).alias("base_sha256"), shown(F.col("secrets")).alias("spans"))


def language_model(documents: DataFrame) -> langid.LanguageModel:
    return langid.train(documents.select("doc_id", "text", "lang").where(fold("doc_id", LANG_FOLDS) != LANG_HELD))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.identify(documents.select("doc_id", "text"), language_model(documents))
    return found.select("doc_id", (fold("doc_id", LANG_FOLDS) == LANG_HELD).alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_toxicity_mil, op2_chat_format, op3_lm_scoring, op4_exact_top_k, op5_benchmark_decontamination, op6_best_fit_packing, op7_simhash_near_dedup, op8_substring_dedup, op9_secret_scan, op10_language_id, pipeline)
}
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: by kind: the pattern as the oracle's engine writes it, which of its groups is the span, and what must hold of the span
_SECRETS = (
    ("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 0, r"length(regexp_replace(v, '^[^:=]*[:=]\x20*[\x22\x27]?', '')) >= 12", "i"),
    ("access", "AKIA[A-Z0-9]+", 0, "length(v) >= 18", "c"),
    ("hex", "[0-9a-f]+", 0, "length(v) >= 16", "c"),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, "true", "c"),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, "true", "c"),
    ("chatbot", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, "true", "c"),
    ("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, "true", "c"),
)


def _rule_sql(kind: str, pattern: str, group: int, holds: str, case: str, order: int) -> str:
    """Common table expressions that walk over one rule's matches, each located after the end of the one before."""
    pattern, base = pattern.replace("'", "''"), kind in ("assign", "access", "hex")
    return f"""m{order} AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}', {group}, '{case}') AS ms FROM documents WHERE regexp_matches(text, '{pattern}', '{case}')),
        w{order}(doc_id, text, ms, k, s, e) AS (SELECT doc_id, text, ms, 1, strpos(text, ms[1]) - 1, strpos(text, ms[1]) - 1 + length(ms[1]) FROM m{order}
            UNION ALL SELECT doc_id, text, ms, k + 1, e + strpos(substr(text, e + 1), ms[k + 1]) - 1, e + strpos(substr(text, e + 1), ms[k + 1]) - 1 + length(ms[k + 1]) FROM w{order} WHERE k < len(ms)),
        r{order} AS (SELECT doc_id, {order} AS o, '{kind}' AS kind, {str(base).lower()} AS base, s, e FROM w{order} WHERE (SELECT {holds} FROM (SELECT ms[k] AS v)))"""


ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
             t AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
             x AS (SELECT *, length(text) + 9 + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 11 + length(role) END
                          + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
                          + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda r: length(r) - 2)), 0) AS chars,
                          CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE false END AS ok FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars, bool_and(ok) AS valid FROM x GROUP BY conv_id""",
    "op4_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_benchmark_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
             i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
             g AS (SELECT item, m, array_to_string(ws[p : p + m - 1], ' ') AS words FROM (SELECT item, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
             v AS (SELECT doc_id, m, p, array_to_string(ws[p : p + m - 1], ' ') AS words FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM g) WHERE len(ws) >= m)),
             h AS (SELECT DISTINCT v.doc_id, v.p, v.m, g.item FROM v JOIN g USING (m, words)),
             n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY doc_id),
             s AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op9_secret_scan": f"""
        WITH RECURSIVE {", ".join(_rule_sql(*r, k) for k, r in enumerate(_SECRETS))},
             f AS ({" UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(len(_SECRETS)))}),
             g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                          string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (base) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM f GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)""",
}
