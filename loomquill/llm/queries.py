"""The registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, mixing_lm, neardup, pieces, prefix_forest, quality, secrets, token_count
from .spark import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score_texts(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return prefix_forest.search(rows, rows.filter(F.col("vec_id") % 20 == 0))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_first")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, seq long, role string, text string")
    events = rows.unionByName(more).withColumns({"kind": F.lit("message"), "ref": F.lit(None).cast("long")})
    return chat.read_back(chat.format_chat(events))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the LM scores what SQL can say."""
    got = mixing_lm.score_texts(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = {c: F.coalesce(c, F.lit(-1)) for c in ("first_word", "last_word")}
    return op7_licenses(spark, sf_dir).withColumns(place).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a log with deltas, edits and regenerations, folded into final messages."""
    rows = table(spark, sf_dir, "conversations")
    seq, none = F.col("turn") * 10, F.lit(None).cast("long")
    event = lambda df, at, kind, text, ref: df.select("conv_id", at.cast("long").alias("seq"), F.lit(kind).alias("kind"), "role", text.alias("text"), ref.cast("long").alias("ref"))
    deltas = event(rows.filter("turn % 2 = 0"), seq + 1, "delta", F.lit(" more"), seq)
    edits = event(rows.filter("turn % 5 = 1"), seq + 1_000_000, "edit", F.concat(F.lit("edited "), "turn"), seq)
    again = event(rows.filter("conv_id % 3 = 0").dropDuplicates(["conv_id"]), F.lit(2_000_000), "regenerate", F.lit("again"), F.lit(20))
    log = event(rows, seq, "message", F.col("text"), none).unionByName(deltas).unionByName(edits).unionByName(again)
    return chat.fold_events(log).select("conv_id", (F.col("turn") / 10).cast("long").alias("turn"), "role", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_lm_scores": op2_lm_scores,
    "op3_neighbours": op3_neighbours,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_secrets": op5_secrets,
    "op6_pieces": op6_pieces,
    "op7_licenses": op7_licenses,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_chat": op10_chat,
    "lm_base": lm_base,
    "secret_counts": secret_counts,
    "license_phrases": license_phrases,
    "chat_events": chat_events,
}

#: crc32 of an id as text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ESCAPED = r"""replace(replace(replace(replace(replace(replace(replace({0}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>')"""

_WORDS = r"""list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
        win AS (SELECT DISTINCT item_id, w[s : s + 9] AS win FROM i, unnest(range(1, greatest(len(w) - 8, 2))) AS u(s) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT len(win) AS n FROM win),
        dw AS (SELECT r, s, n, w[s : s + n - 1] AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(s) WHERE len(w) >= n),
        hit AS (SELECT DISTINCT r, s, n, item_id FROM dw JOIN win USING (win)),
        spots AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + n)) AS u(p) GROUP BY r),
        ids AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM hit GROUP BY r)
        SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN spots USING (r) LEFT JOIN ids USING (r)""",
    "op10_chat": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<s>[INST] ' || {_ESCAPED.format("role")} || ' [/INST] ' || {_ESCAPED.format("text")} || '</s>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "lm_base": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} % 7 = 2 AS held, list_append(list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> ''), '') AS w FROM documents),
        t AS (SELECT r, held, unnest(w) AS x FROM d), c AS (SELECT x, count(*) AS c FROM t WHERE NOT held GROUP BY x), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT d.doc_id, d.held AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(max(n.n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / CAST(n.n + n.v + 1 AS DOUBLE))), 6) AS base_score
        FROM d JOIN t ON t.r = d.r LEFT JOIN c ON c.x = t.x CROSS JOIN n GROUP BY d.r, d.doc_id, d.held""",
    "secret_counts": r"""
        SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
               CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
               CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM documents""",
    "license_phrases": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        p AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS b,
                     list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS c FROM d),
        q AS (SELECT *, list_concat(a, list_concat(b, c)) AS every FROM p)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(coalesce(list_min(every), 0) - 1 AS BIGINT) AS first_word, CAST(coalesce(list_max(every), 0) - 1 AS BIGINT) AS last_word,
               concat_ws(',', CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END) AS base_labels FROM q""",
    "chat_events": """
        WITH t AS (SELECT *, conv_id % 3 = 0 AND max(turn = 2) OVER (PARTITION BY conv_id) AS again FROM conversations)
        SELECT conv_id, turn, coalesce(role, '') AS role,
               CASE WHEN again AND turn = 2 THEN 'again' WHEN turn % 5 = 1 THEN 'edited ' || turn ELSE coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' more' ELSE '' END END AS text
        FROM t WHERE NOT (again AND turn > 2)""",
}
