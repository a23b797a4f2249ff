"""The registered queries of this package, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm._util import read, small_batches


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.langid import held_out, identify, train

    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.where(~out))
    return identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"), shards=40)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.wrapper import extract

    return extract(read(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.decontaminate import mark

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return mark(docs, read(spark, sf_dir, "benchmark"), words=10).drop("text")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.suffixes import remove_repeats

    out = remove_repeats(read(spark, sf_dir, "documents"), span=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), words=3, radius=2)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.langid import held_out
    from quillmill.llm.quality import score_texts, train

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 5, 0)
    model = train(docs, labels.where(~out))
    return score_texts(docs.select("doc_id", "text"), model, threshold=0.3).select("doc_id", out.alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.mixing import mix

    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, block_rows=32, period=256).drop("text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillmill.llm.tokens import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.neighbours import nearest

    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, tables=16, recall=0.95)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.editprints import against_next

    out = against_next(read(spark, sf_dir, "documents"))
    words = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", "n_chars", words("edited").alias("edited_sha256"), words("print").alias("fingerprint"), words("edited_print").alias("edited_fingerprint"), "near_edited", "near_next")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.runs import collapse_runs, with_tails

    out = collapse_runs(with_tails(read(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    runs = F.array_sort(F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return out.select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillmill.llm.alignment import align

    small_batches(spark)
    out = align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sharding": op2_sharding,
    "op3_main_text": op3_main_text,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_neighbours": op10_neighbours,
    "op11_fingerprints": op11_fingerprints,
    "op12_runs": op12_runs,
    "op13_alignment": op13_alignment,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        sized AS (SELECT item, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
        item_windows AS (
            SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS words
            FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM sized)),
        doc_windows AS (
            SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS words
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
                  FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
        found AS (SELECT doc_id, item, n, s FROM doc_windows JOIN item_windows USING (n, words)),
        hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM found) GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
}
