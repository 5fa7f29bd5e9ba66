"""The registered queries of this package: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as dedup
from . import fill_in_middle as middle
from . import importance, language, near_dedup, packing, permutation_index, piece_lattice, quality, secrets, sharding, warc_zip, window_cuts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def op1_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return piece_lattice.encode_nbest(docs, public_tokenizers.path("piece_bpe_32k.model"), n=4, digest=True)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_zip.read_archives(warc_zip.write_archives(_read(spark, sf_dir, "pages")))
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op3_fast_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85, bands=26)


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = permutation_index.build_index(_read(spark, sf_dir, "embeddings"))
    return permutation_index.search(index, index.rows.filter("vec_id % 100 = 0"), k=10)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.default_model(docs))
    base = F.filter("secrets", lambda s: s["ord"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        *(secrets.count_of(F.col("secrets"), k).alias(f"n_{k}") for k, _, _, _ in secrets.BASE),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
    )


def op6_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _held_out(4, 2)
    model = language.train(language.training_sample(docs, ~held_out))
    found = language.identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard_records(_read(spark, sf_dir, "documents"), n_shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(_read(spark, sf_dir, "documents"), hash_all=True)


def op10_quality_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _held_out(5, 0)
    scored = quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), percent=25, order=2, buckets=10_000, least_words=20, seed=7)
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle.fill_in_middle(_read(spark, sf_dir, "documents"), rate=50, spm=80, seed=42)
    back = middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_window_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_cuts.pack_windows(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_piece_nbest, op2_warc_zip, op3_fast_sketch_near_dedup, op4_permutation_index, op5_secret_scan, op6_bin_slack_packing, op7_language_id, op8_virtual_slot_sharding, op9_exact_dedup, op10_quality_fourier, op11_importance_resampling, op12_fill_in_middle, op13_window_cuts)
}

ORACLE: dict[str, str] = {
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
        u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
            list_transform([0, 1, 2, 3], lambda k: list_reduce(list_transform(string_split(substr(digest, 8 * k + 1, 8), ''), lambda c: instr('0123456789abcdef', c)::BIGINT - 1), lambda a, b: 16 * a + b)) AS h FROM d),
        r AS (SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
        c AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM r)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM c
    """,
    "op2_warc_zip": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
    """,
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g USING (norm)
    """,
}
