"""The operators' queries, each over its whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprints, langid, pseudolm, simhash, suffixdedup, tokenfile, toxicity, warc
from .common import crc_mod, read_table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudolm.score(docs, pseudolm.fit(docs), keep_text=False)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.summarize(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    learn = crc_mod(F.col("doc_id"), 5) != 0
    model = toxicity.fit(docs.where(learn), labels.where(learn))
    return toxicity.score(docs, model).select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select(F.col("doc").alias("doc_id"), "n_items", F.col("item").alias("item_id"), F.col("matched").cast("bigint").alias("matched"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(read_table(spark, sf_dir, "pages")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_tokens(tokenfile.write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path()))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pseudo_likelihood": op1,
        "op2_language_id": op2,
        "op3_suffix_dedup": op3,
        "op4_toxicity": op4,
        "op5_simhash": op5,
        "op6_decontamination": op6,
        "op7_warc": op7,
        "op8_bpe": op8,
        "op9_token_files": op9,
        "op10_edit_fingerprints": op10,
    }


#: Every alignment of a document with an item, without seeds: they are lossless for items of 15 words and more.
_OP6 = r"""
WITH d AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p
           FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents)),
     i AS (SELECT item_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS p
           FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark)),
     m AS (SELECT doc_id, item_id, d.p - i.p AS shift, least(15, any_value(n)) AS width, any_value(n) AS n, list(i.p) AS ps
           FROM d JOIN i USING (w) GROUP BY ALL HAVING count(*) >= 0.8 * least(15, any_value(n))),
     b AS (SELECT doc_id, item_id, width,
                  list_max(list_transform(range(0, n - width + 1), lambda s: len(list_filter(ps, lambda x: x >= s AND x < s + width)))) AS matched
           FROM m)
SELECT doc_id, count(DISTINCT item_id) AS n_items, min(item_id) AS item_id, max(matched) AS matched
FROM b WHERE matched >= ceil(0.8 * width) GROUP BY doc_id
"""

#: Every string of 100 bytes of every document; all but its first place repeat.
_OP3 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
     s AS (SELECT doc_id, pos, array_slice(b, pos + 1, pos + 100) AS w FROM (SELECT doc_id, b, unnest(range(0, greatest(octet_length(b) - 99, 0))) AS pos FROM d)),
     r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM s) WHERE k > 1),
     i AS (SELECT doc_id, pos, sum(CASE WHEN pos <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run
           FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM r)),
     g AS (SELECT doc_id, min(pos) AS start, max(pos) + 100 AS stop FROM i GROUP BY doc_id, run),
     k AS (SELECT doc_id, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS start, start AS stop FROM g
           UNION ALL SELECT d.doc_id, coalesce(max(stop), 0), max(octet_length(b)) FROM d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id),
     t AS (SELECT k.doc_id, sha256(unhex(string_agg(hex(array_slice(b, start + 1, stop)), '' ORDER BY start))) AS kept, sum(stop - start) AS n
           FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id),
     c AS (SELECT doc_id, count(*) AS spans FROM g GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, (octet_length(b) - n)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, kept AS kept_sha256
FROM d JOIN t ON d.doc_id = t.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""

_OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     h AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM h)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": _OP3, "op6_decontamination": _OP6, "op7_warc": _OP7}
