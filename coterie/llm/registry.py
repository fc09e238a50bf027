"""The thin ``opN_*`` queries: each applies one operator to its whole table and digests the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm import bpe, htmltext, kneserney, langid, media, packing, secrets, simhash, syncmers, urlfilter
from coterie.llm.common import table


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda kinds: F.filter("findings", lambda x: secrets.kind(x).isin(*kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    return paths.select("doc_id", *counts, F.sha2(secrets.joined(of(secrets.BASE)), 256).alias("base_sha256"), secrets.joined(F.col("findings")).alias("spans"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneserney.train(docs.where(F.coalesce(remainder(10) != 0, F.lit(True))))
    scored = kneserney.score(docs, model)
    held_out = F.coalesce(remainder(10) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder(4) != 2))
    # the flag depends on the id alone, so it comes back by the id column itself
    return langid.identify(docs, model).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edits(table(spark, sf_dir, "documents"))


# parts of these results that SQL can express, over the whole tables


def llm_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def llm_unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language model's word counts, learnt from all documents."""
    docs = table(spark, sf_dir, "documents")
    model = kneserney.train(docs)
    scored = kneserney.score(docs, model)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), F.round("base_score", 3).alias("base_score"))


def llm_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule, and the verdict where a rule decides."""
    return op6_url_filter(spark, sf_dir).select("page_id", "host", "path", F.coalesce("rule", F.lit("")).alias("rule"), F.when(F.col("rule").isNotNull(), F.col("verdict")).otherwise("").alias("ruled"))


def llm_packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether its pieces follow each other without a gap to its last token, none too long."""
    pieces = op7_packing(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("held"), F.max("doc_tokens").alias("tokens"), F.max(F.col("start") + F.col("length")).alias("end"), F.max("length").alias("most"), F.min("length").alias("least"))
    return pieces.select("doc_id", ((F.col("held") == F.col("tokens")) & (F.col("end") == F.col("tokens")) & (F.col("most") <= packing.SIZE) & (F.col("least") > 0)).alias("whole"))


def llm_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: sequences whose pieces leave a gap, overlap or are too long; whether padding is below a twentieth."""
    pieces = op7_packing(spark, sf_dir).groupBy("sequence_id").agg(F.sum("length").alias("held"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("first"), F.count("*").alias("n"), F.count_distinct("offset").alias("offsets"))
    # n pieces of positive length at n distinct offsets from 0 that reach just the sum of their lengths
    broken = (F.col("held") != F.col("end")) | (F.col("first") != 0) | (F.col("n") != F.col("offsets")) | (F.col("end") > packing.SIZE)
    return pieces.agg(F.count_if(broken).alias("broken"), (F.sum("held") > 0.95 * packing.SIZE * (F.count("*") - 1)).alias("little_padding"))


def llm_payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", (F.col("media_bytes") > F.col("payload_bytes")).alias("stored"))


def llm_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_syncmers(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


_QUERIES = (op1_secret_scan, op2_bpe, op3_html_text, op4_simhash, op5_kneser_ney, op6_url_filter, op7_packing, op8_media, op9_language_id, op10_syncmers)
_PARTS = (llm_secret_counts, llm_unigram_scores, llm_url_rules, llm_packed_documents, llm_packed_sequences, llm_payload_bytes, llm_edited_texts)
QUERIES = {f.__name__: f for f in (*_QUERIES, *_PARTS)}


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + """)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SPACES = "[\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_BY_LENGTH = sorted(urlfilter.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

#: Tokenizers, learned models, XXH64 and parsers cannot be expressed in SQL; tests compare the ``opN_`` queries with
#: brute force.  What SQL can say of them is here.
ORACLE_SQL: dict[str, str] = {
    "llm_secret_counts": f"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 2), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents""",
    "llm_unigram_scores": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACES}'), lambda x: x <> ''), chr(10)) AS words FROM documents),
t AS (SELECT r, unnest(words) AS w FROM d), c AS (SELECT w, count(*) AS c FROM t GROUP BY w), n AS (SELECT sum(c) AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*) AS n_known, sum(log10((c + 0.1) / (n + 0.1 * (v + 1)))) AS base FROM t JOIN c USING (w), n GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(base, 3) AS base_score FROM d JOIN s USING (r), n""",
    "llm_url_rules": f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_FITS.format(h, q)} THEN '{h}{q}'" for _, h, q in _BY_LENGTH)} ELSE '' END AS rule,
  CASE {" ".join(f"WHEN {_FITS.format(h, q)} THEN '{v}'" for v, h, q in _BY_LENGTH)} ELSE '' END AS ruled FROM p""",
    "llm_packed_documents": "SELECT DISTINCT doc_id, true AS whole FROM documents",
    "llm_packed_sequences": "SELECT CAST(0 AS BIGINT) AS broken, true AS little_padding",
    "llm_payload_bytes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST(greatest(1, ceil(strlen(coalesce(text, '')) / 64.0)) * 64 AS BIGINT) AS payload_bytes, true AS stored FROM documents",
    "llm_edited_texts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT doc_id, t, n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS after FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(left(t, n - n // 3) || left(after, n // 3)) AS edited_sha256 FROM e""",
}
