"""The numbered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import infill, languages, media, mixing, neardup, packing, polytope, quality, sharding, toxicity, warc, whitening
from .bpe import with_token_counts
from .shared import documents, stored


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_token_counts(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law bytes. next_shard: the shard under the map's second version, edited for 41 shards."""
    rows = sharding.sharded(documents(spark, sf_dir), 40, then_shards=41)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.with_quality(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", *(F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), *(F.col(f"q_fail_{r.name}").alias(f"fail_{r.name}") for r in quality.RULES))


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are written as a table in the shared folder, and the features are those of the stored bytes."""
    rows = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kept = stored(media.with_media(rows).drop("text"), "media", compression="zstd")
    return kept.withColumn("d", media.digest(F.col("media"))).select("doc_id", "n_bytes", "d.*")


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), width=3, percent=85)


def op6_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), with_tokens=False)


def op7_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return toxicity.with_toxicity(rows, labels, with_sentences=False).select("doc_id", "held_out", "score", "predicted")


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the archive against a mirror that has decoded &amp; and has not kept pages reached by a fragment."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    mirror = pages.filter(~F.coalesce(F.col("url").contains("#"), F.lit(False))).withColumn("html", F.replace("html", F.lit("&amp;"), F.lit("&")))
    found = warc.audit(*(warc.placed(warc.leaves(x)) for x in (pages, mirror)))
    return found.select(F.col("id").alias("page_id"), "copies", "warc_file", "record_offset", "record_length", "record_sha256", "status")


def op8_sql() -> str:
    """Both archives laid out and compared record by record."""
    crlf = "chr(13) || chr(10)"

    def archive(name: str, table: str) -> str:
        record = f"""'WARC/1.0' || {crlf} || 'WARC-Type: response' || {crlf} || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'null') || '>' || {crlf}
      || 'WARC-Target-URI: ' || coalesce(url, '') || {crlf} || 'Content-Length: ' || strlen(coalesce(html, '')) || {crlf} || {crlf} || coalesce(html, '') || {crlf} || {crlf}"""
        return f"""
{name}_records AS (SELECT page_id, sha256(rec) AS sha, strlen(rec)::BIGINT AS len, count(*)::BIGINT AS copies FROM (SELECT page_id, {record} AS rec FROM {table}) GROUP BY ALL),
{name}_files AS (SELECT *, CASE WHEN page_id IS NULL THEN 'null-' || left(sha, 3) ELSE floor(page_id / {warc.FILE_IDS}.0)::BIGINT::VARCHAR END AS file FROM {name}_records),
{name}_archive AS (SELECT *, coalesce(sum(copies * len) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM {name}_files)"""

    return f"""
WITH mirror AS (SELECT page_id, url, replace(html, '&amp;', '&') AS html FROM pages WHERE NOT coalesce(contains(url, '#'), false)),{archive("a", "pages")},{archive("b", "mirror")}
SELECT a.page_id, a.copies, a.file AS warc_file, a.off AS record_offset, a.len AS record_length, a.sha AS record_sha256,
  CASE WHEN b.sha IS NOT NULL THEN CASE WHEN a.off = b.off THEN 'ok' ELSE 'moved' END
    WHEN EXISTS (SELECT 1 FROM b_records x WHERE x.page_id IS NOT DISTINCT FROM a.page_id) THEN 'altered' ELSE 'missing' END AS status
FROM a_archive a LEFT JOIN b_archive b ON a.page_id IS NOT DISTINCT FROM b.page_id AND a.sha = b.sha AND a.copies = b.copies
UNION ALL SELECT page_id, copies, file, off, len, sha, 'extra' FROM b_archive b WHERE NOT EXISTS (SELECT 1 FROM a_records x WHERE x.page_id IS NOT DISTINCT FROM b.page_id)
"""


def op9_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return languages.with_languages(rows).select("doc_id", "held_out", "lang_pred", "score", "lang_spans")


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS shuffle FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
f AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) * weight >= cap * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS is_full
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN is_full THEN cap ELSE (budget - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) / sum(weight) FILTER (NOT is_full) OVER () * weight END AS target FROM f),
q AS (SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS sent
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(size, greatest(0, floor(target) - sent + size)) + least(size, greatest(0, floor(target) - source_size - sent + size)) + least(size, greatest(0, floor(target) - 2 * source_size - sent + size)))::BIGINT AS taken
FROM q
"""


def op3_sql() -> str:
    """The same counts and thresholds; windows are compared as word lists."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS.split())))
    ratio = {
        "n_words": "n_words",
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "capital_ratio": "n_capitals / greatest(word_chars, 1)",
    }
    rules = []
    for r in quality.RULES:
        bad = [f"({ratio[r.metric]}) < {r.low}"] * (r.low is not None) + [f"({ratio[r.metric]}) > {r.high}"] * (r.high is not None)
        rules.append(f"(({' OR '.join(bad)}) AND n_words >= {r.from_words}) AS fail_{r.name}")
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT r, i, list_slice(words, i, i + 4) AS win FROM w, LATERAL (SELECT unnest(generate_series(1, len(words) - 4)) AS i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
covered AS (SELECT r, sum(least(5, coalesce(next - i, 5)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM twice) GROUP BY r),
c AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
    (n_lines - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM w LEFT JOIN covered USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {", ".join(rules)} FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(f"NOT fail_{r.name}" for r in quality.RULES)} AS kept, {", ".join(f"fail_{r.name}" for r in quality.RULES)} FROM f
"""


def op11_marker_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.infilled(documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.length("fim_prefix").cast("long").alias("prefix_chars"), F.length("fim_middle").cast("long").alias("middle_chars"), digest(F.col("fim_output")).alias("output_sha256"), digest(infill.restored(F.col("fim_output"), F.col("fim_form"))).alias("restored_sha256"))


#: Texts are cut by position here, without markers between units.
OP11_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(t)::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS x FROM documents),
u AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, and what is reached over links.
OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(e, e)) AS norm FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
least_ AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least_ ON x = vec_id
"""


def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.with_whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_token_counts": op1_token_counts, "op2_virtual_slots": op2_virtual_slots, "op3_quality_rules": op3_quality_rules, "op4_iso_media": op4_iso_media, "op5_hyperminhash": op5_hyperminhash, "op6_differencing_pack": op6_differencing_pack, "op7_noisy_or_toxicity": op7_noisy_or_toxicity, "op8_merkle_audit": op8_merkle_audit, "op9_script_viterbi": op9_script_viterbi, "op10_fair_mix": op10_fair_mix, "op11_marker_injection": op11_marker_injection, "op12_cross_polytope": op12_cross_polytope, "op13_tsqr_whitening": op13_tsqr_whitening}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": op3_sql(), "op8_merkle_audit": op8_sql(), "op10_fair_mix": OP10_SQL, "op11_marker_injection": OP11_SQL, "op12_cross_polytope": OP12_SQL}
