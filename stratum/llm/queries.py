"""One query for each operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, jaccard, lmscore, orctokens, quality, substring, suffix, urlfilter, warc
from .common import Scratch


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), ["doc_id"])
    return out.select("doc_id", F.col("b_n").alias("n_tokens"), F.col("b_ids_sha256").alias("ids_sha256"), F.col("b_decoded_sha256").alias("decoded_sha256"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    out = lmscore.score(table(spark, sf_dir, "documents"), good, tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.round("loss_background", 6).alias("loss_background"), F.round("loss_target", 6).alias("loss_target"), F.round("score", 6).alias("score"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("orc")
    orctokens.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), path)
    return orctokens.checksums(orctokens.read(spark, path))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    warc.write_responses(table(spark, sf_dir, "pages"), scratch.path("responses"))
    warc.derive(spark, scratch.path("responses"), scratch.path("derived"))
    scratch.drop("responses")
    out = warc.linked(spark, scratch.path("derived"), bodies=False)
    return out.select("page_id", "refers_to", "uri", "metadata_id", "metadata_digest", "conversion_id", "conversion_digest", (F.col("concurrent_to") == F.col("metadata_id")).alias("linked"), "text_chars", "text_sha256")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.strip(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.col("s_bytes").alias("n_bytes"), F.col("s_removed").alias("n_removed"), F.col("s_spans").alias("n_spans"), F.col("s_kept_sha256").alias("kept_sha256"))


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, RULES), ["page_id"])
    return out.select("page_id", F.col("u_host").alias("host"), F.col("u_path").alias("path"), F.col("u_rule").alias("rule"), F.col("u_verdict").alias("verdict"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.join(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.col("j_shingles").alias("n_shingles"), F.col("j_component").alias("component_id"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.col("s_words").alias("n_words"), F.col("s_removed").alias("n_removed"), F.col("s_kept_sha256").alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.col("q_words").alias("n_words"), F.col("q_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"), F.col("q_dup_lines").alias("n_dup_lines"), F.col("q_repeat").alias("n_repeat_words"), F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


QUERIES = {f.__name__: f for f in (op1_bpe_codec, op2_lm_score, op3_decontamination, op4_token_orc, op5_warc_derivatives, op6_suffix_dedup, op7_url_filter, op8_jaccard_join, op9_substring_dedup, op10_quality_rules)}

_VALUES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
_UP, _LOW = urlfilter.UPPER, urlfilter.LOWER

_WORDS = r"list_filter(string_split_regex({0}, '{1}'), lambda x: x <> '')"
_SPLIT = _WORDS.format("coalesce(text, '')", r"[\x20\x09-\x0D]+")
_LOWER = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"
_LOWER_SPLIT = _WORDS.format(_LOWER, r"[\x20\x09-\x0D]+")
_ALNUM_SPLIT = _WORDS.format(_LOWER, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_MEASURED = {
    "symbol_share": "n_symbols * {u} // greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines * {u} * 10 // greatest(n_words, 1)",
    "repeat_share": "n_repeat_words * {u} // greatest(n_words, 1)",
    "word_length": "word_chars * {u} // greatest(n_words, 1)",
}
_MEASURED = ", ".join(f"{v.format(u=quality.UNIT)} AS {m}" for m, v in _MEASURED.items())
_STACKED = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM m WHERE NOT base_failed" for m in quality.MEASURES)
_QUARTILES = ", ".join(f"CAST(min(bin) FILTER (4 * below >= {k} * total) AS DOUBLE) AS {{0}}{k}" for k in (1, 2, 3))
_DRAWN = ", ".join(f"(g{k} * gn + ((l{k} * ln + w{k} * {quality.SHRINK}) / (ln + {quality.SHRINK})) * {quality.SHRINK}) / (gn + {quality.SHRINK}) AS d{k}" for k in (1, 2, 3))
_REACH = f"{quality.REACH:.1f}::DOUBLE"
_BOUNDS = ", ".join(
    f"max(CASE WHEN measure = '{m}' THEN d2 + greatest((d3 - d2) * {_REACH}, {least}.0::DOUBLE) END) AS hi_{m}, " + (f"max(CASE WHEN measure = '{m}' THEN d2 - greatest((d2 - d1) * {_REACH}, {least}.0::DOUBLE) END)" if sides == "both" else "-1.0") + f" AS lo_{m}"
    for m, (sides, least) in quality.MEASURES.items()
)
_WITHIN = " AND ".join(f"coalesce(CAST(m.{m} AS DOUBLE) BETWEEN lo_{m} AND hi_{m}, true)" for m in quality.MEASURES)


def _quartiles(name: str, by: str) -> str:
    keys = f"{by}, measure" if by else "measure"
    return f"""{name}s AS (SELECT {keys}, bin, sum(n) OVER (PARTITION BY {keys}) AS total, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS below FROM (SELECT {keys}, bin, sum(n) AS n FROM sketch GROUP BY ALL)),
{name} AS (SELECT {keys}, max(total) AS {name}n, {_QUARTILES.format(name)} FROM {name}s GROUP BY {keys})"""


ORACLE = {
    "op10_quality_rules": f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS body, {_SPLIT} AS ws FROM documents),
win AS (SELECT rid, i, array_to_string(ws[i : i + 2], ' ') AS gram FROM t, unnest(range(1, len(ws) - 1)) u(i)),
again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM again, unnest(range(i, i + 3)) u(p) GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
b AS (SELECT rid, doc_id, lang, source, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM c LEFT JOIN r USING (rid)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_MEASURED} FROM b),
v AS ({_STACKED}),
sketch AS (SELECT lang, source, measure, (v >> greatest(length(to_base(v, 2)) - {quality.BITS}, 0)) << greatest(length(to_base(v, 2)) - {quality.BITS}, 0) AS bin, count(*) AS n FROM v GROUP BY ALL),
{_quartiles("g", "lang, source")},
{_quartiles("l", "lang")},
{_quartiles("w", "")},
drawn AS (SELECT g.lang, g.source, g.measure, {_DRAWN} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.measure = l.measure JOIN w ON g.measure = w.measure),
bounds AS (SELECT lang, source, {_BOUNDS} FROM drawn GROUP BY lang, source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
NOT base_failed AND {_WITHIN} AS kept FROM m LEFT JOIN bounds ON m.lang IS NOT DISTINCT FROM bounds.lang AND m.source IS NOT DISTINCT FROM bounds.source""",
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_ALNUM_SPLIT} AS ws FROM documents),
b AS (SELECT item_id, {_ALNUM_SPLIT} AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(ws)) AS size, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS gram FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) t(i) WHERE len(ws) > 0),
s AS (SELECT DISTINCT size FROM g),
w AS (SELECT doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS gram FROM d, s, unnest(range(1, len(ws) - size + 2)) t(i)),
h AS (SELECT doc_id, i, w.size, item_id FROM w JOIN g ON w.gram = g.gram AND w.size = g.size),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + size)) t(p) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op8_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_SPLIT} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS gram FROM d, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= 90 * (m.n + o.n - c)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
r AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON d.doc_id = r.a""",
    "op9_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS ws FROM documents),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i : i + 19], ' ') ORDER BY doc_id, i) AS k FROM d, unnest(range(1, len(ws) - 18)) t(i)),
gone AS (SELECT DISTINCT doc_id, p FROM w, unnest(range(i, i + 20)) t(p) WHERE k > 1),
pos AS (SELECT doc_id, p, ws[p] AS word FROM d, unnest(range(1, len(ws) + 1)) t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op7_url_filter": f"""
WITH rules(rh, rp, action) AS (VALUES {_VALUES}),
parts AS (SELECT page_id, url, row_number() OVER () AS rid,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, rid, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts),
hit AS (SELECT rid, rh || rp AS rule, action, row_number() OVER (PARTITION BY rid ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS k
  FROM cut JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, 'allow') AS verdict
FROM cut LEFT JOIN hit ON cut.rid = hit.rid AND k = 1""",
}
