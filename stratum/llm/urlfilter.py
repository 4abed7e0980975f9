"""URL rules by hashed host-suffix and path-prefix expressions (DataFrame functions only).

Every distinct URL is expanded into the suffixes of its host, each with the prefixes of its path that
have the length of some rule's path. A short prefix of the expression's SHA-256 is the join key; the full digest
confirms a match. Of the rules that fit, the longest (host and path together, then host) wins.

Defined results: a null URL, or one without "://", has an empty host and path and fits no rule; an empty
path prefix fits every path; of equal rules the first action in the order of their names counts; equal URLs are judged once and every
row keeps its own verdict. The only thing collected is the set of path lengths of the rules (at most the longest path's length).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

SHORT = 8  # hex digits of the join key
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, action string")


def parts(url: str) -> tuple[F.Column, F.Column]:
    """Host and path as columns."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    clean = lambda c: F.coalesce(F.when(at > 0, c), F.lit(""))
    return clean(F.translate(host, UPPER, LOWER)), clean(path)


def judge(pages: DataFrame, rules: DataFrame, keep: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """`keep`, u_host, u_path, u_rule (null if none fits) and u_verdict for each row of pages."""
    lengths = [r[0] for r in rules.select(F.length(F.coalesce("rule_path", F.lit(""))).alias("n")).distinct().collect()]
    key = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)
    known = rules.where(F.coalesce("rule_host", F.lit("")) != "").select(F.translate("rule_host", UPPER, LOWER).alias("r_host"), F.coalesce("rule_path", F.lit("")).alias("r_path"), "action")
    known = known.groupBy("r_host", "r_path").agg(F.min("action").alias("r_action")).withColumn("r_digest", key(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.substring("r_digest", 1, SHORT))

    host, path = parts("u_url")
    urls = pages.select(F.col(url).alias("u_url")).where(F.col("u_url").isNotNull()).distinct().select("u_url", host.alias("h"), path.alias("p")).where(F.col("h") != "")
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length("p") >= n, F.substring("p", 1, n)) for n in sorted(lengths)]))
    expanded = urls.select("u_url", F.explode(suffixes).alias("eh"), "p").select("u_url", "eh", F.explode(prefixes).alias("ep")).where(F.col("eh") != "").withColumn("digest", key(F.col("eh"), F.col("ep")))
    hits = expanded.withColumn("short", F.substring("digest", 1, SHORT)).join(known, F.col("short") == F.col("r_short")).where((F.col("digest") == F.col("r_digest")) & (F.col("eh") == F.col("r_host")) & (F.col("ep") == F.col("r_path")))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), "r_host", "r_path", "r_action")
    best = hits.groupBy(F.col("u_url").alias("b_url")).agg(F.max(rank).alias("b"))
    # As a table, so that Spark broadcasts it if it is small and can split the rows of a common URL if it is not.
    best = Scratch(pages.sparkSession, "urls").save(best, "best")
    host, path = parts("u_url")
    rows = pages.select(*[F.col(c).alias(f"u_keep{i}") for i, c in enumerate(keep)], F.col(url).alias("u_url"))
    known = rows.where("u_url is not null").join(best, F.col("u_url") == F.col("b_url"), "left")
    none = rows.where("u_url is null").withColumns({c.name: F.lit(None).cast(c.dataType) for c in best.schema})  # these meet nothing
    return known.unionByName(none).select(
        *[F.col(f"u_keep{i}").alias(c) for i, c in enumerate(keep)], host.alias("u_host"), path.alias("u_path"), F.concat("b.r_host", "b.r_path").alias("u_rule"), F.coalesce("b.r_action", F.lit(default)).alias("u_verdict")
    )
