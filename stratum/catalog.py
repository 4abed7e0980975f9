"""The query catalog: each operator of the store as a query on the given tables, and SQL that gives the same rows.

Two logs are used. `m` has few hot keys: users, written by their events, deleted by errors, in runs of 1000. `s` has keys that slide with
time, so that the ranges of its ten runs differ and overlap only with their neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import bloom, resp
from stratum.operators import compact, prune, replay, resolve, runs
from stratum.plans.scratch import scratch_root
from stratum.sources.manifest import orphans
from stratum.sources.mutations import mutations
from stratum.streaming import latest as streaming

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

M = "m AS (SELECT user_id AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, event_id // 1000 AS file, ts FROM events)"
S = """r AS (SELECT count(*) // 10 AS run FROM events),
s AS (SELECT lpad(CAST(greatest(0, event_id - (user_id * 11) % (3 * run // 2)) AS VARCHAR), 8, '0') AS key, event_id + 1 AS seq,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, event_id // run AS file FROM events, r)"""
NEWEST = "row_number() OVER (PARTITION BY {0} ORDER BY seq DESC) AS k"
SN = f"{S}, sn AS (SELECT * FROM (SELECT *, {NEWEST.format('file, key')} FROM s) WHERE k = 1)"
STATS = "files AS (SELECT file AS number, min(key) AS min_key, max(key) AS max_key, count(*) AS entries, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM sn GROUP BY file)"


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def log_m(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    return mutations(e, "user_id", F.col("event_id") + 1, "props", F.col("event_type") == "error", file=F.expr("event_id div 1000"), ts=F.col("ts"), event_value=F.col("value"), event_id=F.col("event_id"))


def log_s(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    run = e.count() // 10
    key = F.lpad(F.greatest(F.lit(0), F.col("event_id") - (F.col("user_id") * 11) % (3 * run // 2)).cast("string"), 8, "0")
    return mutations(e, key, F.col("event_id") + 1, "props", F.col("event_type") == "error", file=F.expr(f"event_id div {run}"))


def files_s(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_stats(log_s(spark, d)).withColumnRenamed("file", "number")


@_query(f"WITH {M} SELECT key, seq, value FROM (SELECT *, {NEWEST.format('key')} FROM m) WHERE k = 1 AND value IS NOT NULL")
def q01_latest_live(spark, d):
    return resolve.live(log_m(spark, d))


@_query(f"""WITH {M}, n AS (SELECT * FROM (SELECT *, {NEWEST.format('key')} FROM m) WHERE k = 1)
SELECT c_custkey AS key, CASE WHEN seq IS NULL THEN 'MISSING' WHEN value IS NULL THEN 'DELETED' ELSE 'FOUND' END AS status, value FROM customer LEFT JOIN n ON c_custkey = key""")
def q02_multi_get_status(spark, d):
    return resolve.lookup(_read(spark, d, "customer").select(F.col("c_custkey").alias("key")), log_m(spark, d)).select("key", "status", "value")


@_query(f"WITH {M} SELECT key, seq FROM (SELECT *, {NEWEST.format('key')} FROM m) WHERE k = 1 AND value IS NULL")
def q03_tombstones(spark, d):
    return resolve.tombstones(log_m(spark, d))


@_query(f"""WITH {S}, n AS (SELECT * FROM (SELECT *, {NEWEST.format('key')} FROM s) WHERE k = 1)
SELECT count(*) AS keys, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS tombstones, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS newest_bytes,
(SELECT CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) FROM s) AS all_bytes FROM n""")
def q04_memtable_stats(spark, d):
    return resolve.table_stats(log_s(spark, d))


@_query(f"WITH {M} SELECT key, seq, value FROM (SELECT *, {NEWEST.format('key')} FROM m) WHERE k = 1 ORDER BY key")
def q05_memtable_scan(spark, d):
    return resolve.scan(log_m(spark, d))


@_query("""SELECT event_id, coalesce(event_id + 1 > max(event_id + 1) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS newest FROM events""")
def q06_insert_is_newest(spark, d):
    return resolve.was_newest(log_m(spark, d).select("key", "seq", "event_value", "event_id"), F.col("event_value"), F.col("event_id")).select("event_id", "newest")


@_query(f"WITH {M} SELECT file, count(*) AS appends, min(seq) AS first_seq, max(seq) AS last_seq FROM m GROUP BY file")
def q07_run_assignment(spark, d):
    return log_m(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("appends"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@_query(f"WITH {SN}, {STATS} SELECT * FROM files")
def q08_run_stats(spark, d):
    return files_s(spark, d)


@_query(f"""WITH RECURSIVE {M}, n AS (SELECT * FROM (SELECT *, {NEWEST.format('file, key')} FROM m) WHERE k = 1),
e AS (SELECT file, key, row_number() OVER (PARTITION BY file ORDER BY key) AS i, 13 + strlen(CAST(key AS VARCHAR)) + CASE WHEN value IS NULL THEN 0 ELSE 4 + strlen(value) END AS size FROM n),
w(file, key, i, size, block, filled) AS (SELECT file, key, i, size, 0, size FROM e WHERE i = 1
  UNION ALL SELECT e.file, e.key, e.i, e.size, CASE WHEN w.filled >= 1024 THEN w.block + 1 ELSE w.block END, CASE WHEN w.filled >= 1024 THEN e.size ELSE w.filled + e.size END FROM w JOIN e ON e.file = w.file AND e.i = w.i + 1)
SELECT file, CAST(block AS BIGINT) AS block, min(key) AS first_key, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM w GROUP BY file, block""")
def q09_block_index(spark, d):
    return runs.sparse_index(resolve.latest(log_m(spark, d), ["file"]), "file", 1024)


@_query(f"WITH {SN}, {STATS} SELECT k.key, count(*) AS candidates, min(number) AS oldest, max(number) AS newest FROM (SELECT DISTINCT key FROM s) k JOIN files ON k.key BETWEEN min_key AND max_key GROUP BY k.key")
def q10_candidate_files(spark, d):
    found = prune.candidates(log_s(spark, d).select("key").distinct(), files_s(spark, d))
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("candidates"), F.min("number").alias("oldest"), F.max("number").alias("newest"))


@_query(f"WITH {SN}, {STATS} SELECT a.number AS a_number, b.number AS b_number FROM files a JOIN files b ON a.number < b.number AND a.min_key <= b.max_key AND b.min_key <= a.max_key")
def q11_overlapping_runs(spark, d):
    return prune.overlapping_pairs(files_s(spark, d))


@_query(f"""WITH {S}, n AS (SELECT * FROM (SELECT *, {NEWEST.format('key')} FROM s) WHERE k = 1),
f AS (SELECT CAST(substr(key, 1, 6) AS BIGINT) AS number, min(key) AS min_key, max(key) AS max_key FROM n GROUP BY 1)
SELECT n.key, f.number FROM n LEFT JOIN f ON n.key BETWEEN min_key AND max_key""")
def q12_covering_file(spark, d):
    newest = resolve.latest(log_s(spark, d))
    level = newest.groupBy(F.substring("key", 1, 6).cast("long").alias("number")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    return prune.candidates(newest, level).select("key", "number")


@_query(f"WITH {S} SELECT count(*) AS probes, CAST(0 AS BIGINT) AS false_negatives FROM (SELECT DISTINCT file, key FROM s)")
def q13_bloom_no_false_negative(spark, d):
    entries = log_s(spark, d).select("file", "key").distinct()
    hit = bloom.probe(entries, bloom.filters(entries))
    return hit.agg(F.count(F.lit(1)).alias("probes"), F.sum(F.when(F.col("maybe"), 0).otherwise(1)).alias("false_negatives"))


@_query(f"WITH {M} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file DESC, seq DESC) AS k FROM m) WHERE k = 1 AND value IS NOT NULL")
def q14_level_walk(spark, d):
    return resolve.level_walk(resolve.latest(log_m(spark, d), ["file"]))


@_query(f"WITH {SN} SELECT key, seq, value FROM (SELECT * EXCLUDE k, {NEWEST.format('key')} FROM sn WHERE file >= 5) WHERE k = 1")
def q15_merge_runs(spark, d):
    entries = resolve.latest(log_s(spark, d), ["file"])
    return compact.merge(*[entries.where(F.col("file") == n).drop("file") for n in range(5, 10)], entries.where("file > 9").drop("file"))


@_query(f"""WITH {SN}, {STATS}, o AS (SELECT key, seq, value FROM (SELECT * EXCLUDE k, {NEWEST.format('key')} FROM sn WHERE file >= 5) WHERE k = 1)
SELECT * FROM o WHERE value IS NOT NULL OR EXISTS (SELECT 1 FROM files WHERE number IN (3, 4) AND o.key BETWEEN min_key AND max_key)""")
def q16_purge_tombstones(spark, d):
    merged = compact.merge(resolve.latest(log_s(spark, d), ["file"]).where("file >= 5").drop("file"))
    return compact.purge(merged, files_s(spark, d).where("number in (3, 4)"))


LEVELED = "lf AS (SELECT *, CASE WHEN number >= 6 THEN 0 WHEN number >= 3 THEN 1 ELSE 2 END AS level FROM files)"


def _leveled(spark, d):
    return files_s(spark, d).withColumn("level", F.when(F.col("number") >= 6, 0).when(F.col("number") >= 3, 1).otherwise(2))


@_query(f"""WITH {SN}, {STATS}, {LEVELED}, g AS (SELECT level, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM lf GROUP BY level),
c AS (SELECT level, CASE WHEN level = 0 THEN files / 4.0::DOUBLE ELSE bytes / (20000 * pow(10, level - 1)) END AS score FROM g)
SELECT level, round(score, 9) AS score FROM c WHERE (level = 0 AND score >= 1) OR (level > 0 AND score > 1) ORDER BY c.score DESC, level LIMIT 1""")
def q17_compaction_plan(spark, d):
    return compact.plan_level(_leveled(spark, d), 4, 20_000, 10).select("level", F.round("score", 9).alias("score"))


@_query("SELECT CAST(level AS INTEGER) AS level, CAST(41943040 * pow(10, level - 1) AS BIGINT) AS bytes FROM generate_series(1, 6) t(level)")
def q18_level_budget(spark, d):
    return spark.range(1, 7).select(F.col("id").cast("int").alias("level"), compact.budget(F.col("id"), 4 * 10 << 20, 10).alias("bytes"))


@_query(f"""WITH RECURSIVE {S}, n AS (SELECT * FROM (SELECT *, {NEWEST.format('key')} FROM s) WHERE k = 1),
e AS (SELECT CAST(substr(key, 1, 6) AS BIGINT) AS file, key, row_number() OVER (PARTITION BY substr(key, 1, 6) ORDER BY key) AS i, 13 + strlen(key) + CASE WHEN value IS NULL THEN 0 ELSE 4 + strlen(value) END AS size FROM n),
w(file, key, i, size, cut, filled) AS (SELECT file, key, i, size, 0, size FROM e WHERE i = 1
  UNION ALL SELECT e.file, e.key, e.i, e.size, CASE WHEN w.filled >= 2000 THEN w.cut + 1 ELSE w.cut END, CASE WHEN w.filled >= 2000 THEN e.size ELSE w.filled + e.size END FROM w JOIN e ON e.file = w.file AND e.i = w.i + 1)
SELECT file, CAST(cut AS BIGINT) AS cut, min(key) AS min_key, max(key) AS max_key, count(*) AS entries FROM w GROUP BY file, cut""")
def q19_output_cut(spark, d):
    entries = resolve.latest(log_s(spark, d)).withColumn("part", F.substring("key", 1, 6).cast("long"))
    return runs.cuts(entries, "part", 2000, "cut").groupBy("file", "cut").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("entries"))


@_query(f"""WITH {SN}, {STATS}, lf AS (SELECT *, CASE WHEN number >= 6 THEN 0 WHEN number >= 3 THEN 1 ELSE 3 END AS level FROM files)
SELECT CAST(l AS INTEGER) AS level, count(number) AS files, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM generate_series(0, 3) t(l) LEFT JOIN lf ON level = l GROUP BY l""")
def q20_level_stats(spark, d):
    files = files_s(spark, d).withColumn("level", F.when(F.col("number") >= 6, 0).when(F.col("number") >= 3, 1).otherwise(3))
    return compact.level_sizes(files)


@_query(f"WITH {SN}, {STATS} SELECT number FROM files WHERE NOT EXISTS (SELECT 1 FROM files n WHERE n.number = files.number AND n.number % 4 <> 3)")
def q21_orphans(spark, d):
    files = files_s(spark, d)
    return orphans(files.select("number"), files.where("number % 4 <> 3"))


@_query("""WITH t AS (SELECT min(event_id) AS torn_at FROM events WHERE event_id % 997 = 996)
SELECT any_value(torn_at) AS torn_at, count(*) AS records, max(event_id + 1) AS last_seq FROM events, t WHERE torn_at IS NULL OR event_id < torn_at""")
def q22_replay_prefix(spark, d):
    return replay.torn_at(log_m(spark, d), "event_id", F.col("event_id") % 997 == 996)


@_query(f"WITH {M} SELECT greatest(5000, max(seq)) AS last_seq FROM m")
def q23_last_sequence(spark, d):
    return replay.last_sequence(log_m(spark, d), 5000)


@_query(None)
def q24_crc(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.crc32(F.encode("text", "utf-8")).alias("crc"))


@_query(f"""WITH {M}, n AS (SELECT * FROM (SELECT *, {NEWEST.format('key')} FROM m) WHERE k = 1 AND value IS NOT NULL)
SELECT count(*) AS removed FROM n WHERE key IN (SELECT o_custkey % 400 FROM orders)""")
def q25_del_count(spark, d):
    wanted = _read(spark, d, "orders").select((F.col("o_custkey") % 400).alias("key"))
    return resolve.live(log_m(spark, d)).join(wanted, "key", "left_semi").agg(F.count(F.lit(1)).alias("removed"))


@_query("SELECT doc_id, md5('$' || strlen(text) || chr(13) || chr(10) || text || chr(13) || chr(10)) AS framed FROM documents")
def q26_resp_encode(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(F.encode(resp.bulk(F.col("text")), "utf-8")).alias("framed"))


@_query("""SELECT event_id, upper(w[1]) AS name, array_to_string(w[2:], ',') AS args FROM
(SELECT event_id, list_filter(regexp_split_to_array(' sEt  user:' || user_id || chr(9) || event_type || ' ', '[ \\t\\n\\f\\r]+'), lambda x: x <> '') AS w FROM events)""")
def q27_resp_inline_parse(spark, d):
    line = F.concat(F.lit(" sEt  user:"), F.col("user_id").cast("string"), F.lit("\t"), F.col("event_type"), F.lit(" "))
    found = resp.inline(line)
    return _read(spark, d, "events").select("event_id", found["name"].alias("name"), F.array_join(found["args"], ",").alias("args"))


@_query(f"""WITH {SN}, {STATS}, {LEVELED}, g AS (SELECT l, count(number) AS n FROM generate_series(0, 2) t(l) LEFT JOIN lf ON level = l GROUP BY l)
SELECT (SELECT count(*) FROM files) AS files, (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY l) FROM g) AS files_per_level, (SELECT max(seq) FROM s) AS last_sequence, (SELECT CAST(sum(bytes) AS BIGINT) FROM files) AS bytes_written""")
def q28_info(spark, d):
    files = _leveled(spark, d)
    per_level = compact.level_sizes(files).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "files"))), lambda x: x["files"].cast("string")), ",").alias("files_per_level"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes_written")).join(per_level, F.lit(True)).join(replay.last_sequence(log_s(spark, d), 0).withColumnRenamed("last_seq", "last_sequence"), F.lit(True)).select("files", "files_per_level", "last_sequence", "bytes_written")


@_query(f"""WITH {SN}, {STATS}, n AS (SELECT * FROM (SELECT *, {NEWEST.format('key')} FROM s) WHERE k = 1 AND value IS NOT NULL),
a AS (SELECT (SELECT sum(bytes) FROM files)::DOUBLE AS disk, (SELECT sum(strlen(key) + coalesce(strlen(value), 0)) FROM s)::DOUBLE AS ingested, (SELECT sum(strlen(key) + strlen(value)) FROM n)::DOUBLE AS live)
SELECT round(disk / ingested, 6) AS write_amplification, round(disk / live, 6) AS space_amplification FROM a""")
def q29_amplification(spark, d):
    log = log_s(spark, d)
    disk = files_s(spark, d).agg(F.sum("bytes").cast("double").alias("disk"))
    ingested = log.agg(F.sum(resolve.octets("key", "value")).cast("double").alias("ingested"))
    alive = resolve.live(log).agg(F.sum(resolve.octets("key", "value")).cast("double").alias("live"))
    return disk.join(ingested, F.lit(True)).join(alive, F.lit(True)).select(F.round(F.col("disk") / F.col("ingested"), 6).alias("write_amplification"), F.round(F.col("disk") / F.col("live"), 6).alias("space_amplification"))


@_query("""WITH b AS (SELECT b, greatest(1, least(30, (b * 69315 + 50000) // 100000)) AS k FROM (VALUES (4), (8), (10), (12), (16)) t(b))
SELECT CAST(b AS BIGINT) AS bits_per_key, CAST(k AS INTEGER) AS probes, round(pow(1 - exp(-k::DOUBLE / b), k), 9) AS false_positive_rate FROM b""")
def q30_bloom_theory(spark, d):
    bits = spark.createDataFrame([(b,) for b in (4, 8, 10, 12, 16)], "bits_per_key long")
    return bits.select("bits_per_key", bloom.probes_column(F.col("bits_per_key")).alias("probes"), F.round(bloom.theory(F.col("bits_per_key")), 9).alias("false_positive_rate"))


@_query("SELECT epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS appends FROM events GROUP BY 1")
def q31_group_commit_windows(spark, d):
    out = streaming.commit_windows(log_m(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour")
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "appends")


@_query(ORACLE["q01_latest_live"])
def q32_stream_latest(spark, d):
    schema = _read(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    log = mutations(events, "user_id", F.col("event_id") + 1, "props", F.col("event_type") == "error")
    return streaming.replayed(spark, log, scratch_root(spark))


@_query("""WITH p AS (SELECT event_id AS n FROM events WHERE event_id % 1009 <> 1008 AND event_id % 1013 <> 1012),
g AS (SELECT CASE WHEN min(n) <> 0 THEN 0 ELSE (SELECT min(n) + 1 FROM (SELECT n, lead(n) OVER (ORDER BY n) AS f FROM p) WHERE f IS NULL OR f <> n + 1) END AS present, max(n) + 1 - count(*) AS holes, count(*) AS total FROM p)
SELECT present, holes, total - present AS past_end FROM g""")
def q33_prefix_oracle(spark, d):
    return compact.first_gap(_read(spark, d, "events").where("event_id % 1009 <> 1008 and event_id % 1013 <> 1012"), "event_id")
