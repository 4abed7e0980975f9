"""Each stage against a plain version of its rule, on its own input, and the whole on the smallest tables."""

import re

import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as p
from stratum.llm import decontam, queries
from tests.llm.conftest import CLASH
from tests.llm.test_texts import plain_contamination, plain_jaccard, plain_substring, plain_verdicts

SF = "/root/testdata/sf0.001"


def write(tmp_path, df):
    path = str(tmp_path / "docs")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_stages_keep_columns_and_follow_their_rules(spark, docs, rows, none, tmp_path):
    texts = dict(rows)
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, none, SF).count() == 0
    kept = {r.doc_id for r in p.near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i, (n, root) in plain_jaccard(rows, 5, 80, 100).items() if i == root}
    removed = plain_substring(rows)
    left = {r.doc_id: r for r in p.repeated_passages(spark, docs, SF).collect()}
    assert set(left) == {i for i, (n, gone, _) in removed.items() if not gone or gone < n}
    assert all(len((r.text or "").split()) == removed[i][0] - removed[i][1] for i, r in left.items())
    assert all(r.n_chars == (len(r.text) if removed[i][1] else len(texts[i] or "")) for i, r in left.items())
    bench = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    clean = {r.doc_id for r in p.benchmark_passages(spark, docs, SF).collect()}
    assert clean == {i for i, x in plain_contamination(rows, bench).items() if not x[1]}
    judged = docs.select("doc_id", "text", "lang", "source").collect()
    good = {r.doc_id for r, kept in zip(judged, plain_verdicts([(r.text, r.lang, r.source) for r in judged])) if kept}
    assert {r.doc_id for r in p.quality_rules(spark, docs, SF).collect()} == good and good
    library = tokenizers.Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    assert {r.doc_id: r.ids for r in p.token_ids(spark, docs, SF).collect()} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert all(r[c] == "c" for r in left.values() for c in CLASH)


def test_planted_cases(spark):
    docs = queries.table(spark, SF, "documents")
    bench = queries.table(spark, SF, "benchmark").first().text
    fresh = " ".join(f"new{i}word" for i in range(300))
    plain = docs.orderBy("doc_id").first()
    planted = [(90_001, plain.text), (90_002, fresh), (90_003, fresh.replace("new7word", "other")), (90_004, fresh[:600] + " " + bench)]
    extra = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in planted], docs.schema)
    whole = docs.union(extra)
    kept = {r.doc_id for r in p.near_duplicates(spark, whole, SF).collect()}
    assert 90_001 not in kept and 90_002 in kept and 90_003 not in kept
    assert 90_004 not in {r.doc_id for r in p.benchmark_passages(spark, whole, SF).collect()}


def test_no_benchmark_passage_is_left(spark):
    docs, bench = queries.table(spark, SF, "documents"), queries.table(spark, SF, "benchmark")
    item = max((r.text for r in bench.collect()), key=len)
    head, tail = (" ".join(f"{w}{i}" for i in range(900)) for w in ("käse", "end"))
    texts = {1: f"{head}, {item}. {tail}", 2: f"{head} {tail}", 3: None, 4: f"{item} {head} {tail} {head} {item}", 5: f"{item} x"}
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()] + [(1, texts[1], "en", "s", 0), (2, texts[2], "en", "s", 7), (None, texts[1], "en", "s", 0)], docs.schema)
    left = p.benchmark_passages(spark, rows, SF)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in left.collect()) == [(2, texts[2], 7), (2, texts[2], len(texts[2])), (3, None, 0)]
    assert not any(r.n_hit for r in decontam.report(p.benchmark_passages(spark, docs, SF), bench).collect())
    # The operator can cut passages out as well.
    found = decontam.contamination(rows.where("doc_id in (1, 4)").distinct(), bench).select(F.col("doc_id").alias("hit"), "starts", "ends")
    got = decontam.cut(rows.dropDuplicates(["doc_id"]).join(found, F.col("doc_id") == F.col("hit"), "left"), ["doc_id"]).collect()
    flat = lambda t: [x for x in re.split("[^0-9a-zA-Z\x80-\U0010ffff]+", t or "") if x]
    assert {r.doc_id: flat(r.d_text) for r in got if r.doc_id in (1, 2, 3, 4)} == {1: flat(texts[2]), 2: flat(texts[2]), 3: [], 4: flat(f"{head} {tail} {head}")}


def test_repeated_rows_and_null_ids_go_through_all_stages(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    some = docs.limit(40).collect()
    extra = [(None, *r[1:]) for r in some[:5]] + [tuple(r) for r in some[:5]] + [(None, None, None, None, None)]
    (tmp_path / "sf").mkdir()
    docs.union(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{tmp_path}/sf/documents.parquet")
    queries.table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    got = p.run(spark, f"{tmp_path}/sf").collect()
    assert len(got) > 20 and len({r.ids_sha256 for r in got}) == len(got)


def test_the_whole(spark):
    out = p.run(spark, SF)
    got = out.collect()
    ids = [r.doc_id for r in got]
    assert len(set(ids)) == len(ids) > 50 and all(r.n_tokens == len(r.ids) for r in got)


def test_every_query_runs_and_has_one_row_for_each_input_row(spark):
    n_docs, n_pages = queries.table(spark, SF, "documents").count(), queries.table(spark, SF, "pages").count()
    for name, query in queries.QUERIES.items():
        want = n_pages if name.startswith(("op5", "op7")) else n_docs
        assert query(spark, SF).count() == want, name


def test_sql_agrees(spark):
    import duckdb

    from tests.test_catalog import table

    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        got, want = queries.QUERIES[name](spark, SF), con.execute(sql)
        assert table(got.collect(), got.columns) == table(want.fetchall(), [c[0] for c in want.description]), name


def test_quality_rules_write_no_documents(spark, docs, monkeypatch):
    written, save = [], p.Scratch.save
    monkeypatch.setattr(p.Scratch, "save", lambda self, df, name, **options: (written.append(df.schema.simpleString()), save(self, df, name, **options))[1])
    left = p.quality_rules(spark, docs, SF)
    assert written and not any("text:" in x for x in written)
    # The same id and text in other groups is judged apart: one source of long words, nulls on either side.
    odd, even = "incomprehensibilities " * 3, [" ".join(f"w{i}{j}" for j in range(60)) for i in range(400)]
    long = " ".join(f"{odd.split()[0]}{j}" for j in range(60))
    data = [(i, t, None, "x", 1) for i, t in enumerate(even)] + [(1000 + i, f"{long} {i}", "x", None, 1) for i in range(400)] + [(5000, long, None, "x", 1), (5000, long, "x", None, 1)]
    rows = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.lang, r.source) for r in p.quality_rules(spark, rows, SF).where("doc_id = 5000").collect()]
    judged = [(r.lang, r.source) for r in p.quality.judge(rows, ["doc_id", "lang", "source"]).where("doc_id = 5000 and q_kept").collect()]
    assert sorted(got, key=str) == sorted(judged, key=str) and len(left.columns) == len(docs.columns)
