"""Every query of the store against DuckDB on the smallest tables."""

import duckdb
import pytest

from stratum import catalog, conformance

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def tables(d):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return tables(SF)


@pytest.fixture(scope="module")
def duck_of_more():
    return tables(MORE)


def table(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    return [names[i] for i in order], sorted(repr(tuple(cell(r[i]) for i in order)) for r in rows)


QUERIES, ORACLE = catalog.QUERIES | conformance.QUERIES, catalog.ORACLE | conformance.ORACLE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows
    if name in ORACLE:
        want = duck.execute(ORACLE[name])
        assert table(rows, got.columns) == table(want.fetchall(), [c[0] for c in want.description])


@pytest.mark.parametrize("name", ["q35_store_reopened", "q36_store_compacted", "q38_store_lookup", "q39_store_get", "q40_store_counters"])
def test_store_where_partitions_are_cut_by_size(spark, duck_of_more, narrow_cut, name):
    got = QUERIES[name](spark, MORE)
    rows, want = got.collect(), duck_of_more.execute(ORACLE[name])
    assert table(rows, got.columns) == table(want.fetchall(), [c[0] for c in want.description])


def test_crc_of_whole_documents(spark):
    """SQL takes minutes for the checksums of whole texts, so they are held against the library's."""
    import zlib

    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert {r.doc_id: r.crc for r in catalog.QUERIES["q24_crc"](spark, SF).collect()} == {i: zlib.crc32(t.encode()) for i, t in texts.items()}


def test_entry_works_without_the_training_data_package(spark, monkeypatch):
    import importlib
    import sys

    for name in [n for n in sys.modules if n.startswith("stratum.llm")] + ["stratum.llm", "stratum.llm.queries", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    import stratum

    monkeypatch.delattr(stratum, "llm", raising=False)
    import __spark_entry__

    entry = importlib.reload(__spark_entry__)
    assert not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() > 0
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
