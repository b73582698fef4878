"""The pipeline's stages, and registered queries against their checking SQL."""

import duckdb
import pytest

import corpus_pipeline
from forklore.llm import catalog, packing
from forklore.llm.common import table


def cell(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_checking_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = catalog.QUERIES[name](spark, sf_dir)
    cursor = con.execute(catalog.ORACLES[name])
    order = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    want = sorted(repr(tuple(cell(r[i]) for i in order)) for r in cursor.fetchall())
    assert sorted(repr(tuple(cell(v) for v in r)) for r in df.collect()) == want


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns, name
        if name != "mix_sources":
            assert kept.count() <= before.count() and kept.count() > 0
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    want = packing.pack(kept).agg({"length": "sum", "ids_crc32": "sum"}).first()
    assert last.agg({"length": "sum", "ids_crc32": "sum"}).first() == want


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0
