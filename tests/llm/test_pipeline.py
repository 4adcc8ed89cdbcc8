"""The pipeline's stages and the registered queries on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from intervane.llm import registry, secret_scan, simhash_dedup, toxicity
from intervane.llm.common import tables

SF = "/root/testdata/sf0.001"


def test_stages_are_in_order_and_keep_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "secret_scan", "source_mixing", "bestfit_packing"]
    docs = tables(spark, SF, "documents")
    columns = docs.columns
    a = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    model = toxicity.train(docs, toxicity.learnable(tables(spark, SF, "labels")))
    gone = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert a.columns == columns and {r.doc_id for r in a.collect()} == {r.doc_id for r in docs.collect()} - gone
    b = corpus_pipeline.drop_near_duplicates(spark, a, SF).cache()
    assert b.columns == columns and {r.doc_id for r in b.collect()} == {r.doc_id for r in simhash_dedup.cluster(a).where("doc_id = component_id").collect()}
    c = corpus_pipeline.redact_secrets(spark, b, SF).cache()
    assert c.columns == columns and c.count() == b.count() and all(not r.base for r in secret_scan.scan(c).collect())
    d = corpus_pipeline.mix_sources(spark, c, SF)
    assert d.columns == columns and 0 < d.count() <= c.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    r = c.sql(registry.ORACLES[name])
    at = [list(r.columns).index(x) for x in columns]
    flat = lambda v: repr(v + 0.0) if isinstance(v, float) else str(v)
    assert sorted(tuple(flat(x[k]) for k in columns) for x in df.collect()) == sorted(tuple(flat(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n.startswith("op") and n not in ("op11_hard_negatives", "op13_source_divergence")))
def test_one_row_a_document_at_least(spark, name):
    docs = tables(spark, SF, "documents")
    out = registry.QUERIES[name](spark, SF)
    assert out.select("doc_id").distinct().count() == docs.count()


def test_near_copies_stage_equals_brute_force(spark):
    docs = tables(spark, SF, "documents")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    words = [t.encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {rows[i][0] for i in range(len(rows)) if find(i) == i}
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(want)
