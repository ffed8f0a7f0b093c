import zlib

from conftest import SCHEMA, SF

import corpus_pipeline as p
from provend.llm import mixing, secret_scan


def test_stages_on_edge_documents(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in p.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), SCHEMA)
            assert docs.columns == edge_docs.columns, name
        assert p.STAGES[-1][1](spark, docs, SF).columns


def test_run_over_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.identify_language(spark, docs, SF)
    assert kept.count() == docs.count()  # clean documents stay
    one = p.drop_near_duplicates(spark, kept, SF)
    assert 0 < one.count() < kept.count() and one.select("doc_id").distinct().count() == one.count()
    red = p.redact_secrets(spark, one, SF)
    assert red.count() == one.count()
    assert secret_scan.scan(red).where("size(found) > 0").count() == 0
    assert red.where("n_chars <> length(text)").count() == 0
    times = {r["doc_id"]: r["count"] for r in p.mix_sources(spark, red, SF).groupBy("doc_id").count().collect()}
    mix = mixing.Mix(red, block_words=None)
    assert {r["doc_id"]: r["taken"] for r in mix.taken().where("taken > 0").collect()} == {
        r["doc_id"]: times[r["doc_id"]] * r["size"] for r in mix.taken().where("taken > 0").collect()}
    out = p.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == set(times)
    bins = {}
    for r in out:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and sum(n for _, n in b) <= 2048
