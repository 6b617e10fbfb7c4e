import os

import pytest

import corpus_pipeline
from wareloom.llm import byte_bpe, mixing, quality_classifier, secret_scan, simhash
from wareloom.llm.queries import ORACLES, QUERIES
from wareloom.llm.tables import Scratch, table

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


def test_thirteen_queries_and_five_stages():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and set(ORACLES) <= set(QUERIES)


@here
def test_run_equals_the_stages_one_by_one(spark):
    docs = table(spark, FOLDER, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    net = quality_classifier.fit(docs, table(spark, FOLDER, "labels"))
    kept = {i for i, s in zip(texts, net.scores(texts.values())) if s >= quality_classifier.THRESHOLD}
    groups = {}
    prints = {i: simhash.fingerprint(texts[i]) for i in kept}
    for i in sorted(kept):
        near = [g for g in groups if any(((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 3 for j in groups[g])]
        merged = [i] + [j for g in near for j in groups.pop(g)]
        groups[min(merged)] = merged
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(out) == set(groups)
    ranks = byte_bpe.read_ranks()
    library = byte_bpe.encoding(ranks)
    clean = {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()}
    assert all(list(r.ids) == library.encode_ordinary(clean[i] or "") for i, r in out.items())


@here
def test_stages_keep_the_columns(spark):
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).schema == docs.schema
    assert mixing.mixed(docs).count() == docs.count()


@here
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, name):
    from tools.check import compare

    status, _, note = compare(spark, FOLDER, name, QUERIES, ORACLES)
    assert status == "ok", note


@here
def test_rows_come_in_the_order_of_the_mixture(spark):
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = Scratch(spark, "stages").keep(stage(spark, docs, FOLDER))
    timed = mixing.schedule(docs).select("doc.doc_id", "slot", "place").collect()
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in sorted(timed, key=lambda r: (r.slot, r.place))]
    assert [r.position for r in rows] == sorted({r.position for r in rows})


def test_prefixes_of_the_tokens_keep_the_weights(spark):
    total = sum(mixing.WEIGHTS.values())
    size = {c: 2 * w * mixing.BLOCK for c, w in mixing.WEIGHTS.items()}  # all sources last for two periods
    long = "word " * 9000
    rows = [(i, long if i % 400 == 0 else f"text {i}", c) for i, c in enumerate(c for c, n in size.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    stored = Scratch(spark, "mixed").keep(mixing.mixed(docs))
    out = corpus_pipeline.tokens(spark, stored, FOLDER).collect()
    source = {i: c for i, _, c in rows}
    seen = dict.fromkeys(size, 0)
    assert len(out) == len(rows) and len({r.doc_id for r in out}) == len(rows)
    for n, r in enumerate(out, 1):
        seen[source[r.doc_id]] += 1
        if n % mixing.BLOCK == 0:
            assert all(abs(seen[c] - n * w / total) < mixing.BLOCK for c, w in mixing.WEIGHTS.items())


def test_run_on_empty_tables_and_odd_rows(spark, tmp_path, odd_rows):
    """Without labels nothing is rejected; null ids and texts, repeated rows and clashing columns pass through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    spark.createDataFrame([r[:5] for r in odd_rows], schema).write.parquet(f"{tmp_path}/odd/documents.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert 0 < len(rows) == len({r.doc_id for r in rows}) < len(odd_rows)
