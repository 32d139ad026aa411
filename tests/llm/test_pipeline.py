"""The pipeline's stages against plain versions of their decisions, and the registered queries."""
import collections

import corpus_pipeline
import __spark_entry__ as E
from logweave.llm import language_id, minhash_dedup, quality_qda, secret_scan
from logweave.llm.tables import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "MinHash near-dedup",
                                                      "secret scans", "best-fit packing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF))
        after[name] = docs
        if name != "best-fit packing":
            assert docs.columns == columns
        if name == "language ID":
            found = language_id.identify_languages(before).collect()
            assert ids(docs) == {r.doc_id for r in found if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE}
        if name == "quality classifier":
            found = quality_qda.quality_scores(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert ids(docs) == {r.doc_id for r in found if r.predicted == 1}
        if name == "MinHash near-dedup":
            found = minhash_dedup.near_duplicates(before, shingle_words=5).collect()
            assert ids(docs) == {r.component_id for r in found} and len(ids(docs)) < before.count()
        if name == "secret scans":
            assert ids(docs) == ids(before)
            left = secret_scan.span_digest(secret_scan.secret_spans(docs)).filter("n_access + n_hex > 0")
            assert left.count() == 0
    fill = collections.Counter()
    for r in docs.collect():
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and ids(docs) == ids(after["secret scans"])


def test_awkward_rows(spark):
    """Null and repeated ids, null texts and extra columns of any name pass through every filtering stage; of copies one row stays."""
    plain, other = "plain words of text here and there " * 9, "some other words of a plain text " * 9
    docs = spark.createDataFrame([(None, plain, "en", "a", 1), (None, plain, "en", "b", 1), (1, None, None, None, None),
                                  (2, other, "en", "b", 2), (2, other, "en", "b", 2), (None, other, "en", "c", 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long") \
        .selectExpr("*", "1 AS _gone", "2 AS id", "3 AS key", "4 AS _doc")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[2:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, plain), (2, other)]


def test_registered():
    names = E.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
