"""The pipeline against a plain version of each stage on the same input."""

import corpus_pipeline
from lagweave.llm import decontaminate, pii, registry, wfst
from lagweave.llm.common import cut
from tests.llm.test_text_operators import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = registry.toxicity_model(spark, SF, docs)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        columns = docs.columns
        docs = cut(stage(spark, docs, SF))
        after = {r.doc_id: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "toxicity":
            assert set(after) == {k for k, r in before.items() if model.score(r.text) < 0.7}
        elif name == "near_duplicates":
            assert set(after) == {c for c, _ in brute_classes({k: r.text for k, r in before.items()}).values()}
        elif name == "decontamination":
            assert not set(after) & {k for k, r in before.items() if any(i in decontaminate.plain(r.text) for i in items)}
        elif name == "pii":
            keyed = pii.Surrogates(registry.PII_KEY)
            assert {k: r.text for k, r in after.items()} == {k: pii.rewrite(r.text, keyed)[0] for k, r in before.items()}
        else:
            m = wfst.Transducer(wfst.read_pieces())
            assert {k: m.decode(r.ids) for k, r in after.items()} == {k: r.text for k, r in before.items()}
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
        assert docs.count() == 0
