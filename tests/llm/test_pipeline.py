"""The corpus pipeline: what each stage keeps, and its result on awkward rows."""

import corpus_pipeline
from loreline.llm.common import stored, table
from tests.llm.awkward import DOCUMENTS, write_tables

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items()
        if name == "exact_dedup":
            last = {}
            for i, text in before.items():
                last[text] = max(i, last.get(text, i))
            assert set(after) == set(last.values())
        before = after
    assert corpus_pipeline.run(spark, SF_DIR).count() == docs.count()


def test_awkward_rows(spark, tmp_path):
    write_tables(spark, tmp_path, DOCUMENTS)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {d[0] for d in DOCUMENTS}
    assert all(r.n_tokens == len(r.ids) for r in out)


def test_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, [], empty=True)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
