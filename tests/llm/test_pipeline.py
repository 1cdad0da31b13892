"""The pipeline's stages keep the columns of documents and follow their decisions."""

import corpus_pipeline as C
from lotwise.llm import queries as Q
from lotwise.llm.common import staged, table


def test_stages_follow_one_another(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    cols, labels = docs.columns, table(spark, sf, "labels").toPandas().set_index("doc_id")
    seen = {}
    for name, stage in C.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf), "test_stage")
        assert docs.columns == cols, name
        seen[name] = docs.toPandas()
    ids = {n: set(p.doc_id) for n, p in seen.items()}
    verdict = Q.queries()["op3_quality_rules"](spark, sf).toPandas()
    assert ids["quality rules"] == set(verdict[verdict.kept].doc_id)
    assert ids["line dedup"] <= ids["quality rules"]
    assert ids["minhash near-dedup"] <= ids["line dedup"]
    assert ids["mixing"] <= ids["minhash near-dedup"]
    text = seen["line dedup"].text
    assert not text.duplicated().any()  # equal lines stay in one document only
    last = C.STAGES[-1][1](spark, docs, sf)
    assert last.count() == len(seen["mixing"])
    assert C.run(spark, sf).count() == len(seen["mixing"])
    assert labels.shape[0] > 0
