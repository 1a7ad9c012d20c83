import collections

import corpus_pipeline
from folioscan.llm import queries
from folioscan.llm.common import read_table

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = read_table(spark, SF, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.columns == docs.columns, name
        seen.append(spark.createDataFrame(out.collect(), out.schema))
    sizes = [d.count() for d in seen]
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    good = {r.doc_id for r in read_table(spark, SF, "labels").where("quality = 1").collect()}
    kept = {r.doc_id for r in seen[1].select("doc_id").collect()}
    assert len(good & kept) >= 0.97 * len(good & {r.doc_id for r in docs.select("doc_id").collect()})
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in seen[-1].select("doc_id").collect()}
    fill = collections.Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2


def test_ten_queries_are_registered():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
