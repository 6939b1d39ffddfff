from compare import SF

from docloom.plans import data_queries as D


def test_every_query_vector_with_a_document_near_it_has_a_context(spark):
    near = D.vector_nearest(spark, SF).where("rank <= 3")
    docs = {r.doc_id for r in D.read(spark, SF, "documents").select("doc_id").collect()}
    want = sorted({r.query_id for r in near.collect() if r.vec_id in docs})
    assert sorted(r.query_id for r in D.context_rendering(spark, SF).collect()) == want
