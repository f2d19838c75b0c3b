"""Language stage of a table without labels."""

from pyspark.sql import functions as F

from vigil.llm import langid


def test_texts_with_letters_stay_when_nothing_is_labelled(edge):
    docs = edge.withColumn("lang", F.lit(None).cast("string"))
    kept = langid.keep_identified(docs, docs)
    assert kept.columns == docs.columns and sorted(str(r[0]) for r in kept.select("doc_id").collect()) == sorted("1 1 1 5 7 8 9 10 None".split())
