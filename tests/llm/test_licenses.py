"""License scans: empty tables and lists, repeated rows, null ids."""

from quillon.llm import licenses


def test_nothing(spark):
    rows = [(1, "Released under the MIT License.", 0.5), (1, "Released under the MIT License.", 0.5), (None, "x Released under the MIT License.", 0.5), (2, None, None), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, containment double")
    assert sorted(((r.doc_id or 0), r.license, r.containment) for r in licenses.scan(docs).collect()) == [(0, "mit", 1.0), (1, "mit", 1.0)]
    assert licenses.scan(docs.limit(0)).collect() == []
    assert licenses.scan(docs, templates=()).collect() == []
