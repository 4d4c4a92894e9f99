import corpus_pipeline as P
from folioforge.llm import queries

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, docs):
    columns, frame = docs.columns, docs
    sizes = [docs.count()]
    for _, stage in P.STAGES[:-1]:
        frame = stage(spark, frame, DIR)
        assert frame.columns == columns
        sizes.append(frame.count())
    assert sizes == sorted(sizes, reverse=True)
    ids = {r.doc_id for r in frame.collect()}
    assert not ids & {50, 51, 52, 53, 40, 41} and 3 in ids and 61 in ids
    assert {r.doc_id for r in P.pack(spark, frame, DIR).collect()} == ids


def test_near_copies_keep_one_of_each_group(spark):
    words = [f"word{k}" for k in range(600)]
    near = words[:300].copy()
    near[150] = "changed"
    rows = [(5, " ".join(words[:300])), (6, " ".join(near)), (7, " ".join(words[300:])), (8, None), (9, ""), (7, " ".join(words[300:]))]
    got = P.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), DIR)
    assert sorted(r.doc_id for r in got.collect()) == [5, 7, 8]


def test_queries_run(spark):
    for name, query in queries.QUERIES.items():
        assert query(spark, DIR).count() > 0, name
    assert P.run(spark, DIR).count() > 0
