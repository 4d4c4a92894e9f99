"""The SQL of the operators against the operators, on planted rows: links and chains of vectors, repeated bytes, words and lines."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from folioforge.llm import queries


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(r[k] for k in order) for r in found)


def against(query, spark, folder, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        path = f"{folder}/{name}.parquet"
        frame.write.mode("overwrite").parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    df = queries.QUERIES[query](spark, str(folder))
    found = con.execute(queries.ORACLE_SQL[query])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(columns, found.fetchall())
    return pd.DataFrame(got, columns=sorted(columns))


def test_linked_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 24))
    vectors = [(k, (base[k % 12] + 0.22 * rng.normal(size=24)).tolist(), k % 2) for k in range(160)]
    vectors += [(200, vectors[0][1], 0), (201, vectors[0][1], 1), (202, vectors[0][1], None), (203, None, 0), (204, [0.0] * 24, 0), (205, [float("nan")] + [1.0] * 23, 0)]
    vectors += [(206, [None] + vectors[0][1][1:], 0), (207, [float("inf")] + vectors[0][1][1:], 0), (208, [], 0), (209, vectors[0][1][:12], 0)]
    got = against("op1_embedding_neardup", spark, tmp_path, embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"))
    assert len(got) == len(vectors) and got.n_links.sum() > 400 and got.kept.sum() < 60
    assert (got[got.vec_id > 201].n_links == 0).all() and got[got.vec_id == 200].n_links.item() > 0


@pytest.mark.parametrize("query", ["op2_suffix_dedup", "op5_line_dedup", "op9_substring_dedup"])
def test_repeated_text(query, spark, docs, rows, tmp_path):
    rng = random.Random(8)
    long = [(r[0], r[1]) for r in rows if r[0] is not None]
    shared = "é" * 150 + " ".join(str(rng.randint(0, 10**6)) for _ in range(70))
    long += [(300 + k, " ".join(str(rng.randint(0, 10**6)) for _ in range(30)) + shared[k : 420 + k] + "\n" + shared[:100]) for k in range(5)]
    documents = spark.createDataFrame(list(dict.fromkeys(long)), "doc_id long, text string")
    got = against(query, spark, tmp_path, documents=documents)
    assert len(got) == documents.count() and got.n_removed.sum() > 0 and got[got.doc_id == 50].n_removed.item() == 0
