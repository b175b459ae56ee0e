"""Neighbours against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from graftwork.llm import neighbours
from graftwork.llm.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def _good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def _brute(vectors, asks, k=5):
    good = {i: np.array(v, float) for i, v in vectors.items() if _good(v)}
    out = {}
    for q in filter(asks, good):
        near = []
        for i, v in good.items():
            if i != q and len(v) == len(good[q]):
                near.append((-float(v @ good[q]) / (np.linalg.norm(v) * np.linalg.norm(good[q])), i))
        out[q] = sorted(near)[:k]
    return out


def _compare(rows, truth, k=5):
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q, near in truth.items():
        mine = sorted(got.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len(mine) <= k
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        assert all(r["vec_id"] != q for r in mine)
        known = {i: -s for s, i in near}
        for r in mine:
            if r["vec_id"] in known:
                assert abs(r["score"] - known[r["vec_id"]]) < 1e-12
                hits += 1
        total += len(near)
    assert set(got) <= set(truth)
    return hits / max(1, total)


def test_query_recall(spark):
    vectors = dict(spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect())
    recall = _compare(QUERIES["op9_multiprobe_neighbours"](spark, SF_DIR).collect(), _brute(vectors, lambda i: i % 50 == 0))
    assert recall >= 0.9


def test_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    same = [1.0, 2.0, 0.5]
    vectors = {i: same for i in range(0, 40, 2)} | {i: rng.normal(size=3).tolist() for i in range(41, 90)}
    vectors |= {100: None, 101: [0.0, 0.0, 0.0], 102: [1.0, None, 2.0], 103: [1.0, float("nan"), 0.0], 104: [float("inf"), 1.0, 1.0], 105: [1.0, 2.0], 110: []}
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors.items()], "vec_id long, embedding array<double>, rank int")
    rows = neighbours.nearest(df, F.col("vec_id") % 10 == 0).collect()
    truth = _brute(vectors, lambda i: i % 10 == 0)
    truth = {q: near for q, near in truth.items() if near}
    assert _compare(rows, truth) >= 0.9
    mine = sorted((r["rank"], r["vec_id"], round(r["score"], 9)) for r in rows if r["query_id"] == 0)
    assert mine == [(k + 1, 2 * k + 2, 1.0) for k in range(5)]


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    (row,) = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert (row["query_id"], row["rank"], row["vec_id"]) == (0, 1, 3)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    rows += [rows[0], rows[0], rows[3], (0, [-x for x in rows[0][1]]), (7, rows[9][1]), (None, rows[2][1])]
    df = spark.createDataFrame([(*r, 2.5, i) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, score double, query_id int")
    got = neighbours.nearest(df, F.col("vec_id") % 10 == 0).collect()
    entries = sorted({(i, tuple(v)) for i, v in rows if i is not None})
    truth = []
    for q in (e for e in entries if e[0] % 10 == 0):
        near = [(-float(np.dot(q[1], v) / np.linalg.norm(q[1]) / np.linalg.norm(v)), i) for i, v in entries if (i, v) != q]
        truth += [(q[0], k + 1, i, round(-s, 9)) for k, (s, i) in enumerate(sorted(near)[:5])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(truth)


def test_one_bucket_where_probes_do_not_reach(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_PROBES", 1)
    monkeypatch.setattr(neighbours, "TARGET", 1.0)
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=6).tolist() for i in range(200)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    rows = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert _compare(rows, _brute(vectors, lambda i: i % 50 == 0)) == 1.0
