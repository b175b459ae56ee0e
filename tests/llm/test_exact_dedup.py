"""Exact groups by hand, with colliding hashes too."""

import hashlib

from pyspark.sql import functions as F

from graftwork.llm import exact_dedup


def _rows(spark, keep):
    texts = {1: "a", 2: None, 3: "", 4: "a", 5: "A", 6: "a ", 7: "ü" * 50_000, 8: "ü" * 50_000, 9: "a"}
    df = spark.createDataFrame([(k, v, -k, "h") for k, v in texts.items()], "doc_id long, text string, keep_id long, h string")
    return texts, {r["doc_id"]: r for r in exact_dedup.exact_groups(df, keep=keep).collect()}


def _check(texts, got, best):
    groups = {}
    for k, v in texts.items():
        groups.setdefault(v or "", []).append(k)
    assert sorted(got) == sorted(texts)
    for k, v in texts.items():
        own = groups[v or ""]
        r = got[k]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best(own), len(own), k == best(own))
        assert r["text_sha256"] == hashlib.sha256((v or "").encode()).hexdigest()


def test_groups(spark):
    _check(*_rows(spark, exact_dedup.LARGEST), max)
    _check(*_rows(spark, exact_dedup.SMALLEST), min)


def test_colliding_hashes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "content_hash", lambda text: F.substring(F.sha2(text, 256), 1, 1))
    _check(*_rows(spark, exact_dedup.LARGEST), max)


def test_drop_copies(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 7), (4, None, 8), (5, "", 9)], "doc_id long, text string, kept int")
    assert sorted(r["kept"] for r in exact_dedup.drop_copies(df).collect()) == [5, 7, 8]
    assert sorted(r["kept"] for r in exact_dedup.drop_copies(df, keep=exact_dedup.LARGEST).collect()) == [6, 7, 9]
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(7, "A"), (7, "B"), (9, "B"), (3, "C"), (3, "C"), (None, "D"), (None, "D"), (None, "C")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in (exact_dedup.SMALLEST, exact_dedup.LARGEST):
        got = [tuple(r) for r in exact_dedup.drop_copies(df, keep=keep).collect()]
        assert sorted(t for _, t in got) == ["A", "B", "C", "D"]
        assert set(got) == {(7, "A"), (7 if keep == exact_dedup.SMALLEST else 9, "B"), (3, "C"), (None, "D")}
