"""Toxicity: folding, exceptions, and accuracy on rows that nothing was learnt from."""

import zlib

from graftwork.llm import toxicity as tox
from graftwork.llm.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.1"


def test_folding():
    table = tox.Folding()
    assert tox.fold("1D10T", table) == tox.fold("idiot", table) == tox.fold("Іdіоt", table)
    assert tox.fold("$tupid ＳＴＵＰＩＤ stüpid", table) == " stupid stupid stupid "
    assert tox.fold("loser!!! l0s3r$$$", table) == " ioser ioser "
    assert tox.fold(None, table) == tox.fold("", table) == "  "


def _rows():
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        text = f"word{i % 7} plain text number {'alpha' if i % 3 else 'beta'} " + ("you trash fool" if toxic else "trash can here" if i % 20 == 1 else "fine")
        rows.append((i, text, int(toxic), "x"))
    return rows


def test_exceptions_and_obfuscation(spark):
    lexicon = tox.learn(spark.createDataFrame(_rows(), "id long, text string, toxic int, score string"))
    assert lexicon.weights and lexicon.exceptions
    texts = [None, "", "the tr4sh f00l speaks", "put it in the trash can here", "plain text", "plain text", "fool " * 50_000]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r["score"] for r in tox.score(df, lexicon).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert got[2] > 0.5 and got[6] > 0.5
    assert max(got[0], got[1], got[3], got[4]) < 0.5 and got[4] == got[5]


def test_without_labels(spark):
    empty = spark.createDataFrame([], "id long, text string, toxic int")
    lexicon = tox.learn(empty)
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert tox.score(df, lexicon).first()["score"] < 0.5
    assert tox.score(df.limit(0), lexicon).count() == 0


def test_held_out_accuracy(spark):
    labels = dict(spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "toxic").collect())
    rows = QUERIES["op4_toxicity"](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    hits = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"] and labels.get(r["doc_id"]) is not None:
            hits.append((r["predicted"], labels[r["doc_id"]]))
    right = sum(a == b for a, b in hits) / len(hits)
    caught = sum(a for a, b in hits if b) / sum(b for _, b in hits)
    print(right, caught, len(hits))
    assert right > 0.97 and caught > 0.85


def test_both_labels_and_repeated_rows(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in ids], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, t) for i in ids for t in ((0, 1) if i % 3 == 0 else (i % 2,))] + [(ids[0], None)], "doc_id long, toxic int")
    rows, _ = tox.labelled_rows(docs, labels)
    assert {r["id"]: r["toxic"] for r in rows.collect()} == {i: 1 if i % 3 == 0 else i % 2 for i in ids}
    lexicon = tox.corpus_lexicon(spark, SF_DIR)
    twice = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, "y")], docs.schema))
    assert tox.score(twice, lexicon).columns == ["doc_id", "score"]
    assert tox.score(twice, lexicon).count() == len(ids) + 4
