"""The archive: records byte for byte, payloads once, and hand-made ties."""

import hashlib

import pytest
from pyspark.sql import functions as F

from graftwork.llm import warc

BIG = "<p>" + "é" * 80


def _pages(spark):
    pages = [(4, "http://a/", BIG), (2, "http://b/\r\nX: 1", BIG), (3, None, BIG), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (9, "u", "WARC/1.1\r\n\r\n" * 20)]
    return spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, payload int")


def test_round_trip(spark, tmp_path):
    df = _pages(spark)
    warc.write_archive(df, str(tmp_path / "a"))
    records = warc.read_archive(spark, str(tmp_path / "a"))
    got = {r["page_id"]: r for r in records.collect()}
    pages = {r["page_id"]: r for r in df.collect()}
    assert sorted(got) == sorted(pages)
    for k, page in pages.items():
        payload = (page["html"] or "").encode()
        assert bytes(got[k]["payload"]) == payload and got[k]["intact"]
        assert got[k]["payload_bytes"] == len(payload)
        assert got[k]["payload_digest"] == hashlib.sha256(payload).hexdigest()
    kinds = {k: (r["record_type"], r["refers_to"]) for k, r in got.items()}
    assert kinds == {2: ("response", None), 3: ("revisit", 2), 4: ("revisit", 2), **{k: ("response", None) for k in (5, 6, 7, 8, 9)}}
    assert got[2]["url"] == "http://b/%0D%0AX: 1" and got[3]["url"] is None
    stored = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    assert stored.count() == stored.select("digest").distinct().count() == 4

    for r in warc.record_bytes(records).collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        assert len(block) == int(fields[b"Content-Length"]) + 4 and block.endswith(b"\r\n\r\n")


def test_damage_is_seen(spark, tmp_path):
    warc.write_archive(_pages(spark), str(tmp_path / "a"))
    payloads = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    broken = payloads.withColumn("payload", F.concat("payload", F.lit("x").cast("binary")))
    broken.write.parquet(str(tmp_path / "b" / "payloads"))
    spark.read.parquet(str(tmp_path / "a" / "records")).write.parquet(str(tmp_path / "b" / "records"))
    assert warc.read_archive(spark, str(tmp_path / "b")).filter("intact").count() == 0


def test_export(spark, tmp_path):
    warc.write_archive(_pages(spark), str(tmp_path / "a"))
    records = warc.read_archive(spark, str(tmp_path / "a"))
    warc.export_warc(records.coalesce(1), str(tmp_path / "w"), compression="none")
    (file,) = (tmp_path / "w").glob("part-*")
    assert file.read_bytes() == b"".join(bytes(r["record"]) for r in warc.record_bytes(records.coalesce(1)).collect())


@pytest.mark.parametrize("rows", [[], [(1, "u", None)]])
def test_small_tables(spark, tmp_path, rows):
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == len(rows)
