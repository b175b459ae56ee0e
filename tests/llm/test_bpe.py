"""Encoding against the tiktoken library, decoding as a round trip."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from graftwork.llm import bpe
from graftwork.llm.catalog import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None,
    "",
    " ",
    "\n",
    "a  b",
    "a \n b",
    "  leading and trailing  ",
    "tab\t x\r\n y z  w",
    "don't they'll I'm 'sS ''s",
    "ünïcödé ñandú 漢字かな交じり文 🙂🙂 \U0001f468‍\U0001f469",
    "x" * 300 + " " + "ab" * 500,
    "1234567890 3.14 ²Ⅷ ٣٤",
    "<|endoftext|> is text",
    "!!! ??? --- === \x1c\x1f\x85 end",
    "same same same same",
    "same same same same",
]


def test_matches_the_library(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, id string")
    coded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    back = {r["doc_id"]: r for r in bpe.decode(coded, RANKS).collect()}
    assert sorted(back) == list(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        assert np.frombuffer(back[i]["ids"], "<u4").tolist() == library.encode_ordinary(text or ""), repr(text)
        assert bytes(back[i]["bytes"]) == (text or "").encode()


def test_long_text(spark, library):
    text = "".join(chr(97 + (i * i) % 26) for i in range(4_000)) + " wörd, again" * 30_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()
    assert np.frombuffer(row["ids"], "<u4").tolist() == library.encode_ordinary(text)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_query(spark, library):
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    found = QUERIES["op7_byte_bpe"](spark, SF_DIR).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
