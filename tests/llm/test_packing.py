"""Packing against the tokenizer library, and the plan against bounds and brute force."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graftwork.llm import packing
from graftwork.llm.catalog import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.001"


def _check(rows, texts):
    library = Tokenizer.from_file(PATH)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert sorted(pieces) == sorted(texts)
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert all(r["length"] == 1024 for r in mine[1:])
        at = 0
        for r in mine:
            assert r["start"] == at and 1 <= r["length"] <= 1024
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return len(sequences), -(-sum(r["length"] for r in rows) // 1024)


def test_query(spark):
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    used, least = _check(QUERIES["op8_best_fit_packing"](spark, SF_DIR).collect(), texts)
    assert used <= least * 1.01 + 2


def test_odd_texts(spark):
    texts = {1: None, 2: "", 3: " ", 4: "a \n b  c ", 5: "wörd " * 3000, 6: "<|endoftext|>", 7: "x" * 5000, 8: "", 9: "éa\r\n\n z",
             10: "a\nb c.\nd", 11: "\nx y", 12: " x\ny ", 13: "x\n", 14: "a\u00a0b\tc", 15: "it's 'quoted' don't 's. x'", 16: "a\n b", 17: "ªº ßſ Ǆ ɐ 42% <b>x</b>"}
    df = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, piece int")
    _check(packing.pack(df, PATH).collect(), texts)
    assert packing.pack(df.limit(0), PATH).count() == 0


def _fewest(sizes, capacity):
    """Smallest number of bins, by trying all assignments."""
    for bins in range(1, len(sizes) + 1):
        for where in itertools.product(range(bins), repeat=len(sizes)):
            loads = np.bincount(where, weights=sizes, minlength=bins)
            if loads.max() <= capacity:
                return bins
    return 0


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_near_the_best(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 21, 6)
    plan = packing.plan_bins(np.bincount(sizes, minlength=21), 20)
    got = Counter_of(plan)
    assert got == {int(k): int((sizes == k).sum()) for k in set(sizes.tolist())}
    assert sum(n for _, n in plan) <= _fewest(sizes, 20) + 1


def Counter_of(plan):
    got = {}
    for pattern, times in plan:
        assert sum(a * b for a, b in pattern) <= 20
        for length, copies in pattern:
            got[length] = got.get(length, 0) + copies * times
    return got


def test_large_histogram_reaches_the_bound():
    rng = np.random.default_rng(5)
    counts = np.bincount(np.minimum(rng.geometric(1 / 400, 200_000), 1024), minlength=1025)
    plan = packing.plan_bins(counts, 1024)
    least = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert sum(n for _, n in plan) <= least * 1.001 + 1


def test_added_tokens_have_their_ids(spark, tmp_path):
    library = Tokenizer.from_file(PATH)  # added tokens are emitted by default
    texts = {1: "a<|endoftext|> b", 2: "<|endoftext|>", 3: "x <|endoftext|><|endoftext|>", 4: "plain", 5: None, 6: " <|endoftext|>\n y"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in QUERIES["op8_best_fit_packing"](spark, str(tmp_path)).collect()}
    for k, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[k]["length"], rows[k]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_every_kind_of_word(spark):
    """Words, marks and white space in all combinations against the library."""
    rng = np.random.default_rng(3)
    parts = ["the", "Étions", "weiß", "naïve", "###", ".", ",", "'s", "don't", "'", "42", "x1", "日本", "\n", "\n\n", " ", "  ", "\t", "<|endoftext|>", "ab-cd", "_", "[x]"]
    texts = {k: "".join(rng.choice(parts, rng.integers(1, 30))) for k in range(400)}
    texts |= {1000 + k: " ".join(rng.choice(parts, rng.integers(1, 30))) for k in range(400)}
    _check(packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH).collect(), texts)


def test_words_are_forgotten_within_bounds():
    library = Tokenizer.from_file(PATH)
    merger = packing.WordMerger.of_file(open(PATH, encoding="utf-8").read())
    encoder = packing.TextEncoder(packing.ChunkIds(library, merger), list, most=2_000)
    rng = np.random.default_rng(1)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(20)) for _ in range(5)]
        got = encoder(texts)
        assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.known.size < 60_000
