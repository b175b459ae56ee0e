"""Near-duplicates against brute force over all pairs."""

import itertools
import random
import re

import numpy as np
import pytest

from graftwork.llm import minhash
from graftwork.llm.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def _set(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return frozenset()
    if len(found) < 5:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def _brute(texts):
    sets = {k: _set(v) for k, v in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            u, v = sorted((find(a), find(b)))
            root[v] = u
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


def _got(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}


def test_query(spark):
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    assert _got(QUERIES["op1_minhash_dedup"](spark, SF_DIR).collect()) == _brute(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_near_misses(spark, seed):
    rng = random.Random(seed)
    texts, at = {}, 0
    for _ in range(12):
        own = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 8, 40, 120]))]
        for _ in range(rng.randrange(1, 12)):
            texts[at] = " ".join(own)
            at += rng.randrange(1, 4)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(400)}"
    texts |= {1001: None, 1002: "", 1003: " \t\n", 1004: "One two", 1005: "one  TWO", 1006: "x " * 30_000, 1007: "X " * 40_000}
    df = spark.createDataFrame([(k, v, "s") for k, v in texts.items()], "doc_id long, text string, component_id string")
    assert _got(minhash.near_groups(df).collect()) == _brute(texts)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_groups(df).count() == 0
    assert minhash.drop_near_copies(df).count() == 0


def test_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c")], "doc_id long, text string")
    got = sorted(minhash.near_groups(df).collect(), key=str)
    assert [(r["doc_id"], r["component_id"]) for r in got].count((3, 3)) == 1 and len(got) == 3


def test_short_similar_sets_share_a_key():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(1, 33))
        own = np.unique(rng.integers(0, 2**63, n + 12).astype(np.uint64))
        rng.shuffle(own)
        cut, more = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, 11))
        a, b = np.sort(own[:n]), np.sort(own[cut : n + more])
        both = len(np.intersect1d(a, b))
        if 100 * both >= minhash.PERCENT * (len(a) + len(b) - both):
            assert np.isin(minhash.short_keys(a), minhash.short_keys(b)).any()


def _shingles(text):
    return minhash.shingles(minhash.codes_of(minhash.words(text), minhash.WordCodes()), 5)


def _short_pair(wanted):
    """Texts of seven and eight words, 3 of 4 shingles shared, whose bands and agreeing bins are as wanted."""
    rng, orders = random.Random(3), minhash.probe_orders()
    while True:
        own = [f"w{rng.randrange(10**9)}" for _ in range(8)]
        texts = " ".join(own[:7]), " ".join(own)
        least = [minhash.signature(_shingles(t), orders) for t in texts]
        bands = [minhash.band_keys(x) for x in least]
        shared = bands[0][bands[0] == bands[1]]
        if wanted(len(shared), (least[0].astype(np.uint8) == least[1].astype(np.uint8)).sum()):
            return texts, shared


def test_a_block_links_pairs_with_unlike_signatures(spark):
    texts, shared = _short_pair(lambda bands, bins: bands and bins < 76)
    members = spark.createDataFrame([(int(shared[0]), k, k) for k in (1, 2)], "key long, id long, component long")
    rows = spark.createDataFrame([(1, texts[0]), (2, texts[1])], "id long, text string")
    assert minhash._links_in_blocks(members, rows).count() == 1


def test_short_texts_without_a_common_band(spark):
    texts, _ = _short_pair(lambda bands, bins: not bands)
    own = {1: texts[0], 2: texts[1], 3: "something else entirely"}
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    assert _got(minhash.near_groups(df).collect()) == _brute(own)


def test_dropping_with_repeated_and_null_ids(spark):
    rows = [(7, "a b c"), (7, "d e f"), (5, "d e f"), (9, "d e f"), (None, "x y"), (None, "x y"), (3, "u v"), (3, "u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.drop_near_copies(df).collect()), key=str)
    assert got == [(3, "u v"), (5, "d e f"), (7, "a b c"), (None, "x y")]
