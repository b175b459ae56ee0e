"""The language model: exact counts and base scores, a proper distribution, and held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graftwork.llm import maxent
from graftwork.llm.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def _tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def _check(rows, texts):
    split = {k: _tokens(v) for k, v in texts.items()}
    out = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    c = Counter(t for k, own in split.items() if not out[k] for t in own)
    n, v = sum(c.values()), len(c)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        own = split[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out[r["doc_id"]], len(own), n)
        assert r["n_known"] == sum(c[t] > 0 for t in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own))
        assert r["score"] <= 1e-9


def test_query(spark):
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op5_maxent_scores"](spark, SF_DIR).collect()
    _check(rows, texts)
    held = [r for r in rows if r["held_out"]]
    base, own = (sum(r[c] for r in held) / sum(r["n_tokens"] for r in held) for c in ("base_score", "score"))
    print("log10 a token:", base, own)
    assert own > base + 0.2


def test_odd_texts(spark):
    texts = {i: t for i, t in enumerate([None, "", " ", "A b a B", "A b a B", "ünï\x0b漢字 🙂", "w " * 100_000])}
    df = spark.createDataFrame([(k, v, 1.0) for k, v in texts.items()], "doc_id long, text string, score double")
    _check(maxent.score(df).collect(), texts)
    assert maxent.score(df.limit(0)).count() == 0


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, maxent.END_CLASS, maxent.ENDINGS + 1).astype(np.int32)
    weights = rng.normal(size=(maxent.WEIGHT_ROWS, maxent.CLASSES)).astype(np.float32)
    t = maxent.Texts.of(["a bc def", "", "x " * 50], maxent.Lexemes())
    logs = maxent.log_classes(maxent.features(t, classes), weights)
    assert np.allclose(np.exp(logs).sum(1), 1, atol=1e-5)
    assert t.length.tolist() == [4, 1, 51]
    assert t.before(np.arange(len(t.code)), 1, -1)[[0, 1, 4, 5]].tolist() == [-1, 0, -1, -1]


def test_updates_lower_the_loss():
    texts = ["the cat sat on the mat and the dog sat on the log"] * 30
    t = maxent.Texts.of(texts, maxent.Lexemes())
    classes = (np.arange(maxent.ENDINGS + 1) % maxent.END_CLASS).astype(np.int32)
    classes[-1] = maxent.END_CLASS
    weights, losses = np.zeros((maxent.WEIGHT_ROWS, maxent.CLASSES), np.float32), []
    for _ in range(5):
        observed = np.zeros((maxent.WEIGHT_ROWS, maxent.CLASSES), np.int64)
        expected = np.zeros((maxent.WEIGHT_ROWS, maxent.CLASSES), np.float32)
        losses.append(maxent.gradient(t, classes, weights, observed, expected))
        assert observed.sum() == pytest.approx(maxent.ACTIVE * len(t.code)) and expected.sum() == pytest.approx(maxent.ACTIVE * len(t.code), rel=1e-4)
        weights += (maxent.STEP / maxent.ACTIVE * np.log((observed + 1) / (expected + 1))).astype(np.float32)
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.5 * losses[0]


def test_the_ending_two_words_back_is_a_feature():
    assert (maxent.ENDINGS, maxent.LAST, maxent.SKIP, maxent.ROUNDS, maxent.WEIGHT_ROWS) == (512, 8192, 4096, 4, 14406)
    classes = np.zeros(maxent.ENDINGS + 1, np.int32)
    code, at, length = np.full(3, 7, np.uint64), np.array([0]), np.array([3])
    one, other = (maxent.features(maxent.Texts(code, np.array([k, 9, 9], np.int32), at, length), classes)[:, 2] for k in (3, 4))
    assert (one != other).sum() == 1
