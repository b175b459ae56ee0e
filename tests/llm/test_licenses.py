"""License scans against a plain version on generated texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graftwork.llm import licenses
from graftwork.llm.licenses import TEMPLATES, Template


def _brute(text, templates, share):
    words = re.findall(licenses.WORD, (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    starts, base, labels, score = [], set(), set(), 0.0
    for t in templates:
        if t.phrase:
            own = [k for k in range(len(words)) if words[k : k + len(t.words)] == t.words]
            starts += own
            if own:
                base.add(t.label)
                score = 1.0
            continue
        for begin in range(0, len(words), t.step):
            held = len(set(words[begin : begin + 2 * t.step]) & set(t.words))
            if 100 * held >= share * t.size:
                labels.add(t.label)
                score = max(score, held / t.size)
    ends = (min(starts), max(starts)) if starts else (None, None)
    return (len(words), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(base | labels)), score)


def _check(spark, texts, templates=TEMPLATES, share=licenses.SHARE):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(df, templates=templates, share=share).collect()}
    for k, text in enumerate(texts):
        assert got[k] == _brute(text, templates, share), text
    assert len(got) == len(texts)
    return got


def _text(rng, templates):
    parts = []
    for _ in range(rng.randrange(6)):
        words = list(rng.choice(templates).words)
        if rng.random() < 0.6:
            words = [w for w in words if rng.random() < 0.85]
        if rng.random() < 0.3:
            rng.shuffle(words)
        parts += [w.upper() if rng.random() < 0.2 else w for w in words]
        parts += [rng.choice("the of mit license by über 42".split()) for _ in range(rng.randrange(25))]
    return rng.choice([" ", ", ", "\n", "-"]).join(parts)


def test_templates(spark):
    rng = random.Random(4)
    texts = [_text(rng, TEMPLATES) for _ in range(150)] + [" ".join(t.words) for t in TEMPLATES]
    got = _check(spark, texts)
    assert all(t.label in got[150 + k][5].split(",") for k, t in enumerate(TEMPLATES))


@pytest.mark.parametrize("share", [1, 34, 67, 100])
def test_small_vocabulary(spark, share):
    rng = random.Random(share)
    templates = [
        Template("p", "a b a", phrase=True), Template("q", "b", phrase=True), Template("r", "a a", phrase=True),
        Template("n", "a b c d e f"), Template("m", "c d"), Template("o", " ".join("abcdefgh") + " i j k l"),
    ]
    texts = [" ".join(rng.choice("abcdefghijklxyz") for _ in range(rng.randrange(60))) for _ in range(120)]
    _check(spark, texts, templates, share)


def test_odd_tables(spark):
    long = "x " * 60_000 + "Released under the MIT License. " * 500
    rows = [(1, None), (1, "CC-BY"), (1, "CC-BY"), (None, "apache license"), (2, ""), (3, " ..\x00"), (4, long), (None, None)]
    df = spark.createDataFrame([(k, t, "w", 7) for k, t in rows], "doc_id long, text string, word string, uid int")
    got = sorted((tuple(r) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted(((k, *_brute(t, TEMPLATES, licenses.SHARE)) for k, t in rows), key=str)
    assert licenses.scan(df.limit(0)).collect() == []


def test_no_python_workers(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("mit license").alias("text"))
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "InArrow", "InPandas", "ExistingRDD"))
