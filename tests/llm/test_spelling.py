"""Spelling variants against a plain version that compares all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graftwork.llm import spelling


def _edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute(counts):
    out = {}
    for word, n in counts.items():
        near = sorted(((-m, other) for other, m in counts.items() if _edit_one(word, other)))
        form = (near[0][1], -near[0][0]) if near and -near[0][0] >= 5 * n else (None, None)
        out[word] = (form[0], n, len(near), form[1])
    rows = []
    for word, (form, n, near, form_n) in out.items():
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((word, form, root, n, near, form_n))
    return sorted(rows)


def _words(rng, letters, many, size):
    found = set()
    while len(found) < many:
        word = "".join(rng.choice(letters) for _ in range(rng.randint(*size)))
        found.add(word)
        k = rng.randrange(len(word))
        found |= {word[:k] + word[k + 1 :], word[:k] + rng.choice(letters) + word[k + 1 :], word[:k] + rng.choice(letters) + word[k:]}
    return sorted(found)


@pytest.mark.parametrize(
    ("letters", "symbols", "comparisons"),
    [("abc", (6, 64), 65_536), ("abcdefghéü", (2, 64), 10), ("ab", (3, 5), 1), ("aé😀ß", (4,), 1), ("abcdef", (2, 2), 0)],
)
def test_variants_against_all_pairs(spark, letters, symbols, comparisons):
    rng = random.Random(len(letters))
    counts = {w: 5 * 5 ** rng.randrange(6) + rng.randrange(3) for w in _words(rng, letters, 150, (1, 9))}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.variants(words, symbols=symbols, comparisons=comparisons).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == _brute(counts)


def test_neighbourhoods_are_whole_and_distinct():
    rng = np.random.default_rng(1)
    for size, symbols in ((1, 2), (2, 3), (5, 2), (7, 4)):
        rows = rng.integers(1, symbols + 1, (20, size)).astype(np.uint64)
        got = {}
        for which, number in spelling.neighbourhood(rows, symbols):
            for a, b in zip(which.tolist(), number.tolist(), strict=True):
                got.setdefault(a, []).append(b)
        for k, row in enumerate(rows.tolist()):
            near = {tuple(row)}
            for i in range(size):
                near.add((*row[:i], *row[i + 1 :]))
                near |= {(*row[:i], c, *row[i + 1 :]) for c in range(1, symbols + 1)}
            near |= {(*row[:i], c, *row[i:]) for i in range(size + 1) for c in range(1, symbols + 1)}
            numbers = [int(spelling.numbers_of(np.array([x], np.uint64).reshape(1, -1))[0]) for x in near]
            assert len(got[k]) == len(near)
            assert sorted(got[k]) == sorted(numbers)


def test_odd_tables(spark):
    text = "Straße STRASSE strasse " * 3 + "x" * 70_000 + " " + "ab×cdé " * 5
    rows = [(1, text, "n"), (1, text, "n"), (None, text, None), (2, None, "n"), (3, "", "n"), (4, "12 34 ,.", "n"), (5, text, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    counts = Counter()
    for doc_id, body, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (body or "").translate(str.maketrans(spelling.UPPER, spelling.LOWER))):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert len(counts) >= 2
    got = spelling.spelling_variants(df).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == _brute(counts)
    assert spelling.spelling_variants(df.limit(0)).collect() == []
    assert spelling.spelling_variants(df.filter("doc_id = 2")).collect() == []


def test_ratio_must_grow(spark):
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)
