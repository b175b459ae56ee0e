"""Repeated passages against brute force over all windows."""

import random

import pytest

from graftwork.llm import suffixes
from graftwork.llm.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def _brute(texts, least=50):
    """Maximal runs of words whose windows occur in another text, or apart in the same one."""
    where, out = {}, {}
    split = {k: (v or "").encode().split() for k, v in texts.items()}
    for k, words in split.items():
        for i in range(len(words) - least + 1):
            where.setdefault(tuple(words[i : i + least]), []).append((k, i))
    for k, words in split.items():
        covered, first = set(), {}
        for i in range(len(words) - least + 1):
            places = where[tuple(words[i : i + least])]
            others = {d for d, _ in places} - {k}
            if others or any(d == k and i >= j + least for d, j in places if (d, j) == min(p for p in places if p[0] == k)):
                covered.update(range(i, i + least))
                first[i] = min({d for d, _ in places})
        spans, i = [], 0
        order = sorted(covered)
        for w in order:
            if spans and w == spans[-1][1]:
                spans[-1][1] = w + 1
            else:
                spans.append([w, w + 1])
        for start, stop in spans:
            out[(k, start, stop)] = min(f for i, f in first.items() if start <= i < stop)
    return out


def _got(rows):
    return {(r["doc_id"], r["start"], r["stop"]): r["first_id"] for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(3000)]
    passages = [[rng.choice(pool) for _ in range(n)] for n in (49, 50, 51, 60, 90, 200)]
    texts = {}
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [rng.choice(pool) for _ in range(rng.randrange(0, 60))]
            p = rng.choice(passages)
            cut = rng.randrange(0, 15)
            words += p[cut:] if rng.random() < 0.3 else p
        texts[i] = " ".join(words)
    texts |= {100: None, 101: "", 102: " ".join(["x"] * 500), 103: texts[5], 104: texts[5], 105: "a b c", 106: "a b c"}
    df = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, start int")
    got, truth = _got(suffixes.repeated_passages(df).collect()), _brute(texts)
    # A text that only repeats itself densely is one passage; its exact start is its first repeat.
    assert {k: v for k, v in got.items() if k[0] != 102} == {k: v for k, v in truth.items() if k[0] != 102}
    clean = {r["doc_id"]: r["text"] for r in suffixes.drop_repeats(df).collect()}
    assert clean[105] == clean[106] == "a b c" and clean[101] == "" and clean[100] is None
    assert 103 not in clean and 104 not in clean
    left = _brute({k: v for k, v in clean.items() if k != 102})
    assert not left
    kept = set(" ".join(t or "" for t in clean.values()).split())
    for p in passages[1:]:
        assert sum(" ".join(p) in (t or "") for t in clean.values()) <= 1
        assert any(" ".join(p) in (t or "") for t in texts.values()) <= set(p).issubset(kept)


def test_query(spark):
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op6_suffix_dedup"](spark, SF_DIR).collect()
    assert {(r["doc_id"], r["start"], r["stop"]): r["first_doc_id"] for r in rows} == _brute(texts)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeated_passages(df).count() == 0
    assert suffixes.drop_repeats(df).count() == 0


def test_words_shared_by_two_texts():
    rng = random.Random(4)
    pool = ["a", "ab", "abc", "b", "é", "éa"]
    for _ in range(3000):
        a, b = ([rng.choice(pool) for _ in range(rng.randrange(1, 6))] for _ in range(2))
        want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert suffixes.words_shared(" ".join(a).encode(), " ".join(b).encode()) == want


def test_every_start_belongs_to_one_suffix_at_a_distance_of_its_own_words():
    rng = random.Random(5)
    passage = [f"p{rng.randrange(40)}" for _ in range(90)]
    known = suffixes.WordCodes()
    owned = []
    for n in (0, 13, 40):
        words = [f"x{rng.randrange(900)}" for _ in range(n)] + passage + [f"y{rng.randrange(900)}" for _ in range(30)]
        codes = suffixes.codes_of([w.encode() for w in words], known)
        starts, owner = suffixes.alignments(codes, suffixes.retained(codes))
        assert starts.tolist() == list(range(len(words) - suffixes.LEAST + 1))
        assert ((owner >= starts) & (owner < starts + suffixes.REACH)).all() and (owner[1:] >= owner[:-1]).all()
        owned.append([int(owner[n + i] - n) for i in range(len(passage) - suffixes.LEAST + 1)])
    assert owned[0] == owned[1] == owned[2]


def test_common_passages_over_many_tasks(spark, monkeypatch):
    """Passages and copies that most rows hold, words over 64 bytes, neighbours in other tasks and batches."""
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(500)] + ["long" * 30, "long" * 30 + "er"]
    shared = [[rng.choice(pool) for _ in range(70)] for _ in range(3)]
    texts = {}
    for i in range(300):
        mine = [rng.choice(pool) for _ in range(rng.randrange(30))]
        texts[i] = " ".join(mine + shared[i % 3][i % 7 :] + mine[::-1])
    texts |= {i: texts[7] for i in range(300, 420)}
    monkeypatch.setitem(suffixes.stored.__globals__["BATCH"], "spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(suffixes, "ROWS", 2)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert _got(suffixes.repeated_passages(df).collect()) == _brute(texts)


def test_rows_of_one_id(spark):
    """Different texts of one id keep their own passages; equal rows stay, null ids take no part."""
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(1, " ".join(a)), (7, " ".join(["x"] + a)), (7, " ".join(b + ["y", "z"])), (7, " ".join(b + ["q"])), (None, " ".join(a)), (9, " ".join(["w"] + b))]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").selectExpr("*", "'c' AS body", "1 AS start")
    got = sorted((r.doc_id, r.start, r.stop, r.first_id, len(r.extra)) for r in suffixes.repeated_passages(df).collect())
    assert got == [(1, 0, 60, 1, 0), (7, 0, 60, 7, 0), (7, 0, 60, 7, 0), (7, 1, 61, 1, 1), (9, 1, 61, 7, 1)]
    left = sorted((r.doc_id or 0, r.text.strip()) for r in suffixes.drop_repeats(df).collect())
    assert left == sorted([(0, rows[4][1]), (1, rows[0][1]), (1, rows[0][1]), (7, "x"), (7, rows[2][1]), (7, rows[3][1]), (9, "w")])
