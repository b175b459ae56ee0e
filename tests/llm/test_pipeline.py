"""The pipeline against a plain single-machine version of every stage."""

import importlib.util
from pathlib import Path

import corpus_pipeline
from graftwork.llm import suffixes, toxicity
from graftwork.llm.catalog import QUERIES  # noqa: F401

SF_DIR = "/root/testdata/sf0.001"


def _other(name):
    spec = importlib.util.spec_from_file_location(name, Path(__file__).parent / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def _without_repeats(texts, least=50):
    split = {k: (v or "").encode().split() for k, v in texts.items()}
    first = {}
    for k in sorted(split):
        for i in range(len(split[k]) - least + 1):
            first.setdefault(tuple(split[k][i : i + least]), (k, i))
    out = {}
    for k, words in split.items():
        gone = set()
        for i in range(len(words) - least + 1):
            d, j = first[tuple(words[i : i + least])]
            if d != k or i >= j + least:
                gone.update(range(i, i + least))
        ranges = []
        for w in sorted(gone):
            if ranges and ranges[-1][1] == w:
                ranges[-1][1] = w + 1
            else:
                ranges.append([w, w + 1])
        text = suffixes.cut_words(texts[k], ranges) if ranges else texts[k]
        if not ranges or text.strip():
            out[k] = text
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    lexicon = toxicity.corpus_lexicon(spark, SF_DIR)
    folding, automaton = toxicity.Folding(), lexicon.automaton()
    base, *slopes = lexicon.curve
    want = {}
    for k, text in docs.select("doc_id", "text").collect():
        total, share = toxicity.measures(toxicity.fold(text, folding), automaton)
        if base + slopes[0] * total + slopes[1] * share < 0:
            want[k] = text
    steps = [want]
    keep = {text or "": k for k, text in sorted(want.items())}
    steps.append({k: want[k] for k in keep.values()})
    near = _other("test_minhash")._brute(steps[-1])
    steps.append({k: v for k, v in steps[-1].items() if near[k][2]})
    steps.append(_without_repeats(steps[-1]))

    for (name, stage), expected in zip(corpus_pipeline.STAGES, steps, strict=False):
        out = stage(spark, docs, SF_DIR)
        assert out.columns == corpus_pipeline.COLUMNS, name
        rows = out.collect()
        assert {r["doc_id"]: r["text"] for r in rows} == expected, name
        assert len(rows) == len(expected)
        docs = spark.createDataFrame(rows, out.schema)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF_DIR).collect()
    used, least = _other("test_packing")._check(packed, steps[-1])
    assert used <= least * 1.01 + 2
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r[c] for c in key) for r in whole) == sorted(tuple(r[c] for c in key) for r in packed)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same words here", "en", "s", 1), (4, "same words here", "en", "s", 1), (None, "no id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF_DIR)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect()) == [(0, "no id"), (2, ""), (4, "same words here")]
