"""License scans: text blocks that hold most of a license notice, and whole license phrases.

An exact set-similarity join between blocks of words and templates. Template
words are ordered by their frequency in the corpus, rare ones first. A block
that holds ``need`` words of a template must hold one of the template's
``size - need + 1`` rarest ones (prefix), must have ``need`` template words at
all (length), and must leave room for the rest behind the shared word
(position). What passes is verified on whole word sets. DataFrame functions only.

A block is a window of ``2 * step`` words from every ``step``-th word on, where
``step`` is a power of two and at least the template's number of words, so every
place where a template could stand lies in a block. Phrases are templates whose
words must all be there; their places are then verified word by word.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import stored, table
from graftwork.llm.registry import query

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_STEP = 8
SHARE = 80  # percent of a notice's distinct words


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split(" ")

    @property
    def size(self) -> int:
        return len(set(self.words))

    @property
    def step(self) -> int:
        return max(LEAST_STEP, 1 << (len(self.words) - 1).bit_length())

    def need(self, share: int) -> int:
        """Distinct words that a block must hold."""
        return self.size if self.phrase else -(-share * self.size // 100)


PHRASES = (
    Template("gpl", "gnu general public license", phrase=True),
    Template("apache", "apache license", phrase=True),
    Template("cc-by", "cc by", phrase=True),
    Template("mit", "mit license", phrase=True),
)
# The usual short notices, lower-cased, punctuation left out.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-4.0", "licensed under cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
)
TEMPLATES = PHRASES + NOTICES


def _rows(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Literal rows; as many as the templates have words."""
    made = [F.struct(*[F.lit(v).alias(c) for c, v in row.items()]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: Sequence[Template] = TEMPLATES, share: int = SHARE,
) -> DataFrame:
    """One row per input row: ``id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts all places of phrases, ``first_word`` and ``last_word``
    are their smallest and largest start, ``base_labels`` their labels;
    ``labels`` has those of notices too. ``score`` is the largest share of a
    template's words that one block holds, among what was found, else 0.
    ``templates`` have distinct texts of lower-case words; their words and
    counts are driver-sized. Null and empty texts have no words. Rows stay
    apart, whatever their ids; other columns are ignored.
    """
    spark = df.sparkSession
    vocabulary = sorted({w for t in templates for w in t.words})
    texts = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    hit = F.transform("words", lambda w, at: F.when(w.isin(vocabulary), F.struct(at.alias("at"), w.alias("word"))))
    docs = stored(
        texts.select("uid", "id", F.size("words").cast("long").alias("n_words"), F.array_compact(hit).alias("hits")), "words"
    )

    # At most one row per template word reaches the driver.
    often = dict.fromkeys(vocabulary, 0)
    for row in docs.select(F.explode("hits.word").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect():
        often[row["word"]] = row["n"]
    order = sorted(vocabulary, key=lambda w: (often[w], w))
    rank = {w: k for k, w in enumerate(order)}
    steps: dict[str, set[int]] = {w: set() for w in order}
    index, prefixes = [], set()
    for t in templates:
        own, need = sorted({rank[w] for w in t.words}), t.need(share)
        for w in t.words:
            steps[w].add(t.step)
        for place, r in enumerate(own[: t.size - need + 1]):
            prefixes.add(order[r])
            index.append(
                {"step": t.step, "rank": r, "place": place, "need": need, "own": own, "label": t.label,
                 "phrase": t.phrase, "sequence": [rank[w] for w in t.words]}
            )
    tokens = _rows(spark, [{"word": w, "rank": rank[w], "steps": sorted(steps[w])} for w in order])
    index = _rows(spark, index)

    many = len(order)
    seeded = docs.filter(F.exists("hits", lambda x: x["word"].isin(sorted(prefixes)))).select("uid", F.inline("hits"))
    ranked = seeded.join(F.broadcast(tokens), "word").select("uid", "at", "rank", F.explode("steps").alias("step"))
    here = F.expr("at div step")
    in_blocks = ranked.withColumn("block", F.explode(F.filter(F.array(here, here - 1), lambda x: x >= 0)))
    blocks = in_blocks.groupBy("uid", "step", "block").agg(
        F.sort_array(F.collect_set("rank")).alias("ranks"),
        # Place and word as one number.
        F.collect_list(F.col("at").cast("long") * many + F.col("rank")).alias("placed"),
    )
    shared = blocks.select("*", F.size("ranks").alias("size"), F.posexplode("ranks").alias("at", "rank"))
    met = shared.join(F.broadcast(index), ["step", "rank"])
    met = met.filter(
        (F.col("size") >= F.col("need"))
        & (F.col("at") <= F.col("size") - F.col("need"))
        & (F.least(F.size("own") - F.col("place"), F.col("size") - F.col("at")) >= F.col("need"))
    )
    met = met.withColumn("overlap", F.size(F.array_intersect("ranks", "own"))).filter("overlap >= need")
    first, last = F.col("block") * F.col("step") * many, (F.col("block") + 1) * F.col("step") * many

    def stands_at(p: Column) -> Column:
        begin = p - p % many
        whole = F.transform("sequence", lambda r, k: begin + k * many + r)
        return (p >= first) & (p < last) & F.forall(whole, lambda x: F.array_contains("placed", x))

    # A phrase has one prefix word, so each of its blocks comes here once, and a start lies in one block's first half.
    starts = F.transform(F.filter("placed", stands_at), lambda p: F.floor(p / many))
    met = met.withColumn("starts", F.when(F.col("phrase"), starts).otherwise(F.array().cast("array<long>")))
    met = met.filter(~F.col("phrase") | (F.size("starts") > 0))
    found = met.groupBy("uid").agg(
        F.sum(F.size("starts")).alias("n_base"),
        F.min(F.array_min("starts")).alias("first_word"),
        F.max(F.array_max("starts")).alias("last_word"),
        F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base"),
        F.collect_set("label").alias("all"),
        F.max(F.col("overlap") / F.size("own")).alias("score"),
    )
    listed = lambda c: F.coalesce(F.array_join(F.sort_array(c), ","), F.lit(""))
    return docs.select("uid", "id", "n_words").join(found, "uid", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        listed("base").alias("base_labels"), listed("all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _sql(templates: Sequence[Template], share: int) -> str:
    rows = ",\n        ".join(
        f"({k}, '{t.label}', '{t.text}', {t.phrase}, {t.step}, {t.size}, {t.need(share)})" for k, t in enumerate(templates)
    )
    return f"""
WITH templates(id, label, body, phrase, step, size, need) AS (
    VALUES {rows}
),
own AS (SELECT DISTINCT id, unnest(string_split(body, ' ')) AS word FROM templates),
sequences AS (
    SELECT id, len(string_split(body, ' ')) AS m, unnest(string_split(body, ' ')) AS word,
           generate_subscripts(string_split(body, ' '), 1) - 1 AS q
    FROM templates
    WHERE phrase
),
texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents
),
hits AS (
    SELECT doc_id, word, place
    FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM texts)
    WHERE word IN (SELECT word FROM own)
),
places AS (
    SELECT doc_id, id, place - q AS start FROM hits JOIN sequences USING (word) GROUP BY ALL HAVING count(*) = any_value(m)
),
base AS (
    SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
    FROM places JOIN templates USING (id)
    GROUP BY doc_id
),
blocks AS (
    SELECT doc_id, id, word, unnest([place // step, place // step - 1]) AS block
    FROM hits JOIN own USING (word) JOIN templates USING (id)
    WHERE NOT phrase
),
matches AS (
    SELECT doc_id, id, max(overlap) AS overlap
    FROM (SELECT doc_id, id, block, count(DISTINCT word) AS overlap FROM blocks WHERE block >= 0 GROUP BY ALL)
         JOIN templates USING (id)
    WHERE overlap >= need
    GROUP BY ALL
),
found AS (
    SELECT doc_id, label, 1.0::DOUBLE AS score FROM places JOIN templates USING (id)
    UNION ALL
    SELECT doc_id, label, overlap::DOUBLE / size FROM matches JOIN templates USING (id)
),
labelled AS (
    SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM found GROUP BY doc_id
)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM texts t LEFT JOIN base USING (doc_id) LEFT JOIN labelled USING (doc_id)
"""


@query("op13_license_scan", sql=_sql(TEMPLATES, SHARE))
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
