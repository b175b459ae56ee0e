"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded texts.

Texts are folded first: look-alike letters of other scripts, digits that stand
for letters, accents and case. The lexicon holds folded words and word stems
with their log odds, learnt from labelled rows; phrases in which a term is
harmless take its weight back. Weights found in a text, normalised by its
length, go through a logistic curve fitted on the same rows.

Learning uses at most ``TOXIC_ROWS`` + ``CLEAN_ROWS`` labelled rows (a stated
bound, chosen by a hash of the id); scoring reads every text whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import stored, table
from graftwork.llm.registry import query

TOXIC_ROWS, CLEAN_ROWS = 5_000, 15_000
MAX_TERMS, MAX_PHRASES = 4_000, 1_000
STEMS = range(3, 9)
MIN_SHARE, MIN_ROWS, MIN_Z, MIN_ODDS = 0.003, 3, 5.0, 2.0
PHRASE_ROWS = 3

# Letters of other scripts that look like Latin ones, and digits used as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SYMBOLS = {"@": "a", "$": "s"}

SYMBOL = re.compile(r"[@$](?=[^\W\d_])")


class Folding(dict):
    """Translation table: what each character is folded to; other signs part words."""

    def __missing__(self, point: int) -> str:
        out = []
        for sign in unicodedata.normalize("NFKD", chr(point)).casefold():
            sign = LOOKALIKES.get(sign, DIGITS.get(sign, sign))
            if sign.isalpha():
                # l and i are the same letter here: the digit 1 is written for both.
                out.append("i" if sign == "l" else sign)
        value = self[point] = "".join(out) or ("" if unicodedata.combining(chr(point)) else " ")
        return value


def fold(text: str | None, table: Folding) -> str:
    """Folded words of a text, each with one space on either side."""
    text = text or ""
    if "@" in text or "$" in text:
        text = SYMBOL.sub(lambda m: SYMBOLS[m[0]], text)
    return " " + " ".join(text.translate(table).split()) + " "


def terms(folded: str) -> set[str]:
    """Words and word stems of a folded text, as patterns."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update([f" {word[:k]}" for k in STEMS if k <= len(word)])
    return out


@dataclass
class Lexicon:
    """Patterns of folded text with weights, and the curve that makes a score of them."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-3.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, weight in [*self.weights.items(), *self.exceptions.items()]:
            found.add_word(pattern, (pattern, weight))
        if len(found):
            found.make_automaton()
        return found


def measures(folded: str, automaton) -> tuple[float, float]:
    """Damped weights of a text: of its distinct terms, and of all its terms per hundred words."""
    hits = [hit for _, hit in automaton.iter(folded)] if len(automaton) else []
    distinct, every = sum(weight for _, weight in set(hits)), sum(weight for _, weight in hits)
    words = folded.count(" ") - 1
    return math.log1p(max(0.0, distinct)), math.log1p(100.0 * max(0.0, every) / (words + 20))


def _mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` gets the (text, toxic) rows of a task and gives tuples of ``schema``."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(batch.column("text"), batch.column("toxic"), strict=True)

        found = list(fn((text.as_py(), toxic.as_py()) for text, toxic in rows()))
        columns = list(zip(*found, strict=True)) or [[] for _ in names]
        yield pa.RecordBatch.from_pydict(dict(zip(names, columns, strict=True))) if found else _nothing(names, schema)

    return df.select("text", "toxic").mapInArrow(run, schema)


def _nothing(names: list[str], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    types = [kinds[c.strip().split(" ")[1]] for c in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)


def _log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int) -> tuple[float, float]:
    """Log odds of a term, and how many deviations its share differs by."""
    share = (toxic + clean) / (n_toxic + n_clean)
    spread = math.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean)) or 1e-9
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    return odds, (toxic / n_toxic - clean / n_clean) / spread


def _chosen(found: dict[str, tuple[float, float]]) -> dict[str, float]:
    """The strongest terms; a longer one only where it says more than its stems."""
    kept: dict[str, float] = {}
    strength: dict[str, float] = {}
    good = {t: (odds, z) for t, (odds, z) in found.items() if z >= MIN_Z and odds >= MIN_ODDS}
    for term in sorted(good, key=lambda t: (len(t), t)):
        odds, z = good[term]
        stems = [term[:k] for k in range(2, len(term)) if term[:k] in strength]
        if any(strength[s] >= z and kept[s] >= odds - 0.5 for s in stems):
            continue
        kept[term], strength[term] = odds, z
    best = sorted(kept, key=lambda t: (-strength[t], t))[:MAX_TERMS]
    return {t: kept[t] for t in best}


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small penalty, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (w * (p - y)) + 1e-2 * b
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b)), gradient)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b.tolist())


def learn(labelled: DataFrame, totals: dict[int, int] | None = None) -> Lexicon:
    """A lexicon from ``id, text, toxic`` rows; rows whose label is not 0 or 1 are ignored.

    ``totals`` are the numbers of rows of either label that the rows were drawn
    from; the curve is fitted as if all of them were here. Without rows of both
    labels the lexicon is empty and every score is low.
    """
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    sc = labelled.sparkSession.sparkContext
    toxic_rows, clean_rows = labelled.filter("toxic = 1"), labelled.filter("toxic = 0")

    def own_terms(rows):
        table, seen = Folding(), Counter()
        for text, _ in rows:
            seen.update(terms(fold(text, table)))
        return seen.items()

    # A text has a bounded number of words of a given share, so the candidates are bounded by the share.
    support = max(MIN_ROWS, math.ceil(MIN_SHARE * n_toxic))
    seen = _mapped(toxic_rows, own_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    in_toxic = {r["term"]: r["n"] for r in seen.filter(F.col("n") >= support).collect()}
    wanted = sc.broadcast(set(in_toxic))

    def wanted_terms(rows):
        table, counts = Folding(), Counter()
        for text, _ in rows:
            counts.update(terms(fold(text, table)) & wanted.value)
        return counts.items()

    seen = _mapped(clean_rows, wanted_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    in_clean = {r["term"]: r["n"] for r in seen.collect()}
    weights = _chosen({t: _log_odds(n, in_clean.get(t, 0), n_toxic, n_clean) for t, n in in_toxic.items()})
    lexicon = Lexicon(weights, _exceptions(labelled, Lexicon(weights)))
    shared = sc.broadcast(lexicon)

    def measured(rows):
        table, automaton = Folding(), shared.value.automaton()
        return [(int(toxic), *measures(fold(text, table), automaton)) for text, toxic in rows]

    points = _mapped(labelled.filter("toxic IN (0, 1)"), measured, "toxic long, total double, share double").toArrow()
    y = points.column("toxic").to_numpy().astype(float)
    x = np.column_stack([points.column("total").to_numpy(), points.column("share").to_numpy()])
    drawn = {1: n_toxic, 0: n_clean}
    share = {k: max((totals or drawn).get(k, 0), n) / n for k, n in drawn.items()}
    lexicon.curve = _curve(x, y, np.where(y == 1, share[1], share[0]))
    return lexicon


def _exceptions(labelled: DataFrame, lexicon: Lexicon) -> dict[str, float]:
    """Two-word phrases with a term that several clean rows hold and no toxic one."""
    shared = labelled.sparkSession.sparkContext.broadcast(lexicon)

    def phrases(rows):
        table, automaton, seen = Folding(), shared.value.automaton(), Counter()
        for text, toxic in rows:
            words = fold(text, table)
            own = set()
            for end, _ in automaton.iter(words) if len(automaton) else ():
                start = words.rfind(" ", 0, end)
                stop = words.find(" ", end if words[end] == " " and end > start + 1 else end + 1)
                start = words.rfind(" ", 0, stop)
                after = words.find(" ", stop + 1)
                if after > 0:
                    own.add(words[start : after + 1])
                if start > 0:
                    own.add(words[words.rfind(" ", 0, start) : stop + 1])
            seen.update((phrase, int(toxic)) for phrase in own)
        return [(phrase, toxic, n) for (phrase, toxic), n in seen.items()]

    rows = _mapped(labelled.filter("toxic IN (0, 1)"), phrases, "phrase string, toxic long, n long")
    clean = (
        rows.groupBy("phrase")
        .agg(F.sum(F.col("n") * (1 - F.col("toxic"))).alias("clean"), F.max("toxic").alias("toxic"))
        .filter((F.col("clean") >= PHRASE_ROWS) & (F.col("toxic") == 0))
        .orderBy(F.desc("clean"), "phrase")
        .limit(MAX_PHRASES)
    )
    automaton, out = lexicon.automaton(), {}
    for row in clean.collect():
        out[row["phrase"]] = -sum(weight for _, (_, weight) in automaton.iter(row["phrase"]))
    return out


def _points(texts: pa.Array, table: Folding, automaton, curve: tuple[float, ...]) -> np.ndarray:
    base, *slopes = curve
    found = [measures(fold(t.as_py(), table), automaton) for t in texts]
    logit = np.array(found, float).reshape(-1, 2) @ np.array(slopes) + base
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def score(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row; null and empty texts score as texts without terms.

    Rows are scored one by one, so repeated ones and null ids stay as they are;
    other columns are ignored. An empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, automaton = Folding(), shared.value.automaton()
        for batch in batches:
            points = _points(batch.column("text"), table, automaton, shared.value.curve)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(points, pa.float64())], ["id", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, lexicon: Lexicon, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score under ``limit``, with all their columns, in one pass without a join."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, automaton = Folding(), shared.value.automaton()
        for batch in batches:
            points = _points(batch.column(text_col), table, automaton, shared.value.curve)
            yield batch.filter(pa.array(points < limit))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_rows(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``id, text, toxic`` of the bounded sample that is learnt from, and all label counts.

    The chosen ids are at most ``TOXIC_ROWS + CLEAN_ROWS``, so they are broadcast.
    One that was chosen under both labels is toxic.
    """
    known = labels.filter(~held_out() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("id"), "toxic")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(17), "id")
    ids = [
        known.filter(F.col("toxic") == value).orderBy(order, "id").limit(most)
        for value, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))
    ]
    chosen = ids[0].unionByName(ids[1]).groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = documents.select(F.col("doc_id").alias("id"), "text")
    return stored(texts.join(F.broadcast(chosen), "id").select("id", "text", "toxic"), "labelled"), totals


def corpus_lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    return learn(*labelled_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), corpus_lexicon(spark, sf_dir))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
