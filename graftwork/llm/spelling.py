"""Spelling variants: words that are one letter apart, found through a reduced alphabet.

Letters are hashed to a few symbols, so that words become reduced words. Words
one edit apart have reduced words that are equal or one edit apart. Every
reduced word generates its whole one-edit neighbourhood; a join with the reduced
vocabulary keeps the neighbours that exist, and the words behind both are
compared letter by letter.

Neighbourhoods are symmetric, so of a pair of reduced words only the side with
the smaller number ships its row. A pair of reduced words with very many words
behind it is not compared: its words go through a finer alphabet instead, so a
bucket of any size never meets itself word by word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import stored, table
from graftwork.llm.crc_sql import CRC_MACROS, crc32_of
from graftwork.llm.registry import query
from graftwork.llm.words import BASE, mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
DROPPED_ONE_IN = 199
MIN_LETTERS, MIN_COUNT = 6, 5
RATIO = 5
# Alphabets from coarse to fine, and how many comparisons one pair of reduced words may cost before the finer one.
SYMBOLS = (6, 64)
COMPARISONS = 65_536
CELLS = 1_000_000


def word_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
) -> DataFrame:
    """``word, n``: words of all texts with their letter drops, at least ``min_letters`` long and ``min_count`` often.

    A null text has no words; a null id counts as the empty one. Repeated rows count every time.
    """
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    runs = df.select(
        F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run")
    )
    h = F.crc32(F.concat(F.coalesce(F.col("id"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    # A run that is too short stays too short; this drops it before it is hashed.
    runs = runs.filter(F.char_length("run") >= min_letters).select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % DROPPED_ONE_IN == 0, cut).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") >= min_count) & (F.char_length("word") >= min_letters))


# ---------------------------------------------------------------- reduced words


def letters_of(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (from 1) of all words after each other, and the words' lengths."""
    data = "".join(words).encode("utf-32-le")
    points = np.frombuffer(data, "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return mix(points * BASE) % np.uint64(symbols) + np.uint64(1), lengths


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, BASE), out=out[1:])
    return out


def _suffixes(rows: np.ndarray, power: np.ndarray) -> np.ndarray:
    """(words, length + 1) numbers of the ends of words from every position."""
    n, size = rows.shape
    out = np.zeros((n, size + 1), np.uint64)
    out[:, :size] = np.cumsum((rows * power[:size][::-1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    return out


def _number(total: np.ndarray, length: int) -> np.ndarray:
    return mix(total + mix(np.array([length], np.uint64) * BASE)).view(np.int64)


def numbers_of(rows: np.ndarray) -> np.ndarray:
    """A 64-bit number of each row of symbols."""
    return _number(_suffixes(rows, _powers(rows.shape[1]))[:, 0], rows.shape[1])


def neighbourhood(rows: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, number) of every distinct sequence at most one edit from each row of symbols.

    Each is generated once: of equal letters in a row only the first is deleted,
    and no letter is inserted before an equal one.
    """
    n, size = rows.shape
    power = _powers(size + 1)
    ends = _suffixes(rows, power)
    # Numbers of the starts of words, moved to where the rest begins: start * power = whole - end.
    whole = ends[:, :1]
    yield np.arange(n), _number(whole[:, 0], size)
    letters = np.arange(1, symbols + 1, dtype=np.uint64)
    # The start's own number, by Horner's rule.
    start = np.zeros((n, size + 1), np.uint64)
    for k in range(size):
        start[:, k + 1] = start[:, k] * BASE + rows[:, k]
    step = max(1, CELLS // max(1, n * symbols))
    for a in range(0, size + 1, step):
        b = min(a + step, size + 1)
        inner = slice(a, min(b, size))
        if inner.stop > a:
            at = np.arange(a, inner.stop)
            own = rows[:, inner]
            first = np.ones(own.shape, bool)
            first[:, 1:] = own[:, 1:] != own[:, :-1]
            if a:
                first[:, 0] = own[:, 0] != rows[:, a - 1]
            deleted = start[:, at] * power[size - 1 - at] + ends[:, at + 1]
            yield np.nonzero(first)[0], _number(deleted[first], size - 1)
            changed = (start[:, at, None] * BASE + letters) * power[size - 1 - at][None, :, None] + ends[:, at + 1, None]
            other = own[:, :, None] != letters
            yield np.nonzero(other)[0], _number(changed[other], size)
        at = np.arange(a, b)
        grown = (start[:, at, None] * BASE + letters) * power[size - at][None, :, None] + ends[:, at, None]
        following = np.zeros((n, b - a), np.uint64)
        following[:, : inner.stop - a] = rows[:, inner]
        other = following[:, :, None] != letters
        yield np.nonzero(other)[0], _number(grown[other], size + 1)


def _by_length(flat: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their symbols as a matrix), a bounded number of cells at a time."""
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == size)
        step = max(1, CELLS // (16 * (size + 1)))
        for k in range(0, len(mine), step):
            part = mine[k : k + step]
            yield part, flat[starts[part][:, None] + np.arange(size)]


def _reduced(words: DataFrame, symbols: int) -> DataFrame:
    """``words`` with ``code``, the symbols of the reduced word, and its number ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, lengths = letters_of(batch.column("word").to_pylist(), symbols)
            key = np.zeros(batch.num_rows, np.int64)
            for part, rows in _by_length(flat, lengths):
                key[part] = numbers_of(rows)
            offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int64())
            data = pa.py_buffer(flat.astype(np.uint8).tobytes())
            code = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, offsets.buffers()[1], data]).cast(pa.binary())
            cols = [*batch.columns, code, pa.array(key)]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "code", "key"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(run, f"{fields}, code binary, key long")


def _neighbours(reduced: DataFrame, symbols: int) -> DataFrame:
    """``key, other``: pairs of a reduced word and what is at most one edit away, from the smaller number's side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code").to_pylist()
            flat = np.frombuffer(b"".join(codes), np.uint8).astype(np.uint64)
            lengths = np.fromiter(map(len, codes), np.int64, len(codes))
            keys = batch.column("key").to_numpy()
            for part, rows in _by_length(flat, lengths):
                own = keys[part]
                for which, number in neighbourhood(rows, symbols):
                    ship = own[which] <= number
                    if ship.any():
                        cols = [pa.array(own[which[ship]]), pa.array(number[ship])]
                        yield pa.RecordBatch.from_arrays(cols, ["key", "other"])

    return reduced.select("key", "code").mapInArrow(run, "key long, other long")


# ---------------------------------------------------------------- near words


def _one_edit(a: str, b: str) -> Column:
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def near_words(words: DataFrame, symbols: Sequence[int] = SYMBOLS, comparisons: int = COMPARISONS) -> DataFrame:
    """``word, n, other, other_n``: all ordered pairs of words one insertion, deletion or replacement apart.

    ``words`` has distinct ``word`` and ``n``; other columns are ignored. Words
    may hold any characters. ``symbols`` are the sizes of the alphabets; the
    last one compares whatever is left. No words give no pairs.
    """
    found, level, wanted = [], words.select("word", "n", F.lit(0).cast("long").alias("trail")), None
    for k, size in enumerate(symbols):
        level = stored(_reduced(level, size), "reduced")
        known = level.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
        vocabulary = stored(known, "reduced-sizes")
        met = _neighbours(level.select("key", "code").distinct(), size).join(
            vocabulary.select(F.col("key").alias("other"), F.col("m").alias("other_m")), "other"
        )
        met = stored(met.dropDuplicates(["other", "key"]).join(vocabulary, "key"), "reduced-pairs")
        last = k == len(symbols) - 1
        # Both sizes are counts of words; their product is compared as decimals, which cannot overflow.
        light = F.lit(True) if last else F.col("m").cast("decimal(19,0)") * F.col("other_m") <= comparisons
        one = level.select("key", F.col("word").alias("u"), F.col("n").alias("u_n"), F.col("trail").alias("u_trail"))
        two = level.select(F.col("key").alias("other"), F.col("word").alias("v"), F.col("n").alias("v_n"), F.col("trail").alias("v_trail"))
        sides = met.filter(light).select("key", "other").join(one, "key").join(two, "other")
        pairs = sides.filter(((F.col("key") < F.col("other")) | (F.col("u") < F.col("v"))) & _one_edit("u", "v"))
        if wanted is not None:
            low, high = F.least("u_trail", "v_trail").alias("low"), F.greatest("u_trail", "v_trail").alias("high")
            pairs = pairs.withColumns({"low": low, "high": high}).join(wanted, ["low", "high"], "left_semi")
        found.append(stored(pairs.select("u", "u_n", "v", "v_n"), "near-words"))
        if last:
            break
        # Pairs too heavy to compare here: their words meet again under the finer alphabet.
        heavy = stored(met.filter(~light).select(F.col("key").alias("low"), F.col("other").alias("high")), "heavy-pairs")
        if heavy.isEmpty():
            break
        if wanted is not None:
            raise ValueError("two alphabets are enough: symbols has at most two sizes")
        wanted = heavy
        ends = heavy.select(F.col("low").alias("key")).union(heavy.select("high")).distinct()
        level = level.join(ends, "key", "left_semi").select("word", "n", F.col("key").alias("trail"))
    pairs = reduce(DataFrame.unionByName, found)
    both = F.explode(
        F.array(
            F.struct(F.col("u").alias("word"), F.col("u_n").alias("n"), F.col("v").alias("other"), F.col("v_n").alias("other_n")),
            F.struct(F.col("v").alias("word"), F.col("v_n").alias("n"), F.col("u").alias("other"), F.col("u_n").alias("other_n")),
        )
    )
    return pairs.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form`` rows without cycles: every round doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        moved = now.join(after, now["root"] == after["at"], "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        now = stored(moved, "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, symbols: Sequence[int] = SYMBOLS, comparisons: int = COMPARISONS) -> DataFrame:
    """Each word with its form: ``word, form, root, n, n_near, form_n``.

    The form is the near word of largest ``n`` (ties: smallest in code-point
    order) if that is at least ``ratio`` (2 or more) times the word's, else
    null. The root is where forms lead to, the word itself if it has none.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could lead back")
    near = near_words(words, symbols, comparisons)
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    )
    rows = words.select("word", "n").join(best, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    rows = stored(
        rows.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    led = roots(rows.filter("form IS NOT NULL"))
    return rows.join(led, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`variants` of the words of all texts. An empty table gives no rows; other columns are ignored."""
    return variants(stored(word_counts(df, id_col, text_col), "vocabulary"))


OP11_SQL = f"""
WITH RECURSIVE {CRC_MACROS},
found AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents
),
hashed AS (
    SELECT run, n, {crc32_of("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h
    FROM (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL), crc_table
),
words AS (
    SELECT CASE WHEN h % 199 = 0
                THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                ELSE run END AS word,
           sum(n)::BIGINT AS n
    FROM hashed
    GROUP BY 1
    HAVING length(word) >= 6 AND sum(n) >= 5
),
cuts AS (
    SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)
),
near AS (
    SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.rest = b.word
),
ranked AS (
    SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
           row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS place
    FROM near JOIN words w ON w.word = other
),
formed AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
           CASE WHEN other_n >= 5 * w.n THEN other END AS form,
           CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
),
led AS (
    SELECT word, word AS root, form AS further FROM formed
    UNION ALL
    SELECT led.word, led.further, f.form FROM led JOIN formed f ON f.word = led.further
)
SELECT f.word, f.form, led.root, f.n, f.n_near, f.form_n
FROM formed f JOIN led ON led.word = f.word AND led.further IS NULL
"""


@query("op11_spelling_variants", sql=OP11_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
