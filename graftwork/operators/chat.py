"""Multiple-choice rows to chat rows. Every builder adds a ``messages`` column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftwork.functions import fixed
from graftwork.functions.columns import col, is_not

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)


def _text(c: str | Column) -> Column:
    # A missing field prints as the word None inside a prompt.
    return F.coalesce(col(c).cast("string"), F.lit("None"))


def _letters() -> Column:
    return F.array(*[F.lit(x) for x in fixed.LETTERS])


def _question(opening: str, fields: Sequence[tuple[str, str | Column]], choices: Column, closing: str) -> Column:
    parts = [F.lit(opening)]
    parts += [F.concat(F.lit(f"{title}: "), _text(c)) for title, c in fields]
    parts += [F.concat(F.lit("Choices: "), choices), F.lit(closing)]
    return F.concat_ws("\n\n", *parts)


def _chat(question: Column, answer: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("user", question), turn("assistant", answer.cast("string")))


def _numbered(first: int | str, *options: str | Column) -> Column:
    start = ord(str(first))
    lines = [F.concat(F.lit(f"{chr(start + i)}: "), _text(o)) for i, o in enumerate(options)]
    return F.concat_ws("\n", *lines)


def render_choices(labels: str | Column, texts: str | Column) -> Column:
    """``label: text`` lines; the longer list is cut to the shorter one."""
    ls, ts = col(labels), col(texts)
    n = F.least(F.size(ls), F.size(ts))
    lines = F.zip_with(
        F.slice(ls, F.lit(1), n), F.slice(ts, F.lit(1), n), lambda a, b: F.concat(_text(a), F.lit(": "), _text(b))
    )
    return F.array_join(lines, "\n")


def letter(index: str | Column) -> Column:
    """A-D by 0-based index; negative indexes count from the end, others fail."""
    i = col(index).cast("int")
    # The guard matters: element_at over a literal array ignores a null index.
    return F.when(i.isNotNull(), F.element_at(_letters(), F.when(i < 0, i).otherwise(i + 1)))


def _labelled(opening: str, question: str, closing: str) -> Callable[[DataFrame], DataFrame]:
    def build(df: DataFrame) -> DataFrame:
        shown = render_choices("choices.label", "choices.text")
        return df.withColumn(
            "messages", _chat(_question(opening, [("Question", question)], shown, closing), F.col("answerKey"))
        )

    return build


arc_easy = _labelled(fixed.ANSWER_THE_QUESTION, "question", fixed.LETTER_ABCD)
openbookqa = _labelled(fixed.PASSAGE_OR_QUESTION, "question_stem", fixed.LETTER_ABCD)
commonsense_qa = _labelled(fixed.ANSWER_THE_QUESTION, "question", fixed.LETTER_ABCDE)


def piqa(df: DataFrame) -> DataFrame:
    """Only label 0 is A; everything else, hidden labels included, is B."""
    q = _question(fixed.ANSWER_THE_QUESTION, [("Goal", "goal")], _numbered("A", "sol1", "sol2"), fixed.LETTER_AB)
    return df.withColumn("messages", _chat(q, F.when(F.col("label") == 0, "A").otherwise("B")))


def hellaswag(df: DataFrame) -> DataFrame:
    """Endings lettered A-D; an empty label gives an empty answer."""
    lines = F.transform("endings", lambda e, i: F.concat(letter(i), F.lit(": "), _text(e)))
    q = _question(
        fixed.CONTINUE_THE_CONTEXT, [("Context", "ctx")], F.array_join(lines, "\n"), fixed.LETTER_ABCD
    )
    label = F.col("label").cast("string")
    return df.withColumn("messages", _chat(q, F.when(label == "", "").otherwise(letter(label))))


def winogrande(df: DataFrame) -> DataFrame:
    """Answers 1/2 become 0/1; an empty answer stays empty."""
    q = _question(
        fixed.ANSWER_THE_QUESTION, [("Question", "sentence")], _numbered("0", "option1", "option2"), fixed.NUMBER_01
    )
    raw = F.col("answer").cast("string")
    answer = F.when(raw == "", "").otherwise((raw.cast("int") - 1).cast("string"))
    return df.withColumn("messages", _chat(q, answer))


def social_iqa(df: DataFrame) -> DataFrame:
    q = _question(
        fixed.ANSWER_THE_QUESTION,
        [("Context", "context"), ("Question", "question")],
        _numbered("1", "answerA", "answerB", "answerC"),
        fixed.NUMBER_123,
    )
    return df.withColumn("messages", _chat(q, F.col("label")))


def math_qa(df: DataFrame) -> DataFrame:
    q = _question(fixed.ANSWER_THE_QUESTION, [("Question", "Problem")], _text("options"), fixed.LETTER_LOWER)
    return df.withColumn("messages", _chat(q, F.col("correct")))


def prompt(messages: str | Column = "messages") -> Column:
    """All messages but the last."""
    m = col(messages)
    return F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0)))


def answer(messages: str | Column = "messages") -> Column:
    """Content of the last message."""
    return F.element_at(col(messages), -1).getField("content")


def drop_unlabeled(df: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Keep rows whose answer is not the empty string (a null answer stays).

    The number dropped is counted in the same pass when an ``Observation`` is
    given.
    """
    labelled = is_not(answer(), "")
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.when(~labelled, 1).otherwise(0)), F.lit(0)).alias("dropped"),
        )
    return df.filter(labelled)


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows kept and dropped per split, before the unlabeled filter."""
    unlabeled = answer().eqNullSafe(F.lit(""))
    return df.groupBy("split").agg(
        F.count_if(~unlabeled).alias("rows"), F.count_if(unlabeled).alias("dropped")
    )


def apply_template(
    df: DataFrame,
    template: Callable[[DataFrame], DataFrame] | Callable[[Iterator], Iterator],
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Apply a row transform that has to produce ``messages``.

    A column builder takes and returns a DataFrame and stays in the JVM. With
    ``schema`` given, ``template`` is a pandas batch function for ``mapInPandas``.
    """
    out = df.mapInPandas(template, schema) if schema is not None else template(df)
    if "messages" not in out.columns:
        raise ValueError("the template did not create a 'messages' column")
    return out
