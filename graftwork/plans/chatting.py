"""Chat row queries."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftwork.functions import fixed as V
from graftwork.operators import chat as H
from graftwork.plans.registry import query

_NL = "chr(10)"
_GAP = "chr(10) || chr(10)"


def _prompt_sql(opening: str, fields: list[tuple[str, str]], choices: str, closing: str) -> str:
    parts = [f"'{opening}'"] + [f"'{t}: ' || {c}" for t, c in fields] + [f"'Choices: ' || {choices}", f"'{closing}'"]
    return f" || {_GAP} || ".join(parts)


def _rows_sql(table: str, prompt: str, answer: str) -> str:
    return f"SELECT id, split, {prompt} AS user_text, {answer} AS answer, 2 AS n_messages FROM {table}"


def _show(df):
    return df.select(
        "id",
        "split",
        F.element_at(H.prompt(), 1).getField("content").alias("user_text"),
        H.answer().alias("answer"),
        F.size("messages").alias("n_messages"),
    )


_FOUR = f"'A: ' || c0 || {_NL} || 'B: ' || c1 || {_NL} || 'C: ' || c2 || {_NL} || 'D: ' || c3"


def _choices(df, question="question"):
    labels = F.array(*[F.lit(x) for x in "ABCD"])
    choices = F.struct(labels.alias("label"), F.array("c0", "c1", "c2", "c3").alias("text"))
    return df.withColumn("choices", choices).withColumnsRenamed({"question": question, "answer_key": "answerKey"})


@query(
    "P1_arc_easy",
    "mcq_arc",
    sql=_rows_sql("mcq_arc", _prompt_sql(V.ANSWER_THE_QUESTION, [("Question", "question")], _FOUR, V.LETTER_ABCD), "answer_key"),
)
def arc(df):
    return _show(H.arc_easy(_choices(df)))


@query(
    "P4_openbookqa",
    "mcq_arc",
    sql=_rows_sql("mcq_arc", _prompt_sql(V.PASSAGE_OR_QUESTION, [("Question", "question")], _FOUR, V.LETTER_ABCD), "answer_key"),
)
def openbook(df):
    return _show(H.openbookqa(_choices(df, "question_stem")))


@query(
    "P8_commonsense_qa",
    "mcq_arc",
    sql=_rows_sql("mcq_arc", _prompt_sql(V.ANSWER_THE_QUESTION, [("Question", "question")], _FOUR, V.LETTER_ABCDE), "answer_key"),
)
def commonsense(df):
    return _show(H.commonsense_qa(_choices(df)))


_PIQA = _rows_sql(
    "mcq_piqa",
    _prompt_sql(V.ANSWER_THE_QUESTION, [("Goal", "goal")], f"'A: ' || sol1 || {_NL} || 'B: ' || sol2", V.LETTER_AB),
    "CASE WHEN label = 0 THEN 'A' ELSE 'B' END",
)


@query("P2_piqa", "mcq_piqa", sql=_PIQA)
def piqa(df):
    return _show(H.piqa(df))


_HELLA = _rows_sql(
    "mcq_hella",
    _prompt_sql(
        V.CONTINUE_THE_CONTEXT,
        [("Context", "ctx")],
        f"'A: ' || e0 || {_NL} || 'B: ' || e1 || {_NL} || 'C: ' || e2 || {_NL} || 'D: ' || e3",
        V.LETTER_ABCD,
    ),
    "CASE label WHEN '' THEN '' WHEN '0' THEN 'A' WHEN '1' THEN 'B' WHEN '2' THEN 'C' WHEN '3' THEN 'D' END",
)


def _hella(df):
    return H.hellaswag(df.withColumn("endings", F.array("e0", "e1", "e2", "e3")))


@query("P3_hellaswag", "mcq_hella", sql=_HELLA)
def hella(df):
    return _show(_hella(df))


@query("F1_drop_unlabeled", "mcq_hella", sql=f"SELECT * FROM ({_HELLA}) q WHERE answer IS NULL OR answer <> ''")
def labelled(df):
    return _show(H.drop_unlabeled(_hella(df)))


@query(
    "A20_dataset_profile",
    "mcq_hella",
    sql="""SELECT split, SUM(CASE WHEN label = '' THEN 0 ELSE 1 END)::BIGINT AS rows,
                  SUM(CASE WHEN label = '' THEN 1 ELSE 0 END)::BIGINT AS dropped FROM mcq_hella GROUP BY split""",
)
def profile(df):
    return H.dataset_profile(_hella(df))


@query(
    "P5_winogrande",
    "mcq_piqa",
    sql=_rows_sql(
        "mcq_piqa",
        _prompt_sql(V.ANSWER_THE_QUESTION, [("Question", "goal")], f"'0: ' || sol1 || {_NL} || '1: ' || sol2", V.NUMBER_01),
        "CASE answer WHEN '' THEN '' ELSE CAST(CAST(answer AS INT) - 1 AS VARCHAR) END",
    ),
)
def winogrande(df):
    return _show(H.winogrande(df.withColumnsRenamed({"goal": "sentence", "sol1": "option1", "sol2": "option2"})))


@query(
    "P6_social_iqa",
    "mcq_three",
    sql=_rows_sql(
        "mcq_three",
        _prompt_sql(
            V.ANSWER_THE_QUESTION,
            [("Context", "context"), ("Question", "question")],
            f"'1: ' || answer_a || {_NL} || '2: ' || answer_b || {_NL} || '3: ' || answer_c",
            V.NUMBER_123,
        ),
        "label",
    ),
)
def social(df):
    return _show(
        H.social_iqa(df.withColumnsRenamed({"answer_a": "answerA", "answer_b": "answerB", "answer_c": "answerC"}))
    )


@query(
    "P7_math_qa",
    "mcq_three",
    sql=_rows_sql(
        "mcq_three", _prompt_sql(V.ANSWER_THE_QUESTION, [("Question", "context")], "options", V.LETTER_LOWER), "correct"
    ),
)
def math(df):
    return _show(H.math_qa(df.withColumnRenamed("context", "Problem")))


@query(
    "P9_render_choices",
    "mcq_arc",
    sql=f"""SELECT id, 'A: ' || c0 || {_NL} || 'B: ' || c1 || CASE WHEN id % 4 >= 1 THEN {_NL} || 'C: ' || c2 ELSE '' END
                   || CASE WHEN id % 4 >= 2 THEN {_NL} || 'D: ' || c3 ELSE '' END AS choices FROM mcq_arc""",
)
def rendered(df):
    labels = F.slice(F.array(*[F.lit(x) for x in "ABCDE"]), F.lit(1), (F.col("id") % 4 + 2).cast("int"))
    return df.select("id", H.render_choices(labels, F.array("c0", "c1", "c2", "c3")).alias("choices"))


@query(
    "P10_letter",
    "mcq_hella",
    sql="SELECT id, substr('ABCDABCD', CAST(id % 8 AS INT) + 1, 1) AS letter FROM mcq_hella",
)
def letters(df):
    return df.select("id", H.letter(F.col("id") % 8 - 4).alias("letter"))


@query(
    "P11_prompt_answer",
    "mcq_three",
    sql="""SELECT id, CAST(CASE WHEN id % 2 = 0 THEN 3 ELSE 2 END AS INT) AS n_prompt,
                  CASE WHEN id % 2 = 0 THEN 'system,user,user' ELSE 'system,user' END AS roles,
                  CASE WHEN id % 2 = 0 THEN answer_a ELSE question END AS last_prompt, label AS answer FROM mcq_three""",
)
def split_messages(df):
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    short = F.array(turn("system", "context"), turn("user", "question"), turn("assistant", "label"))
    long = F.array(
        turn("system", "context"), turn("user", "question"), turn("user", "answer_a"), turn("assistant", "label")
    )
    rows = df.withColumn("messages", F.when(F.col("id") % 2 == 0, long).otherwise(short))
    return rows.select(
        "id",
        F.size(H.prompt()).alias("n_prompt"),
        F.array_join(H.prompt().getField("role"), ",").alias("roles"),
        F.element_at(H.prompt(), -1).getField("content").alias("last_prompt"),
        H.answer().alias("answer"),
    )


def _pandas_piqa(batches):
    for pdf in batches:
        text = (
            V.ANSWER_THE_QUESTION + "\n\nGoal: " + pdf["goal"] + "\n\nChoices: A: " + pdf["sol1"] + "\nB: " + pdf["sol2"]
            + "\n\n" + V.LETTER_AB
        )
        letter = pdf["label"].eq(0).map({True: "A", False: "B"})
        pdf["messages"] = [
            [{"role": "user", "content": u}, {"role": "assistant", "content": a}] for u, a in zip(text, letter)
        ]
        yield pdf


@query("X1_python_template", "mcq_piqa", sql=_PIQA)
def python_template(df):
    schema = T.StructType([*df.schema.fields, T.StructField("messages", H.MESSAGES)])
    return _show(H.apply_template(df, _pandas_piqa, schema))


@query("X1_column_template", "mcq_piqa", sql=_PIQA)
def column_template(df):
    return _show(H.apply_template(df, H.piqa))
