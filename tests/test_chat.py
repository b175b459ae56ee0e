"""Chat rows: labels, hidden answers, uneven lists."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from graftwork.operators import chat as H
from graftwork.sources import datasets as D

ARC = "question string, choices struct<label: array<string>, text: array<string>>, answerKey string"


def texts(df):
    return [(r.messages[0].content, r.messages[-1].content) for r in df.select("messages").collect()]


def test_arc_prompt_text(spark):
    df = spark.createDataFrame([("Why?", (["A", "B"], ["x", "y", "z"]), "B")], ARC)
    q, a = texts(H.arc_easy(df))[0]
    assert q == (
        "Answer the question below by choosing the correct choice.\n\nQuestion: Why?\n\nChoices: A: x\nB: y\n\n"
        "You must respond with the letter corresponding to the correct choice (A,B,C,D) without any explanation. Answer:"
    )
    assert a == "B"


def test_choices_cut_to_the_shorter_list(spark):
    df = spark.createDataFrame([(["A", "B", "C"], ["x"]), ([], ["x"])], "l array<string>, t array<string>")
    assert [r.c for r in df.select(H.render_choices("l", "t").alias("c")).collect()] == ["A: x", ""]


def test_piqa_hidden_label_is_b(spark):
    df = spark.createDataFrame([("g", "x", "y", i) for i in (0, 1, -1)], "goal string, sol1 string, sol2 string, label int")
    assert [a for _, a in texts(H.piqa(df))] == ["A", "B", "B"]


@pytest.mark.parametrize("kind", ["string", "int"])
def test_hellaswag_labels(spark, kind):
    labels = [0, 3, -1] if kind == "int" else ["0", "3", "-1", "", None]
    df = spark.createDataFrame([("c", ["p", "q", "r", "s"], v) for v in labels], f"ctx string, endings array<string>, label {kind}")
    assert [a for _, a in texts(H.hellaswag(df))] == ["A", "D", "D", "", None][: len(labels)]


def test_hellaswag_rejects_bad_labels_and_fifth_ending(spark):
    schema = "ctx string, endings array<string>, label string"
    with pytest.raises(Exception):
        H.hellaswag(spark.createDataFrame([("c", ["p"], "4")], schema)).collect()
    with pytest.raises(Exception):
        H.hellaswag(spark.createDataFrame([("c", list("pqrst"), "0")], schema)).collect()


def test_winogrande_answers(spark):
    df = spark.createDataFrame([("s", "x", "y", v) for v in ("1", "2", "")], "sentence string, option1 string, option2 string, answer string")
    rows = texts(H.winogrande(df))
    assert [a for _, a in rows] == ["0", "1", ""]
    assert rows[0][0].endswith("(0, 1) without any explanation.")


def test_drop_unlabeled_keeps_null_and_counts(spark):
    df = spark.createDataFrame([("c", ["p"], v) for v in ("0", "", None, "")], "ctx string, endings array<string>, label string")
    seen = Observation("drops")
    assert H.drop_unlabeled(H.hellaswag(df), seen).count() == 2
    assert seen.get == {"rows": 4, "dropped": 2}


def test_prompt_and_answer(spark):
    msgs = [("system", "s"), ("user", "u"), ("assistant", "a")]
    df = spark.createDataFrame([(msgs,)], "messages array<struct<role: string, content: string>>")
    r = df.select(H.prompt().alias("p"), H.answer().alias("a")).first()
    assert [m.role for m in r.p] == ["system", "user"] and r.a == "a"


def test_template_must_create_messages(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="messages"):
        H.apply_template(df, lambda d: d)


def test_registry_and_splits(spark, tmp_path):
    with pytest.raises(ValueError, match="known: .*piqa"):
        D.registered("nope")
    df = spark.createDataFrame([("train", 1), ("test", 2)], "split string, x int")
    with pytest.warns(UserWarning, match="dev"):
        assert D.select_splits(df, ["train", "dev"]).count() == 1
    with pytest.raises(ValueError):
        D.select_splits(df, ["dev"])
    assert D.pick_eval_split(df).first().split == "test"
    with pytest.raises(ValueError, match="dev"):
        D.pick_eval_split(df, "dev")


def test_preprocess_all_reports_each_dataset(spark, tmp_path):
    rows = [("g", "x", "y", 0, "train"), ("g", "x", "y", 1, "validation")]
    raw = spark.createDataFrame(rows, "goal string, sol1 string, sol2 string, label int, split string")
    raw.write.partitionBy("split").parquet(f"{tmp_path}/raw/piqa")
    status = D.preprocess_all(spark, f"{tmp_path}/raw", f"{tmp_path}/out", ["train"])
    assert status["piqa"] == "ok" and status["arc_easy"] != "ok" and len(status) == 8
    back = spark.read.parquet(f"{tmp_path}/out/piqa")
    assert back.count() == 1 and set(back.columns) >= {"goal", "messages", "split"}
    # Writing again replaces the former content.
    D.write_dataset(D.preprocess(raw, "piqa"), f"{tmp_path}/out/piqa")
    assert spark.read.parquet(f"{tmp_path}/out/piqa").groupBy("split").agg(F.count("*")).count() == 2
