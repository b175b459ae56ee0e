"""Paths of retention plans."""

from graftwork.operators import planning


def test_targets_of_any_depth_are_resolved(spark):
    deep = "/".join(["a"] * 9 + [".."] * 9 + ["keep"])
    paths = {"a/./../b": "b", "x/././../keep": "keep", deep: "keep", "../a//b/./": "../a/b", "/../a": "/a", "../../c": "../../c", "/": "/", None: None}
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["plain"] for r in rows.select("path", planning.plain_path("path").alias("plain")).collect()}
    assert got == paths


def test_resolved_targets_protect(spark):
    artifacts = spark.createDataFrame([("b", True, 1), ("keep", True, 2), ("gone", True, 3)], "path string, is_dir boolean, bytes long")
    links = spark.createDataFrame([("l", "a/./../b"), ("m", "/".join(["a"] * 9 + [".."] * 9 + ["keep"]))], "name string, target string")
    plan = planning.retention_plan(artifacts, links, ["*"])
    assert [r["path"] for r in plan.collect()] == ["gone"]
