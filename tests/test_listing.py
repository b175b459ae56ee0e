"""Listing of run folders with links."""

import os

import pytest

from graftwork.operators import planning as G
from graftwork.sources import listing as L


@pytest.fixture
def root(tmp_path):
    for path, size in (("a/x/w", 5), ("a/v", 2), ("b/w", 7), ("c/w", 1), ("single", 3), ("a/.done", 0), ("b c/sub/.done", 0)):
        (tmp_path / "runs" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "runs" / path).write_bytes(b"z" * size)
    (tmp_path / "outside").mkdir()
    for name, target in (("to_b", "./a/../b"), ("chain", "to_b"), ("a/inner", "../c"), ("a/file", "x/w"), ("lost", "nowhere"), ("away", "../outside"), ("a/up", "..")):
        os.symlink(target, tmp_path / "runs" / name)
    return tmp_path / "runs"


def test_entries(spark, root):
    for place in (str(root), f"file://{root}/"):
        tree = L.read_tree(spark, place)
        found = {r.path: (r.is_dir, r.bytes) for r in L.artifacts(tree).collect()}
        assert found["a"] == (True, 12) and found["a/x"] == (True, 5) and found["b"] == (True, 7) and found["single"] == (False, 3)
        assert found["b c/sub"] == (True, 0) and "to_b" not in found and "a/file" not in found
        assert tree.rdd.getNumPartitions() == 9


def test_links(spark, root):
    tree = L.read_tree(spark, str(root), tasks=2)
    assert tree.rdd.getNumPartitions() <= 2
    top = {r.name: r.target for r in L.links(tree).collect()}
    assert top == {"to_b": "b", "chain": "b", "lost": "nowhere", "away": str(root.parent / "outside")}
    nested = {r.name: r.target for r in L.links(tree, nested=True).collect()}
    assert nested == top | {"a/inner": "c", "a/file": "a/x/w", "a/up": "."}


def test_retention_of_a_tree(spark, root):
    tree = L.read_tree(spark, str(root))
    plan = G.retention_plan(L.artifacts(tree), L.links(tree), ["?", "b c"])
    assert {(r.path, r.bytes) for r in plan.collect()} == {("a", 12), ("c", 1), ("b c", 0)}
    free = G.retention_plan(L.artifacts(tree), L.links(tree), ["?"], unlink=["to_b", "chain"])
    assert {r.path for r in free.collect()} == {"a", "b", "c"}


def test_finished(spark, root):
    got = {r.path: r.done for r in L.finished_folders(L.read_tree(spark, str(root))).collect()}
    assert {p for p, done in got.items() if done} == {"a", "b c/sub"} and got["b"] is False


def test_empty_and_missing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert L.artifacts(L.read_tree(spark, str(tmp_path / "none"))).count() == 0
    with pytest.raises(Exception, match="missing"):
        L.read_tree(spark, str(tmp_path / "missing")).count()
