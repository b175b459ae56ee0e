"""Trees of entries: made by tasks of bounded size, listed once, in slices."""

import os

from pyspark.sql import functions as F

from graftwork.plans import storage
from graftwork.sources import listing


def _entries(spark, n):
    rows = spark.range(n).select(F.concat(F.lit("job"), F.col("id") % 40, F.lit("/part-"), "id").alias("path"), F.lit("dir").alias("kind"), "id")
    return rows.drop("id").unionByName(rows.filter("id % 3 = 0").select(F.concat("path", F.lit("/.done")).alias("path"), F.lit("file").alias("kind")))


def test_a_tree_is_made_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ENTRIES", 50)
    entries = _entries(spark, 300).coalesce(1)
    tasks = []
    monkeypatch.setattr(type(entries), "repartitionByRange", lambda df, n, *c, real=type(entries).repartitionByRange: tasks.append(n) or real(df, n, *c))
    place = storage._make_tree(entries, str(tmp_path / "t"))
    assert tasks == [8]
    assert listing.read_tree(spark, place).count() == 300 + 100 + 40


def test_a_sliced_tree_lists_the_same_and_leaves_no_folders(spark, tmp_path, monkeypatch):
    entries = _entries(spark, 300)
    most = []
    real = storage._make_tree
    monkeypatch.setattr(storage, "_make_tree", lambda part, root, n: most.append(n) or real(part, root, n))
    whole = sorted(map(tuple, storage._listed_tree(entries).collect()))
    monkeypatch.setattr(storage, "shared_folder", lambda df: str(tmp_path))
    sliced = storage._listed_tree(entries, 100)
    assert sorted(map(tuple, sliced.collect())) == whole and len(whole) == 440
    assert most[0] == 400 and sum(most[1:]) == 400 and len(most) == 5
    assert not [name for name in os.listdir(tmp_path) if name.startswith("tree-")]


def test_a_listing_is_stored(spark):
    entries = spark.createDataFrame([("a/w", "file", 5, None), ("a/l", "link", None, "./w"), ("b", "link", None, "./x/../a")], "path string, kind string, bytes bigint, target string")
    tree = storage._listed_tree(entries)
    assert "tree" not in tree._jdf.queryExecution().toString().split("Physical Plan")[-1].lower().split("location")[0]
    assert {(r.path, r.kind, r.bytes, r.target) for r in tree.collect()} == {("a", "dir", 0, None), ("a/w", "file", 5, None), ("a/l", "link", 5, "a/w"), ("b", "link", 0, "a")}


def _inodes(root):
    return {os.lstat(f"{at}/{name}").st_ino for at, folders, _ in os.walk(root) for name in folders if not os.path.islink(f"{at}/{name}")}


def test_a_tree_is_made_of_spare_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ENTRIES", 50)
    entries = _entries(spark, 300)
    whole = sorted(map(tuple, listing.read_tree(spark, storage._make_tree(entries, str(tmp_path / "u"))).collect()))
    outside = tmp_path / "outside"
    (outside / "in").mkdir(parents=True)
    (outside / "in" / "kept").write_text("x")
    pool = tmp_path / "t.spare"
    for k in range(30):
        for part in range(k % 12):
            (pool / "old" / f"job{k}" / f"part-{part}").mkdir(parents=True)
            (pool / "old" / f"job{k}" / f"part-{part}" / "mark").write_text("old")
        (pool / "old" / f"job{k}").mkdir(parents=True, exist_ok=True)
        (pool / "old" / f"job{k}" / "link").symlink_to(outside)
    for part in range(200):
        (pool / "older" / "hot" / f"part-{part}" / "deep" / "er").mkdir(parents=True)
    (pool / "older" / "link").symlink_to(outside)
    (pool / "older" / "file").write_text("old")
    spare = _inodes(pool) - {os.lstat(pool / tree).st_ino for tree in ("old", "older")}
    assert len(spare) > 340
    place = storage._make_tree(entries, str(tmp_path / "t"))
    assert sorted(map(tuple, listing.read_tree(spark, place).collect())) == whole
    made = _inodes(place)
    assert len(made) == 340 and made <= spare
    assert (outside / "in" / "kept").read_text() == "x"


def test_files_beside_spare_folders_have_their_own_text(spark, tmp_path):
    (tmp_path / "t.spare" / "old" / "x" / "y").mkdir(parents=True)
    (tmp_path / "t.spare" / "old" / "x" / "y" / "mark").write_text("old")
    rows = [("a/b", "dir", None, None), ("a/b", "dir", None, None), ("a/b/e", "file", None, None), ("a/b/e", "file", None, None), ("a/b/w", "file", None, "x"), ("a/c/e", "file", None, None), ("a/s", "file", 5, None), ("a/l", "link", None, None), ("e", "file", 0, "")]
    entries = spark.createDataFrame([(*r, "./b" if r[1] == "link" else None) for r in rows], "path string, kind string, bytes bigint, text string, target string")
    place = storage._make_tree(entries, str(tmp_path / "t"))
    sizes = {(r.path, r.kind): r.bytes for r in listing.read_tree(spark, place).collect()}
    assert sizes == {("a", "dir"): 0, ("a/b", "dir"): 0, ("a/b/e", "file"): 0, ("a/b/w", "file"): 1, ("a/c", "dir"): 0, ("a/c/e", "file"): 0, ("a/s", "file"): 5, ("a/l", "link"): 0, ("e", "file"): 0}
    assert (tmp_path / "t" / "a" / "b" / "w").read_text() == "x"


def test_what_a_tree_leaves_is_spare_for_the_next(tmp_path):
    (tmp_path / "tree-0" / "a" / "b").mkdir(parents=True)
    storage._set_aside(str(tmp_path / "tree-0"), str(tmp_path / "tree-1"))
    (tmp_path / "tree-1").mkdir()
    (tmp_path / "tree-1.spare" / "tree-0" / "a").rename(tmp_path / "tree-1" / "c")
    storage._set_aside(str(tmp_path / "tree-1"), str(tmp_path / "tree-2"))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*")) == ["tree-2.spare", "tree-2.spare/tree-1", "tree-2.spare/tree-1/c", "tree-2.spare/tree-1/c/b"]
