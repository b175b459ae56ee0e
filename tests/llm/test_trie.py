"""Prefix tries against a plain version on small conversations."""

import hashlib
import random
import zlib

import pytest

from graftwork.llm import trie


def _turns(rows):
    """Conversation to its (role, text) list."""
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    out = {}
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        out.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return out


def _rebuilt(plain):
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = plain.get(first, [])[:h] + own[h:]
    return out


def _brute(found):
    members = {}
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].split()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(own) if len(found[c]) == len(path))
        rows.append(
            (min(own), len(path), min(members[path[:-1]]) if path else None, len(own),
             sum(len(p) == len(path) + 1 for p in below), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(rows, key=str)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def _rows(df):
    return sorted((tuple(r[c] for c in trie.NODE_COLUMNS) for r in df.collect()), key=str)


def _conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 120), 60):
        for t in range(rng.randrange(1, 9)):
            text = rng.choice(["a", "a b", "", None, "c  d\te"]) if rng.random() < 0.9 else "x" * rng.randrange(9)
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "user", None]), text))
    return rows


@pytest.mark.parametrize(("seed", "container_turns"), [(1, 4096), (2, 20), (3, 3), (4, 0)])
def test_against_all_prefixes(spark, seed, container_turns):
    rows = _conversations(seed)
    plain = trie.sequences(_frame(spark, rows))
    shared = trie.with_shared_openings(plain)
    assert _rows(trie.prefix_trie(shared, container_turns)) == _brute(_rebuilt(_turns(rows)))


def test_copies_long_conversations_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_CHARS", 20)
    same = [(c, t, "user", f"turn {t}") for c in range(40) for t in range(3)]
    long = [(c, t, "user", f"word {t % 7}") for c in (100, 101) for t in range(5000 + c)]
    found = trie.sequences(_frame(spark, same + long))
    nodes = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(found, 100).collect()}
    assert len(nodes) == 1 + 3 + 5101
    end = nodes[0, 3]
    assert (end["n_convs"], end["n_children"], end["saved_tokens"]) == (40, 0, 78)
    assert end["ends_sha256"] == hashlib.sha256(",".join(map(str, range(40))).encode()).hexdigest()
    assert nodes[0, 0]["saved_tokens"] == 39 * 6 + 5100 * 2 and nodes[0, 0]["n_leaves"] == 2
    assert nodes[100, 5100]["n_children"] == 1 and nodes[101, 5101]["n_leaves"] == 1
    assert nodes[100, 1]["saved_tokens"] == 5100 * 2 and nodes[101, 5101]["parent_conv_id"] == 100


def test_odd_tables(spark):
    rows = [(None, 1, "user", "a"), (1, None, None, None), (1, 2, "user", "b " * 50_000), (1, 2, "user", "b"), (2, 2, "user", "b"),
            (2, 2, "user", "b"), (21, 0, "", ""), (40, 0, "u", "a")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id int, turn int, role string, text string, node int, place string")
    plain = trie.sequences(df)
    assert _rows(trie.prefix_trie(plain)) == _brute(_turns(rows))
    shared = trie.with_shared_openings(plain)
    assert _rows(trie.prefix_trie(shared, 1)) == _brute(_rebuilt(_turns(rows)))
    for none in (df.limit(0), df.filter("conv_id IS NULL")):
        assert trie.prefix_trie(trie.with_shared_openings(trie.sequences(none))).collect() == []
