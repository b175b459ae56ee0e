"""Prefix tries over conversations: which opening turns are shared, and what sharing them saves.

A burst trie, spread over shards. Suffixes of conversations lie in containers
under trie heads. A container with more than ``CONTAINER_TURNS`` turns bursts by
the next turn, so that its head becomes an inner node and every next turn the
head of a smaller container. Whether a container bursts depends only on the
turns below its head; counting those by prefix tells for all levels at once
which nodes are inner and where each suffix ends up, without a round per level.
The containers that are left have a bounded size: each is sorted by its turn ids
and swept once into nodes. What is known of containers is then summed up the
few inner nodes above them.

No step holds a conversation or the members of a node at once. Prefixes are
named by sums of hashes of (turn, place), which are prefix sums over rows, and
member lists are hashed from pieces in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import stored, table
from graftwork.llm.crc_sql import CRC_MACROS, crc32_of
from graftwork.llm.registry import query
from graftwork.operators.scale import broadcast_checked, positions, running_sums

CONTAINER_TURNS = 4_096
BROADCAST_NODES = 50_000
PIECE_CHARS = 500_000
WORD = r"[^\x20\x09-\x0D]+"
SHARED_AMONG, SHARED_TURNS = 20, 4

NODE_FIELDS = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
NODE_COLUMNS = [f.split(" ")[0] for f in NODE_FIELDS.split(", ")]
SWEPT_FIELDS = f"head binary, {NODE_FIELDS}"


class Sequences(NamedTuple):
    """``turns(conv, place, turn, tokens)`` with places from 1 without gaps, and ``members(conv, size)``."""

    turns: DataFrame
    members: DataFrame


# ---------------------------------------------------------------- sequences


def _turn_id(role: Column, text: Column) -> Column:
    """128 bits of a turn: role and text, with the border between them."""
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def sequences(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Sequences:
    """Conversations in the order of their turns, null first; equal turn numbers go by the turn's digest.

    Null roles and texts are empty. Rows without a conversation belong to none
    and are left out. Repeated rows are turns of their own; other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("at"), _turn_id(role, text).alias("turn"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
    )
    placed = positions(rows, ["conv"], [F.col("at").asc_nulls_first(), "turn"], "before")
    turns = stored(placed.select("conv", (F.col("before") + 1).alias("place"), "turn", "tokens"), "turns")
    return Sequences(turns, stored(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("size")), "members"))


def with_shared_openings(plain: Sequences, among: int = SHARED_AMONG, at_most: int = SHARED_TURNS) -> Sequences:
    """Conversation c opens with the first h turns of c - c % ``among``, in place of its own first h; h = crc32(c) % ``at_most``.

    A first conversation that is shorter gives all its turns, one that is absent none.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % at_most
    sizes = plain.members.withColumns({"h": h, "first": F.col("conv") - F.col("conv") % among})
    first_sizes = plain.members.select(F.col("conv").alias("first"), F.col("size").alias("first_size"))
    members = sizes.join(first_sizes, "first", "left").select(
        "conv", "first", "h", F.least("h", F.coalesce("first_size", F.lit(0))).alias("lent"),
        F.greatest(F.col("size") - F.col("h"), F.lit(0)).alias("own"),
    )
    members = stored(members, "openings")
    kept = plain.turns.join(members.select("conv", "h", "lent"), "conv").filter("place > h")
    kept = kept.select("conv", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "turn", "tokens")
    # At most ``among`` conversations on each side of zero share one opening of less than ``at_most`` turns.
    openings = plain.turns.filter((F.col("place") < at_most) & (F.col("conv") % among == 0))
    openings = openings.select(F.col("conv").alias("first"), "place", "turn", "tokens")
    lent = members.select("conv", "first", "h").join(openings, "first").filter("place <= h").select("conv", "place", "turn", "tokens")
    turns = kept.unionByName(lent)
    return Sequences(turns, members.select("conv", (F.col("lent") + F.col("own")).alias("size")))


# ---------------------------------------------------------------- digests of member lists


def _digests(rows: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of the ascending members (``node, conv``) of every node.

    SHA-256 has to read a list in order. Tasks join sorted members into pieces,
    however they are split; a node's pieces then pass through one hash.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0
        out: list[tuple] = []
        for batch in batches:
            for key, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if held and (key != node or size > PIECE_CHARS):
                    out.append((node, first, ",".join(held)))
                    held, size = [], 0
                    if len(out) >= 64:
                        yield _piece_rows(out)
                        out = []
                if not held:
                    node, first = key, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            out.append((node, first, ",".join(held)))
        if out:
            yield _piece_rows(out)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, found = [], []
            for key, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if state is not None and key == node:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    nodes.append(node)
                    found.append(state.hexdigest())
                node, state = key, hashlib.sha256(text.encode())
            yield _digest_rows(nodes, found)
        if state is not None:
            yield _digest_rows([node], [state.hexdigest()])

    cut = rows.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    cut = stored(cut.mapInArrow(pieces, "node binary, first long, ids string"), "ends")
    return cut.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["node", "first", "ids"])


def _digest_rows(nodes: list[bytes], found: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], ["node", "ends_sha256"])


NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- containers


class _Open:
    """A node whose subtree is being read."""

    __slots__ = ("depth", "tokens", "first", "members", "children", "leaves", "saved", "ends")

    def __init__(self, depth: int, tokens: int):
        self.depth, self.tokens = depth, tokens
        self.first, self.members, self.leaves, self.saved = None, 0, 0, 0
        self.children: list[list] = []
        self.ends: list[int] = []

    def closed(self) -> list:
        """Its row, and its own number in the rows of its children."""
        for child in self.children:
            child[2] = self.first
        ends = ",".join(map(str, sorted(self.ends)))
        return [
            self.first, self.depth, None, self.members, len(self.children), self.leaves or 1,
            self.saved + (self.members - 1) * self.tokens, hashlib.sha256(ends.encode()).hexdigest(),
        ]


def sweep(depth: int, suffixes: list[tuple[list, int, list]]) -> tuple[list[list], list]:
    """Node rows of a container, and its sums: children, leaves and saved tokens below the head.

    ``suffixes`` are (turn ids, conversation, tokens); sorted, the next suffix
    leaves the open nodes that it does not share with the one before.
    """
    suffixes.sort(key=lambda s: (s[0], s[1]))
    head = _Open(depth, 0)
    opened, rows, before = [head], [], []

    def close() -> None:
        node = opened.pop()
        row, above = node.closed(), opened[-1]
        above.children.append(row)
        above.leaves += row[5]
        above.saved += row[6]
        rows.append(row)

    for turns, conv, tokens in suffixes:
        shared = 0
        for a, b in zip(before, turns, strict=False):
            if a != b:
                break
            shared += 1
        while len(opened) - 1 > shared:
            close()
        for k in range(shared, len(turns)):
            opened.append(_Open(depth + k + 1, tokens[k]))
        for node in opened[1:]:
            node.members += 1
            if node.first is None or conv < node.first:
                node.first = conv
        opened[-1].ends.append(conv)
        before = turns
    while len(opened) > 1:
        close()
    return rows, [len(head.children), head.leaves, head.saved]


def _swept(suffixes: DataFrame) -> DataFrame:
    """Nodes below the heads; a row without ``conv_id`` holds the sums of the container of ``head``.

    ``suffixes`` has ``head, first, depth`` of the head and ``conv, place, turn,
    tokens``. A container is read at once; its size is bounded by the bursts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, top, depth, held, out = None, None, 0, [], []

        def done() -> None:
            rows, (children, leaves, saved) = sweep(depth, held)
            for row in rows:
                if row[1] == depth + 1:
                    row[2] = top
                out.append((None, *row))
            out.append((head, None, None, None, None, children, leaves, saved, None))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("head", "first", "depth", "conv", "turn", "tokens"))
            for key, first, level, conv, turn, tokens in zip(*columns, strict=True):
                if key != head:
                    if head is not None:
                        done()
                    head, top, depth, held = key, first, level, []
                if not held or held[-1][1] != conv:
                    held.append(([], conv, []))
                held[-1][0].append(turn)
                held[-1][2].append(tokens)
                if len(out) >= 4096:
                    yield _swept_rows(out)
                    out = []
        if head is not None:
            done()
        if out:
            yield _swept_rows(out)

    rows = suffixes.repartition("head").sortWithinPartitions("head", "conv", "place")
    return stored(rows.mapInArrow(run, SWEPT_FIELDS), "swept")


def _swept_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), *[pa.int64()] * 7, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["head", *NODE_COLUMNS])


# ---------------------------------------------------------------- the trie


def _key(place: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *[x.cast("string") for x in (place, *sums)]).cast("binary")))


def _named(found: Sequences) -> DataFrame:
    """Turns with the names of their prefix (``node``) and of the one before (``parent``), and how many turns follow."""
    one, two = F.xxhash64("turn", "place"), F.xxhash64("place", "turn", F.lit(2))
    low = F.lit(0xFFFFFFFF).cast("long")
    # Sums of 32-bit parts do not overflow in any conversation of less than 2^31 turns.
    parts = [F.shiftrightunsigned(one, 32), one.bitwiseAND(low), F.shiftrightunsigned(two, 32), two.bitwiseAND(low)]
    rows = found.turns.withColumns({f"part{k}": x for k, x in enumerate(parts)})
    rows = running_sums(rows, ["conv"], "place", {f"part{k}": f"sum{k}" for k in range(4)})
    sums = [F.col(f"sum{k}") for k in range(4)]
    return rows.join(found.members, "conv").select(
        "conv", "place", "turn", "tokens", (F.col("size") - F.col("place")).alias("after"),
        _key(F.col("place"), sums).alias("node"),
        _key(F.col("place") - 1, [s - F.col(f"part{k}") for k, s in enumerate(sums)]).alias("parent"),
    )


def prefix_trie(found: Sequences, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """One row per distinct prefix of the sequences, the empty one included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes in the subtree),
    ``saved_tokens`` (over the subtree: members less one, times tokens of the
    last turn) and ``ends_sha256`` (of the comma-joined ascending numbers of the
    members that end here). No members, no rows.
    """
    named = stored(_named(found), "prefixes")
    nodes = named.groupBy("node").agg(
        F.min("conv").alias("first"), F.count(F.lit(1)).alias("n_convs"), F.sum("after").alias("below"),
        F.any_value("parent").alias("parent"), F.any_value("place").alias("depth"), F.any_value("tokens").alias("tokens"),
    )
    nodes = stored(nodes.withColumn("inner", F.col("below") > container_turns), "nodes")
    # Heads and inner nodes: what stands at the root or under an inner node.
    inner = nodes.filter("inner").select(F.col("node").alias("parent"))
    under = nodes.filter("depth > 1").join(broadcast_checked(inner, BROADCAST_NODES), "parent", "left_semi")
    tops = stored(nodes.filter("depth = 1").unionByName(under.select(nodes.columns)), "tops")

    top_columns = tops.select("node", "first", "n_convs", "inner")
    above = named.select("conv", "place", "node", "after", "tokens").join(broadcast_checked(top_columns, BROADCAST_NODES), "node")
    above = stored(above, "above")
    heads = above.filter("NOT inner").select("conv", F.col("node").alias("head"), "first", F.col("place").alias("depth"))
    suffixes = named.select("conv", "place", "turn", "tokens").join(heads, "conv").filter("place > depth")
    swept = _swept(suffixes)

    # The first member of a node stands for it; what it stands for counts for every prefix of it.
    sums = swept.filter("conv_id IS NULL").select(F.col("head").alias("node"), "n_children", "n_leaves", F.col("saved_tokens").alias("saved_below"))
    own_leaves = F.when(F.col("inner"), F.lit(0)).otherwise(F.coalesce("n_leaves", F.lit(1)))
    own_saved = (F.col("n_convs") - 1) * F.col("tokens") + F.coalesce("saved_below", F.lit(0))
    stands = (F.col("conv") == F.col("first")).cast("long")
    values = above.join(sums, "node", "left").select(
        "conv", "place", "node", (stands * own_leaves).alias("leaves"), (stands * own_saved).alias("saved")
    )
    values = stored(values, "values")
    through = running_sums(values, ["conv"], "place", {"leaves": "leaves_to", "saved": "saved_to"})
    whole = values.groupBy("conv").agg(F.sum("leaves").alias("all_leaves"), F.sum("saved").alias("all_saved"))
    subtree = through.join(whole, "conv").groupBy("node").agg(
        F.sum(F.col("all_leaves") - F.col("leaves_to") + F.col("leaves")).alias("n_leaves"),
        F.sum(F.col("all_saved") - F.col("saved_to") + F.col("saved")).alias("saved_tokens"),
    )

    root = _key(F.lit(0), [F.lit(0)] * 4)
    ended = above.filter("after = 0").select("node", "conv").unionByName(
        found.members.filter("size = 0").select(root.alias("node"), "conv")
    )
    digests = stored(_digests(ended), "digests")
    # Three single rows for the root.
    everyone = found.members.agg(F.min("conv").alias("first"), F.count(F.lit(1)).alias("n_convs")).first()
    grown = values.agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).first()
    beginnings = tops.filter("depth = 1").count()
    number = lambda x: F.lit(x).cast("long")
    start = found.members.sparkSession.range(1 if everyone["n_convs"] else 0).select(
        root.alias("node"), number(everyone["first"]).alias("first"), number(0).alias("depth"),
        number(None).alias("parent_conv_id"), number(everyone["n_convs"]).alias("n_convs"), number(beginnings).alias("n_children"),
        number(grown["n_leaves"] or 1).alias("n_leaves"), number(grown["saved_tokens"] or 0).alias("saved_tokens"),
    )

    inner_children = tops.filter("depth > 1").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_inner_children"))
    parents = tops.filter("inner").select(F.col("node").alias("parent"), F.col("first").alias("parent_conv_id"))
    columns = ["node", "parent", "first", "depth", "n_convs"]
    first_level = tops.filter("depth = 1").select(*columns, number(everyone["first"]).alias("parent_conv_id"))
    deeper = tops.filter("depth > 1").select(columns).join(broadcast_checked(parents, BROADCAST_NODES), "parent")
    upper = (
        first_level.unionByName(deeper)
        .join(subtree, "node")
        .join(inner_children, "node", "left")
        .join(sums.select("node", "n_children"), "node", "left")
        .withColumn("n_children", F.coalesce("n_inner_children", "n_children", F.lit(0)))
    )
    upper = upper.select(start.columns).unionByName(start).join(digests, "node", "left").select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return swept.filter("conv_id IS NOT NULL").select(NODE_COLUMNS).unionByName(upper)


TURNS_SQL = f"""
WITH {CRC_MACROS},
digested AS (
    SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS id,
           len(regexp_extract_all(text, '{WORD}')) AS tokens
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
plain AS (
    SELECT conv_id, list({{'id': id, 'tokens': tokens}} ORDER BY turn NULLS FIRST, id) AS turns FROM digested GROUP BY conv_id
),
openings AS (
    SELECT conv_id, turns, ({crc32_of("conv_id::VARCHAR")} % 4)::INT AS h FROM plain, crc_table
),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
    FROM openings c LEFT JOIN plain b ON b.conv_id = c.conv_id - c.conv_id % 20
),
prefixes AS (
    SELECT conv_id, depth, len(turns) = depth AS ends, turns[depth].tokens AS tokens,
           array_to_string(list_transform(turns[1:depth], lambda t: t.id), '') AS path
    FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
),
nodes AS (
    SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
           (count(*) - 1) * coalesce(any_value(tokens), 0) AS saved,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM prefixes
    GROUP BY path
),
linked AS (SELECT path, left(path, 32 * (depth - 1)::INT) AS parent FROM nodes WHERE depth > 0),
children AS (SELECT parent AS path, count(*) AS n_children FROM linked GROUP BY parent),
subtrees AS (
    SELECT left(path, 32 * above::INT) AS path, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT n.path, n.saved, c.n_children, unnest(range(n.depth + 1)) AS above FROM nodes n LEFT JOIN children c USING (path))
    GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s USING (path) LEFT JOIN children c USING (path)
     LEFT JOIN linked l USING (path) LEFT JOIN nodes p ON p.path = l.parent
"""


@query("op12_prefix_trie", sql=TURNS_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_openings(sequences(table(spark, sf_dir, "conversations"))))
