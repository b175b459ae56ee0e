"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates.

1. Every text becomes one hash per bin: its shingle hashes are dealt over bins by
   their leading bits and each bin keeps the least. An empty bin copies the first
   filled bin in an order of its own (densification that depends on the bin alone).
2. Documents with equal shingle sets are one class; one document stands for it.
3. Bands of bins are bucket keys; short sets also have their least shingles as keys,
   one more than a similar set can lack. Every document of a bucket is compared with the
   bucket's smallest id only: candidates grow with documents, not with pairs.
4. Candidates are confirmed on their whole shingle sets; confirmed links are joined
   into components.
5. Buckets that still hold several components could hide a link between two
   documents neither of which is the smallest. Their members meet in blocks of
   bounded size, where shingle sets are compared in place (a pair is passed over
   only if its sizes or bins prove that it is not similar); only links leave a block. So no link between texts of one bucket is lost, and
   no pairs are listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import stored, table
from graftwork.llm.components import components
from graftwork.llm.registry import query
from graftwork.llm.words import BASE, WordCodes, codes_of, mix, shingles, words

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
# Two sets of which the smaller has at most so many shingles meet by a shared shingle, surely.
SHORT = 32
BLOCK = 512
BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def probe_orders(bins: int = BINS) -> np.ndarray:
    """For every bin the order in which it looks for a filled one, itself first."""
    cells = mix(np.arange(bins * bins, dtype=np.uint64) + BASE).reshape(bins, bins)
    np.fill_diagonal(cells, 0)
    return cells.argsort(axis=1)


def signature(sets: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """One hash per bin of a sorted, non-empty shingle set."""
    bins = (sets >> BIN_SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    filled, least = np.zeros(BINS, bool), np.zeros(BINS, np.uint64)
    filled[bins[first]] = True
    least[bins[first]] = sets[first]
    source = orders[np.arange(BINS), filled[orders].argmax(axis=1)]
    return least[source]


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for every band, different bands having different keys."""
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * BASE + rows[:, k])
    return key.view(np.int64)


def short_keys(own: np.ndarray) -> np.ndarray:
    """Bucket keys of a short sorted set: a similar set holds one of these shingles among its own keys."""
    n = len(own)
    if n * PERCENT > SHORT * 100:
        return np.empty(0, np.int64)
    return mix(own[: n - -(-n * PERCENT // 100) + 1] ^ BASE).view(np.int64)


def sketches(df: DataFrame) -> DataFrame:
    """``id, n_shingles, set_hash, bands`` of ``id, text``; no words: null hash and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, orders = WordCodes(), probe_orders()
        for batch in batches:
            sizes, hashes, bands = [], [], []
            for text in batch.column("text"):
                own = shingles(codes_of(words(text.as_py()), known), SHINGLE)
                sizes.append(len(own))
                hashes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                bands.append(np.concatenate([band_keys(signature(own, orders)), short_keys(own)]) if len(own) else None)
            cols = [
                batch.column("id"),
                pa.array(sizes, pa.int64()),
                pa.array(hashes, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_shingles", "set_hash", "bands"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, n_shingles long, set_hash binary, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``u, v`` pairs whose whole shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        sets: dict = {}

        def own(key, text):
            if key not in sets:
                if len(sets) >= 64:  # rows come ordered by one of their texts
                    sets.clear()
                sets[key] = shingles(codes_of(words(text.as_py()), known), SHINGLE)
            return sets[key]

        for batch in batches:
            good = []
            us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            for u, v, a, b in zip(us, vs, batch.column("a"), batch.column("b"), strict=True):
                y, x = own(v, b), own(u, a)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(
                pa.array(good, pa.bool_())
            )

    kind = pairs.schema["u"].dataType.simpleString()
    ids = stored(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ids")
    used = stored(texts.join(ids, "id", "left_semi"), "texts")
    both = pairs.join(used.select(F.col("id").alias("u"), F.col("text").alias("a")), "u").join(
        used.select(F.col("id").alias("v"), F.col("text").alias("b")), "v"
    )
    return both.select("u", "v", "a", "b").mapInArrow(run, f"u {kind}, v {kind}")


def _profiles(texts: DataFrame) -> DataFrame:
    """``id, bands, bins, shingles`` as bytes, of ``id, text``: what a block compares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, orders = WordCodes(), probe_orders()
        for batch in batches:
            bands, bins, sets = [], [], []
            for text in batch.column("text"):
                own = shingles(codes_of(words(text.as_py()), known), SHINGLE)
                least = signature(own, orders)
                bands.append(band_keys(least).tobytes())
                bins.append(least.astype(np.uint8).tobytes())
                sets.append(own.tobytes())
            cols = [batch.column("id"), *(pa.array(x, pa.binary()) for x in (bands, bins, sets))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "bands", "bins", "shingles"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, bands binary, bins binary, shingles binary")


def _links_in_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``u, v`` between members of one bucket that are not in one component yet.

    ``members`` are ``key, id, component``. A bucket is cut into blocks, and every
    two blocks of it meet once; a pair that meets in several buckets is compared
    in the first of them only.
    """
    kind = members.schema["id"].dataType.simpleString()
    ids = stored(members.select("id").distinct(), "ids")
    profiles = stored(_profiles(texts.join(ids, "id", "left_semi").dropDuplicates(["id"])), "profiles")
    cuts = stored(members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts")), "cuts")
    own = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    placed = members.join(cuts, "key").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    placed = placed.select(
        "key", "id", "component", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")
    )

    def compare(block: pa.Table) -> pa.Table:
        ids, components = block.column("id").to_pylist(), block.column("component").to_numpy()
        n, key = len(ids), block.column("key")[0].as_py()
        own, a, b = block.column("own").to_numpy(), block.column("a")[0].as_py(), block.column("b")[0].as_py()
        bands = np.frombuffer(b"".join(block.column("bands").to_pylist()), np.int64).reshape(n, BANDS)
        bins = np.frombuffer(b"".join(block.column("bins").to_pylist()), np.uint8).reshape(n, BINS)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("shingles")]
        sizes = np.fromiter(map(len, sets), np.int64, n)
        filled = np.zeros((n, BINS), bool)
        for i, own_set in enumerate(sets):
            filled[i, (own_set >> BIN_SHIFT).astype(np.int64)] = True
        place = np.flatnonzero(bands[0] == key)  # nowhere if the key is a shingle of short sets
        earlier = bands[:, : int(place[0])] if len(place) else bands
        found = []
        for i in range(n):
            j = np.arange(i + 1, n)
            j = j[(components[j] != components[i]) & ((own[j] != own[i]) | (a == b))]
            small, large = np.minimum(sizes[j], sizes[i]), np.maximum(sizes[j], sizes[i])
            j = j[100 * small >= PERCENT * large]
            j = j[~(earlier[j] == earlier[i]).any(1)]
            # The least hash of a bin that differs is in one set only: each such bin is a shingle that is not shared.
            apart = ((bins[j] != bins[i]) & (filled[j] | filled[i])).sum(1)
            j = j[(100 + PERCENT) * apart <= (100 - PERCENT) * (sizes[j] + sizes[i])]
            for k in j.tolist():
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if 100 * both >= PERCENT * (len(sets[i]) + len(sets[k]) - both):
                    found.append((ids[i], ids[k]))
        kinds = block.schema.field("id").type
        return pa.table({"u": pa.array([u for u, _ in found], kinds), "v": pa.array([v for _, v in found], kinds)})

    blocks = placed.join(profiles, "id").groupBy("key", "a", "b")
    return blocks.applyInArrow(compare, f"u {kind}, v {kind}").distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id that confirmed links reach, ``kept``
    whether it is the row's own. Null and empty texts, and texts without words,
    are linked with nothing. Equal texts are always linked. Rows without an id
    are linked with nothing. Other columns are ignored, whatever their names.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = stored(sketches(texts), "sketches")
    sets = sketched.filter("set_hash IS NOT NULL AND id IS NOT NULL")
    classes = stored(sets.groupBy("set_hash").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "classes")

    rows = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("id"))
    buckets = stored(
        rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets"
    )
    members = stored(rows.join(buckets, "key").select("key", "id", "least"), "members")
    stars = members.filter("id > least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    stars = stored(stars.distinct(), "stars")
    links = stored(confirmed(stars, texts), "links")
    found = stored(components(links), "found")

    # Pairs that no star compared, in buckets whose documents are not yet one component.
    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component")
    )
    placed = stored(placed, "placed")
    mixed = stored(
        placed.groupBy("key")
        .agg(F.min("component").alias("a"), F.max("component").alias("b"))
        .filter("a < b")
        .select("key"),
        "mixed",
    )
    more = stored(_links_in_blocks(placed.join(mixed, "key", "left_semi"), texts), "more")
    if not more.isEmpty():
        found = stored(components(links.unionByName(more)), "found")

    labels = classes.select("set_hash", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    labels = stored(labels.select("set_hash", F.coalesce("component", "rep").alias("component_id")), "labels")
    linked = sets.join(labels, "set_hash").select("id", "n_shingles", "component_id")
    alone = sketched.filter("set_hash IS NULL OR id IS NULL").select(
        "id", "n_shingles", F.col("id").alias("component_id")
    )
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col),
        "n_shingles",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` of which no other row of their group has a smaller id.

    Rows with repeated ids, or without one, are numbered by id and content first.
    """
    ids = df.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if not ids.filter("n > 1 OR id IS NULL").isEmpty():
        order = [F.col(id_col).asc_nulls_last(), F.sha2(F.col(text_col), 256)]
        rows = stored(df.orderBy(*order).withColumn("__row", F.monotonically_increasing_id()), "rows")
        gone = near_groups(rows, "__row", text_col).filter(~F.col("kept")).select("__row")
        return rows.join(gone, "__row", "left_anti").drop("__row")
    gone = near_groups(df, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias("__gone"))
    return df.join(gone, df[id_col] == gone["__gone"], "left_anti")


@query("op1_minhash_dedup")
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
