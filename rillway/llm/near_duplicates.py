"""Near-duplicate documents: SuperMinHash signatures, bands, full verification, union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.groups import connected
from rillway.llm.word_arrays import mix, split_words
from rillway.session import scratch_path
from rillway.sources.fields import named

SHINGLE = 5
PERCENT = 75
# 32 bands of 4 ranks: two sets at 0.75 share no band with probability (1 - 0.75**4)**32 = 5e-6.
RANKS = 128
BAND_RANKS = 4
# Shingles of at most so many open texts count as rare.
RARE = 4
# Longs of a text's parities: one bit per class of shingles, whether it has an odd number of them.
PARITY_LONGS = 16
# Members that one copy of a centre's text is compared with.
CENTRE_LOAD = 256


def shingle_hashes(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of texts: the first row, the distinct shingle hashes in order, and where each text's begin."""
    for words in split_words(texts):
        h, counts = words.hashes(fold_case=True), words.counts()
        at = words.windows(k)
        grams = np.zeros(len(at), np.uint64)
        for i in range(k):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[at + i]
        grams = mix(grams + np.uint64(k))
        owner = np.searchsorted(words.first, at, "right") - 1
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            whole = np.zeros(len(few), np.uint64)
            for i in range(k - 1):
                more = counts[few] > i
                whole[more] = whole[more] * np.uint64(0x9E3779B97F4A7C15) + h[words.first[few[more]] + i]
            grams = np.concatenate([grams, mix(whole + counts[few].astype(np.uint64))])
            owner = np.concatenate([owner, few])
            order = np.argsort(owner, kind="stable")
            grams, owner = grams[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
        for s, e in zip(bounds[:-1], bounds[1:]):
            grams[s:e].sort()
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        yield words.row, grams[fresh], np.searchsorted(owner[fresh], np.arange(len(counts) + 1))


def superminhash(grams: np.ndarray, bounds: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """A row of ``ranks`` numbers per set: the least (step, random number) that reached each rank.

    Every element walks through the ranks in an order of its own, a permutation drawn step by step
    (Fisher-Yates), so its ranks are correlated: each is hit once. In step j it offers the value
    (j, random). A set is done as soon as no rank could still be improved by step j or later; large
    sets stop after one or two steps. All elements of all unfinished sets take a step together.
    """
    n_sets = len(bounds) - 1
    out = np.full(n_sets * ranks, np.iinfo(np.int64).max, np.int64)
    owner = np.repeat(np.arange(n_sets), np.diff(bounds))
    walks = None
    for step in range(ranks):
        if not len(grams):
            break
        drawn = mix(grams + np.uint64((step + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        left = np.uint64(ranks - step)
        pick = step + (((drawn & np.uint64(0xFFFFFFFF)) * left) >> np.uint64(32)).astype(np.int64)
        value = (drawn >> np.uint64(32)).astype(np.int64) | np.int64(step << 32)
        line = np.arange(len(grams))
        rank = pick if walks is None else walks[line, pick].astype(np.int64)
        np.minimum.at(out, owner * ranks + rank, value)
        open_sets = out.reshape(n_sets, ranks).max(axis=1) >= np.int64((step + 1) << 32)
        keep = open_sets[owner]
        if walks is None:
            grams, owner, pick, line = grams[keep], owner[keep], pick[keep], np.arange(int(keep.sum()))
            walks = np.tile(np.arange(ranks, dtype=np.uint8 if ranks <= 256 else np.uint16), (len(grams), 1))
            walks[line, pick], walks[line, 0] = 0, pick
        else:
            walks[line, pick], walks[line, step] = walks[line, step], rank
            if keep.sum() < 0.7 * len(keep):
                grams, owner, walks = grams[keep], owner[keep], walks[keep]
    return out.reshape(n_sets, ranks)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for row, grams, bounds in shingle_hashes(batch.column(1)):
            n = len(bounds) - 1
            ranks = mix(superminhash(grams, bounds).view(np.uint64)).astype(np.uint16)
            sizes = np.diff(bounds)
            keys = [hashlib.md5(grams[s:e].tobytes()).digest() if e > s else None for s, e in zip(bounds[:-1], bounds[1:])]
            signatures = [ranks[i].tobytes() if sizes[i] else None for i in range(n)]
            yield pa.record_batch(
                [ids.slice(row, n), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
                ["id", "n_shingles", "set_key", "signature"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_bands = RANKS // BAND_RANKS
    for batch in batches:
        ids = np.asarray(batch.column(0).cast(pa.int64()))
        if not len(ids):
            continue
        flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), n_bands, BAND_RANKS)
        key = np.zeros((len(ids), n_bands), np.uint64) + np.arange(1, n_bands + 1, dtype=np.uint64)
        for i in range(BAND_RANKS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + flat[:, :, i].astype(np.uint64))
        yield pa.record_batch([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, n_bands))], ["bucket", "id"])


def shingle_set(text: str | None, k: int = SHINGLE) -> set:
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(k)]))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the full shingle sets of each pair; the set of a centre is kept from row to row."""
    last, last_set = None, set()
    for batch in batches:
        a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
        linked = []
        for i in range(len(a)):
            if (a[i], text_a[i]) != last:
                last, last_set = (a[i], text_a[i]), shingle_set(text_a[i])
            other = shingle_set(text_b[i])
            both = len(other & last_set)
            linked.append(100 * both >= PERCENT * (len(other) + len(last_set) - both))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in 9/16 of the ranks: at 0.75, fewer agree with probability 1e-6."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, RANKS) for c in batch.columns[2:4])
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array((x == y).sum(axis=1) * 16 >= 9 * RANKS))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked). A centre ``a`` with many partners is copied once per CENTRE_LOAD of them."""
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / CENTRE_LOAD).cast("int").alias("copies"))
    centres = (
        texts.join(load, texts["id"] == load["a"])
        .select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("text").alias("text_a"))
    )
    dealt = pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    members = dealt.join(texts, dealt["b"] == texts["id"]).select("a", "copy", "b", F.col("text").alias("text_b"))
    return members.join(centres, ["a", "copy"]).select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long, linked boolean")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    several = rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    return rows.join(several.select("bucket"), "bucket", "left_semi")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for row, grams, bounds in shingle_hashes(batch.column(1)):
            owner = np.repeat(ids[row : row + len(bounds) - 1], np.diff(bounds))
            yield pa.record_batch([pa.array(grams.view(np.int64)), pa.array(owner)], ["gram", "id"])


def _possible(between: DataFrame, near: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components of ``between`` (bucket, b, component) that could be linked.

    Sets of n_x and n_y shingles are linked if they share 3/7 (n_x + n_y) or more. They share at most
    min(n_x - rare_x, n_y - rare_y) + both, where rare counts a set's shingles that at most RARE open
    texts have, and both those that x and y have in common. Pairs with a rare shingle in common come
    from a join on rare shingles, which makes at most RARE / 2 pairs per row; for all other pairs of
    a bucket both is 0. Those are counted closer: the other shingles fall into classes, and each class of which one of
    x and y has an odd number and the other an even one holds a shingle that is in one of them only. With d such
    classes they share at most (m_x + m_y - d) / 2 of their m_x and m_y other shingles. Pairs below a bound are not
    linked, so leaving them out loses nothing.
    """
    spark = between.sparkSession
    part = between.select("b", "component").distinct()
    texts = near.join(part.select(F.col("b").alias("id")), "id", "left_semi").select("id", "text")
    path = scratch_path(spark, "shingles")
    texts.mapInArrow(_listed, "gram long, id long").distinct().write.parquet(path)
    grams = spark.read.parquet(path)
    seldom = grams.groupBy("gram").agg(F.count("*").alias("texts")).filter(f"texts <= {RARE}")
    rare = grams.join(seldom, "gram").select("gram", "texts", "id")
    counts = rare.groupBy("id").agg(F.count("*").alias("rare"))
    known = (
        sizes.join(part, sizes["id"] == part["b"]).join(counts, "id", "left")
        .select("id", "component", F.col("n_shingles").alias("n"), F.coalesce("rare", F.lit(0)).alias("rare"))
    )

    def bounded(both: str) -> str:
        return f"7 * (least(n_a - rare_a, n_b - rare_b) + {both}) >= 3 * (n_a + n_b) AND 4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)"

    twice = rare.filter("texts > 1").select("gram", "id").join(known, "id")
    left = twice.select("gram", F.col("id").alias("a"), F.col("component").alias("c"), F.col("n").alias("n_a"), F.col("rare").alias("rare_a"))
    right = twice.select("gram", F.col("id").alias("b"), F.col("component").alias("e"), F.col("n").alias("n_b"), F.col("rare").alias("rare_b"))
    # Two texts have at most the rare shingles of either in common, so most pairs need not be counted.
    met = left.join(right, "gram").filter("a < b AND c <> e AND " + bounded("least(rare_a, rare_b)"))
    by_shingle = met.groupBy("a", "b", "n_a", "n_b", "rare_a", "rare_b").agg(F.count("*").alias("both")).filter(bounded("both")).select("a", "b")

    facts = known.filter("4 * rare <= n").select(F.col("id").alias("b"), "n", "rare")
    # Written, as the rows are read again for the main components, those outside of them, and the others.
    path = scratch_path(spark, "facts")
    _mixed(between.join(facts, "b")).write.parquet(path)
    rows = spark.read.parquet(path)
    common = grams.join(rows.select(F.col("b").alias("id")), "id", "left_semi").join(seldom, "gram", "left_anti")
    parity = [
        F.expr(f"bit_xor(IF((shiftright(gram, 6) & {PARITY_LONGS - 1}) = {k}, shiftleft(1L, CAST(gram & 63 AS INT)), 0L)) AS s{k}")
        for k in range(PARITY_LONGS)
    ]
    path = scratch_path(spark, "parities")
    rows.join(common.groupBy(F.col("id").alias("b")).agg(F.count("*").alias("m"), *parity), "b").write.parquet(path)
    rows = spark.read.parquet(path)
    largest = (
        rows.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        .groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    )
    own = ["n", "rare", "m", *(f"s{k}" for k in range(PARITY_LONGS))]
    few = rows.join(largest, "bucket").filter("component <> main").select(
        "bucket", F.col("b").alias("p"), F.col("component").alias("c"), *(F.col(x).alias(f"{x}_a") for x in own)
    )
    others = rows.withColumnsRenamed({x: f"{x}_b" for x in own})
    odd = " + ".join(f"bit_count(s{k}_a ^ s{k}_b)" for k in range(PARITY_LONGS))
    closer = f"7 * (m_a + m_b - ({odd})) >= 6 * (n_a + n_b)"
    by_bucket = few.join(others, "bucket").filter(f"component <> c AND {bounded('0')} AND {closer}").select(F.least("p", "b").alias("a"), F.greatest("p", "b").alias("b"))
    return by_shingle.unionByName(by_bucket).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with n_shingles, component_id (smallest id reachable) and kept, beside the id.

    Texts are linked whose sets of 5-word shingles (A-Z as a-z, fewer words: one shingle) have a
    Jaccard similarity of 0.75 or more.

    1. One scan makes a SuperMinHash signature and a key of the full set per text.
    2. Texts with equal sets become one class, represented by the smallest id.
    3. Representatives meet in the buckets of their bands. In each bucket all are compared with one
       centre, the text that meets most others over all its buckets, so a bucket of any size makes
       as many pairs as it has members. Copies of one text with changes of their own are all linked
       to their cleanest copy if they are linked to any.
    4. What this leaves in several components is compared pair by pair, but only where rare
       shingles leave room for a link (see ``_possible``) and 9/16 of the ranks agree. So no pair
       that shares a bucket is left open, and pairs within a component are not expanded.
    5. Links found in 3 and 4 are grouped by distributed union-find.

    Texts travel only for the pairs' ids. Ranks, buckets and links never reach the driver.

    Null or blank texts: 0 shingles, a component of their own. Null ids: component null, kept. Rows
    that repeat an id are each judged by their own text. An empty table gives no rows. Other
    columns of ``docs``, whatever their names, are neither read nor returned.
    """
    spark = docs.sparkSession
    texts = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))

    def written(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.parquet(path)

    sketches = written(texts.mapInArrow(_sketch, "id long, n_shingles long, set_key binary, signature binary"), "signatures")
    filled = sketches.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = filled.groupBy("set_key").agg(F.min("id").alias("rep"))
    reps = written(
        filled.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "n_shingles", "signature"), "classes"
    )
    buckets = reps.select("id", "signature").mapInArrow(_bands, "bucket long, id long")
    sizes = buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("size")).filter("a < z")
    joint = written(buckets.join(sizes.select("bucket", "size"), "bucket"), "buckets")
    met = joint.groupBy("id").agg(F.sum("size").alias("met"))
    centres = joint.join(met, "id").groupBy("bucket").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("a"))
    shared = written(joint.join(centres, "bucket").select("bucket", "a", F.col("id").alias("b")), "buckets")
    stars = written(shared.filter("a <> b").select("a", "b").distinct(), "stars")
    wanted = shared.select(F.col("b").alias("id")).distinct()
    near = written(texts.join(wanted, "id", "left_semi"), "texts")
    first = written(_verify(stars, near), "verified")
    links = first.filter("linked").select("a", "b")
    part = connected(links)

    # What shares a bucket without being in one component yet.
    held = shared.join(part, shared["b"] == part["node"], "left").select(
        "bucket", "b", F.coalesce("component", "b").alias("component")
    )
    between = written(_mixed(held), "open")
    pairs = _possible(between, near, reps.select("id", "n_shingles")).join(
        stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"
    )
    signed = (
        pairs.join(reps.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a")
        .join(reps.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long")
    )
    second = written(_verify(written(signed, "pairs"), near), "verified")
    part = connected(links.unionByName(second.filter("linked").select("a", "b")))

    classed = classes.join(part, classes["rep"] == part["node"], "left").select(
        "set_key", F.coalesce("component", "rep").alias("component")
    )
    grouped = filled.join(classed, "set_key").select("id", "n_shingles", "component")
    alone = sketches.filter("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component"))
    return grouped.unionByName(alone).select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
    )
