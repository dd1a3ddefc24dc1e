"""Repeated passages of words: anchors at difference-cover positions, then windows around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.llm.word_arrays import Rolling, split_words
from rillway.session import scratch_path
from rillway.sources.fields import named

WINDOW = 50
# A perfect difference set: every number modulo PERIOD is a difference of two of COVER in one way.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
# Two equal windows begin at any two places; within PERIOD - 1 words both pass a cover position at once.
ANCHOR = WINDOW - PERIOD + 1


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, text key, place) of the ANCHOR words from each cover position, of texts with a window."""
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True
    for batch in batches:
        keys = np.asarray(batch.column(0))
        for words in split_words(batch.column(1)):
            counts = words.counts()
            roll = Rolling(words.hashes())
            at = words.windows(ANCHOR)
            owner = np.searchsorted(words.first, at, "right") - 1
            place = at - words.first[owner]
            keep = covered[place % PERIOD] & (counts[owner] >= WINDOW)
            at, owner, place = at[keep], owner[keep], place[keep]
            yield pa.record_batch(
                [pa.array(roll.of(at, at + ANCHOR).view(np.int64)), pa.array(keys[words.row + owner]), pa.array(place, pa.int32())],
                ["h", "k1", "place"],
            )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that stand in two different texts; rows come in the order of hash and text.

    The first and the last hash of a partition may go on in the next one, so they count as shared:
    an anchor too many costs some windows and changes no result. A hash that so far was seen in one
    text only is held back; that is no more than the places of one text.
    """
    held = np.empty((0, 3), np.int64)
    known = True
    for batch in batches:
        rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)
        rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        begins = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        ends = np.append(begins[1:], len(rows))
        several = rows[begins, 1] != rows[ends - 1, 1]
        several[0] |= known
        # A hash of which everything was already passed on leaves one row behind as a mark.
        out = np.repeat(several, ends - begins)
        tail = rows[begins[-1] :]
        known = bool(several[-1])
        held = tail[-1:] if known else np.unique(tail, axis=0)
        found = rows[out]
        yield pa.record_batch([pa.array(found[:, 1]), pa.array(found[:, 2].astype(np.int32))], ["k1", "place"])
    if len(held):
        yield pa.record_batch([pa.array(held[:, 1]), pa.array(held[:, 2].astype(np.int32))], ["k1", "place"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(two hashes, id, spot) of every window that holds a shared anchor.

    The spot is the place, with 16 bits of the text key that tell texts of one id apart.
    """
    for batch in batches:
        ids, keys, places = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
        for words in split_words(batch.column(2)):
            n = len(words.counts())
            mine = places.slice(words.row, n)
            anchors = np.asarray(mine.flatten())
            owner = np.repeat(np.arange(n), np.asarray(mine.value_lengths()))
            at = words.first[owner] + anchors
            # A window holds the anchor if it begins at most WINDOW - ANCHOR words before it.
            delta = np.zeros(len(words.start) + 1, np.int32)
            np.add.at(delta, np.maximum(at - (WINDOW - ANCHOR), words.first[owner]), 1)
            np.add.at(delta, at + 1, -1)
            near = np.cumsum(delta)[:-1] > 0
            start = words.windows(WINDOW)
            start = start[near[start]]
            owner = np.searchsorted(words.first, start, "right") - 1
            first, second = (Rolling(words.hashes(seed)).of(start, start + WINDOW) for seed in (0, 1))
            spot = ((start - words.first[owner]) << 16) | (keys[words.row + owner] & 0xFFFF)
            yield pa.record_batch(
                [pa.array(first.view(np.int64)), pa.array(second.astype(np.uint32).view(np.int32)), pa.array(ids[words.row + owner]), pa.array(spot)],
                ["h1", "h2", "id", "spot"],
            )


def removed_words(n_words: int, starts: list[int] | None, copy: bool) -> np.ndarray:
    """Which words the removed windows cover."""
    if copy and n_words >= WINDOW:
        return np.ones(n_words, bool)
    delta = np.zeros(n_words + 1, np.int32)
    if starts:
        begin = np.asarray(starts)
        np.add.at(delta, begin, 1)
        np.add.at(delta, begin + WINDOW, -1)
    return np.cumsum(delta[:-1]) > 0


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    return rows.filter("id IS NOT NULL AND text IS NOT NULL").withColumn("k1", _text_key(F.col("text")))


def repeat_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, copy, starts): what of each text stands in a text with a smaller id, where there is any.

    The tag is 16 bits of the text's hash. ``starts`` holds the first words of the windows of 50 words that also
    begin in a document with a smaller id. ``copy`` says that the whole text has an equal one with a
    smaller id, in which case the windows are not listed.

    1. The hash of 20 words is taken at places 1, 5, 11, 24, 25, 27 modulo 31 of each text, a fifth
       of all places. Two equal windows, wherever they begin, have such an anchor in common.
    2. Anchors are sorted by hash and text over ranges that cut through a hash, so an anchor of any
       frequency is spread; those in one text only are dropped. Equal texts count as one text.
    3. Around shared anchors, and only there, each window gets a 96-bit hash; the smallest id per
       hash is an aggregate, reduced in each task before the shuffle.

    A null id: nothing is removed and the row is no source. Rows that repeat an id are no sources for
    each other. Null, blank and short texts (under 50 words) stay as they are. An empty table gives
    no rows. Other columns are neither read nor returned.
    """
    texts = with_keys(docs, id_col, text_col)
    narrow = texts.select("id", "k1", F.xxhash64(F.lit(1), "text").alias("k2"))
    first = narrow.groupBy("k1", "k2").agg(F.min("id").alias("first_id"))
    copies = narrow.join(first, ["k1", "k2"]).filter("first_id < id").select("id", "k1").distinct()

    anchors = texts.select("k1", "text").mapInArrow(_anchors, "h long, k1 long, place int")
    ordered = anchors.repartitionByRange("h", "k1", "place").sortWithinPartitions("h", "k1")
    shared = ordered.mapInArrow(_shared, "k1 long, place int").distinct()
    places = shared.groupBy("k1").agg(F.collect_list("place").alias("places"))
    sources = places.join(first.select("k1", F.col("first_id").alias("s_id")), "k1").withColumn("s_tag", text_tag("k1")).drop("k1")
    path = scratch_path(docs.sparkSession, "anchors")
    sources.write.parquet(path)
    sources = docs.sparkSession.read.parquet(path)
    windows = (
        texts.join(sources, (F.col("id") == F.col("s_id")) & (text_tag("k1") == F.col("s_tag"))).select("id", "k1", "text", "places")
        .mapInArrow(_windows, "h1 long, h2 int, id long, spot long")
    )
    lowest = windows.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    place, tag = F.shiftright("spot", 16).cast("int"), F.col("spot").bitwiseAND(0xFFFF)
    hits = windows.join(lowest, ["h1", "h2"]).filter("low < id").select("id", tag.alias("tag"), place.alias("place"))
    starts = hits.groupBy("id", "tag").agg(F.sort_array(F.collect_set("place")).alias("starts"), F.lit(False).alias("copy"))
    return starts.select("id", "tag", "copy", "starts").unionByName(
        copies.select("id", text_tag("k1").alias("tag"), F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("starts")).distinct()
    )


def text_tag(key: str) -> Column:
    return F.col(key).bitwiseAND(0xFFFF)


def mark_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, copy, starts) for every row, from ``repeat_marks``; ``kept_words`` applies them.

    Texts are shuffled once, by id, for both the windows and the result.
    """
    texts = with_keys(docs, id_col, text_col)
    marks = repeat_marks(docs, id_col, text_col).withColumnsRenamed({"id": "m_id", "tag": "m_tag"})
    marked = texts.join(marks, (texts["id"] == marks["m_id"]) & (text_tag("k1") == F.col("m_tag")), "left")
    rest = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text")).filter("id IS NULL OR text IS NULL")
    none = rest.select("id", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<int>").alias("starts"))
    return marked.select("id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts").unionByName(none)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated passages cut out of the text.

    ``length_col`` is set to the characters left where a text was cut.
    """
    columns = docs.columns
    named_by_place = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    id_, text = (f"c{columns.index(c)}" for c in (id_col, text_col))
    marks = repeat_marks(docs, id_col, text_col).withColumnsRenamed({"id": "m_id", "tag": "m_tag"})
    tag = _text_key(F.col(text).cast("string")).bitwiseAND(0xFFFF)
    joined = named_by_place.join(marks, (F.col(id_).cast("long") == F.col("m_id")) & (tag == F.col("m_tag")), "left")
    cut = joined.withColumn("cut", cut_text(text, F.coalesce("copy", F.lit(False)), "starts"))
    new = {text: F.col("cut")}
    if length_col in columns:
        old = F.col(f"c{columns.index(length_col)}")
        new[f"c{columns.index(length_col)}"] = F.when(F.col("cut") == F.col(text), old).otherwise(F.coalesce(F.length("cut"), old).cast(docs.schema[length_col].dataType))
    return cut.select(*[new.get(f"c{i}", F.col(f"c{i}")).alias(c) for i, c in enumerate(columns)])


@F.arrow_udf(T.StructType().add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept", T.StringType()))
def kept_words(text: pa.Array, copy: pa.Array, starts: pa.Array) -> pa.Array:
    """The words that stay, joined by one space."""
    counts, gone, kept = [], [], []
    for t, c, s in zip(text, copy, starts):
        words = (t.as_py() or "").encode().split()
        removed = removed_words(len(words), s.as_py(), c.as_py())
        counts.append(len(words))
        gone.append(int(removed.sum()))
        kept.append(b" ".join(w for w, r in zip(words, removed) if not r).decode() if gone[-1] else b" ".join(words).decode())
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])


@F.arrow_udf(T.StringType())
def cut_text(text: pa.Array, copy: pa.Array, starts: pa.Array) -> pa.Array:
    """The text without the removed words; the white space after a removed word goes with it."""
    out = []
    for t, c, s in zip(text, copy, starts):
        value, c, s = t.as_py(), c.as_py(), s.as_py()
        if value is not None and (c or s):
            words = next(split_words(pa.array([value], pa.string())))
            removed = removed_words(len(words.start), s, c)
            if removed.any():
                data = value.encode()
                bounds = np.append(words.start, len(data))
                pieces = [data[: bounds[0]]] + [data[a:b] for a, b, r in zip(bounds[:-1], bounds[1:], removed) if not r]
                value = b"".join(pieces).decode()
        out.append(value)
    return pa.array(out, pa.string())
