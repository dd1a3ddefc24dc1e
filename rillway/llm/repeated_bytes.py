"""Repeated strings of 100 bytes, found by merging Burrows-Wheeler transforms of text shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.llm.bwt_merge import repeated
from rillway.llm.repeated_passages import text_tag, with_keys
from rillway.llm.word_arrays import Rolling, byte_values, chunks, mix, text_bytes
from rillway.session import scratch_path
from rillway.sources.fields import named

LENGTH = 100
GRAM = 24
# In buckets of more than BUCKET_STRETCHES different stretches, windows must share so many bytes to meet.
NARROW_GRAM = 64
# Bytes of text that are handled at once, so that their arrays stay in the processor's cache.
ANCHOR_BYTES = 1 << 17
MET, SPREAD = 1, 2
UPPER = np.uint64(0xFFFFFFFF00000000)
# Buckets are merged together up to so many bytes, and a bucket of more different stretches is cut up.
MERGE_BYTES = 1 << 19
BUCKET_STRETCHES = 20_000


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` neighbours by their upper half, the first of equals; doubling the reach."""
    least, reach = values & UPPER | np.arange(len(values), dtype=np.uint64), 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[step:], least[:-step])
        reach += step
    return (least & ~UPPER).astype(np.int64)


def _runs_of(part: np.ndarray, bounds: np.ndarray, gram: int) -> tuple:
    """Sums, gram hashes, and the runs of windows with one anchor, of some texts.

    The anchor of a window is the least of its grams' hashes, so equal windows have equal anchors at
    equal distances. A run is (text, first window, last window, anchor), as places in ``part``.
    """
    roll = Rolling(byte_values(3, False)[part])
    grams = roll.each(gram)
    anchor = _lowest(grams, LENGTH - gram + 1)
    begins = np.ones(len(anchor), bool)
    begins[1:] = anchor[1:] != anchor[:-1]
    # A run ends with its text: the windows that go over the end are runs of their own, and dropped.
    edges = np.concatenate([bounds, bounds[1:] - LENGTH + 1])
    begins[edges[(edges >= 0) & (edges < len(anchor))]] = True
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(anchor)) - 1 if len(first) else first
    owner = np.searchsorted(bounds, first, "right") - 1
    whole = first + LENGTH <= bounds[owner + 1]
    first = first[whole]
    return roll, grams, (owner[whole], first, last[whole], anchor[first])


def _anchored(column: pa.Array) -> Iterator[tuple]:
    """For chunks of texts: first row, bounds, length, and what ``_runs_of`` gives."""
    data, offsets = text_bytes(column)
    for low, high in chunks(offsets, ANCHOR_BYTES):
        part, bounds = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        yield low, bounds, len(part), *_runs_of(part, bounds, GRAM)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, text key, place, met) of the anchors of different texts.

    ``met`` tells of a hash that stands in another place of the batch too, and is so known to be shared: MET for one
    of its rows, SPREAD for the others, so that few rows of a frequent hash need to come together.
    """
    for batch in batches:
        keys, rows = np.unique(np.asarray(batch.column(0)), return_index=True)
        found = [
            (grams[anchor], keys[row + owner], (anchor - bounds[owner]).astype(np.int32))
            for row, bounds, _, _, grams, (owner, _, _, anchor) in _anchored(batch.column(1).take(pa.array(rows)))
        ]
        if not found:
            continue
        h, key, place = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(h)
        begins = np.ones(len(h) + 1, bool)
        begins[1:-1] = h[order][1:] != h[order][:-1]
        met = np.empty(len(h), np.int8)
        met[order] = np.where(begins[:-1], np.where(begins[1:], 0, MET), SPREAD)
        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(key), pa.array(place), pa.array(met)], ["h", "k1", "place", "met"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that stand in two places; rows come in the order of hash, text and place."""
    held = None
    for batch in batches:
        columns = [np.asarray(c) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held:
            columns = [np.concatenate(c) for c in zip(held, columns)]
        h, key, place, met = columns
        fresh, other = np.ones(len(h), bool), np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        other[1:] = fresh[1:] | (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        begins = np.flatnonzero(fresh)
        several = np.logical_or.reduceat((met > 0) | (other & ~fresh), begins)
        out = other & np.repeat(several, np.diff(np.append(begins, len(h))))
        yield pa.record_batch([pa.array(key[out]), pa.array(place[out])], ["k1", "place"])
        # A hash may go on in the next batch.
        held = [h[-1:], key[-1:], place[-1:], np.full(1, MET if several[-1] else 0, np.int8)]


def _run_rows(h: np.ndarray, roll: Rolling, first: np.ndarray, last: np.ndarray, ids: np.ndarray, spot: np.ndarray) -> pa.RecordBatch:
    c = roll.of(first, last + LENGTH).view(np.int64)
    size = (last + LENGTH - first).astype(np.int32)
    return pa.record_batch([pa.array(h.view(np.int64)), pa.array(c), pa.array(ids), pa.array(spot), pa.array(size)], ["h", "c", "id", "spot", "size"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor hash, hash of the bytes, id, spot, size) of the stretch that each shared anchor's windows cover."""
    for batch in batches:
        ids, keys, places = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
        for row, bounds, n, roll, grams, (owner, first, last, anchor) in _anchored(batch.column(2)):
            mine = places.slice(row, len(bounds) - 1)
            wanted = np.zeros(n, bool)
            wanted[np.asarray(mine.flatten()) + np.repeat(bounds[:-1], np.asarray(mine.value_lengths()))] = True
            keep = wanted[anchor] if len(anchor) else np.zeros(0, bool)
            owner, first, last, anchor = owner[keep], first[keep], last[keep], anchor[keep]
            spot = ((first - bounds[owner]) << 16) | (keys[row + owner] & 0xFFFF)
            yield _run_rows(grams[anchor], roll, first, last, ids[row + owner], spot)


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of crowded buckets, cut into the runs of one anchor of NARROW_GRAM bytes; rows as of ``_runs``."""
    for batch in batches:
        for id_, text, chosen in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = np.frombuffer(text.as_py().encode(), np.uint8)
            h, spots, size = (np.array([c[k] for c in chosen], np.int64) for k in ("h", "spot", "size"))
            bounds = np.concatenate([[0], np.cumsum(size)])
            start, tag = spots >> 16, int(spots[0]) & 0xFFFF
            part = data[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])]
            roll, grams, (owner, first, last, anchor) = _runs_of(part, bounds, NARROW_GRAM)
            bucket = mix(h[owner].view(np.uint64) * np.uint64(3) + grams[anchor])
            spot = ((start[owner] + first - bounds[owner]) << 16) | tag
            yield _run_rows(bucket, roll, first, last, np.full(len(first), id_, np.int64), spot)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, spot, bytes) of chosen stretches; windows one by one where a bucket is cut up."""
    for batch in batches:
        out = []
        for id_, text, chosen in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            data = text.as_py().encode()
            for c in chosen.as_py():
                start, tag = c["spot"] >> 16, c["spot"] & 0xFFFF
                piece = data[start : start + c["size"]]
                if c["parts"] == 1:
                    out.append((c["h"], id_, c["spot"], piece))
                    continue
                at = np.arange(len(piece) - LENGTH + 1)
                share = Rolling(byte_values(5, False)[np.frombuffer(piece, np.uint8)]).of(at, at + LENGTH) % np.uint64(c["parts"] * LENGTH)
                bucket = mix(share + np.array([c["h"]]).view(np.uint64)).view(np.int64)
                out += [(int(b), id_, ((start + i) << 16) | tag, piece[i : i + LENGTH]) for i, b in enumerate(bucket)]
            if len(out) > 2000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["bucket", "id", "spot", "data"])
                out = []
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["bucket", "id", "spot", "data"])


def _later(ids: np.ndarray, spots: np.ndarray, strings: list[bytes]) -> pa.RecordBatch:
    """Where the strings hold 100 bytes that begin earlier in another: (id, tag, begin, end)."""
    group, string, place = repeated(strings, LENGTH)
    start, tag, doc = (spots[string] >> 16) + place, spots[string] & 0xFFFF, ids[string]
    order = np.lexsort((start, doc, group))
    fresh = np.ones(len(order), bool)
    fresh[1:] = group[order][1:] != group[order][:-1]
    # One window may come in two overlapping stretches of one text: it is not its own repeat.
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    again = (doc[order] != doc[order][head]) | (start[order] != start[order][head])
    doc, tag, start = doc[order][again], tag[order][again], start[order][again]
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    begins = np.ones(len(doc), bool)
    begins[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return pa.record_batch([pa.array(doc[first]), pa.array(tag[first]), pa.array(start[first]), pa.array(start[last] + LENGTH)], ["id", "tag", "begin", "end"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets, in order, some at a time."""
    ids, spots, strings, size, last = [], [], [], 0, None
    for batch in batches:
        for bucket, id_, spot, data in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != last and size >= MERGE_BYTES:
                yield _later(np.array(ids), np.array(spots), strings)
                ids, spots, strings, size = [], [], [], 0
            ids.append(id_)
            spots.append(spot)
            strings.append(data)
            size, last = size + len(data), bucket
    if strings:
        yield _later(np.array(ids), np.array(spots), strings)


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, copy, spans) per row; spans (begin, end) hold all bytes of 100-byte strings that begin earlier.

    A string begins earlier in a text with a smaller id or further in front in the same text. Spans
    may overlap. ``copy`` says that an equal text has a smaller id; its windows are not listed.

    1. The anchor of a 100-byte window is the 24 bytes in it with the least hash. Equal windows have
       equal anchors. Anchors are dealt by hash, and those in one place only are dropped, and with
       them all windows that have no equal. A hash met twice in a batch is known to be shared: one of
       its rows goes there to tell the others, the rest anywhere.
    2. The windows of one anchor overlap and cover a stretch of about 140 bytes. Stretches with
       equal bytes are reduced to the first before anything else is compared, in each task before
       the shuffle, so frequent passages cost no more than rare ones.
    3. Different stretches with the same anchor are a bucket. Their shards' Burrows-Wheeler
       transforms are merged by interleave refinement to a depth of 100 symbols, and every interval
       of common prefixes of 100 is a string with all its places (``bwt_merge``); this compares
       bytes, not hashes. Buckets are independent. The stretches of one with over BUCKET_STRETCHES
       different ones are first cut by a longer anchor, of 64 bytes, and reduced and counted again; what
       is still a larger bucket is cut up by the hash of the window. Both keep equal windows together.

    Null and empty texts and those under 100 bytes lose nothing. A null id: nothing is removed and
    the row is no source. Rows that repeat an id count as one document. An empty table gives no rows.
    Other columns are neither read nor returned.
    """
    spark = docs.sparkSession

    def written(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.parquet(path)

    texts = with_keys(docs, id_col, text_col)
    narrow = texts.select("id", "k1", F.xxhash64(F.lit(1), "text").alias("k2"))
    first = narrow.groupBy("k1", "k2").agg(F.min("id").alias("first_id"))
    copies = narrow.join(first, ["k1", "k2"]).filter("first_id < id").select("id", text_tag("k1").alias("tag"))

    anchors = texts.select("k1", "text").mapInArrow(_anchors, "h long, k1 long, place int, met byte")
    dealt = anchors.repartition(F.when(F.col("met") == SPREAD, F.xxhash64("h", "k1", "place")).otherwise(F.col("h")))
    shared = dealt.sortWithinPartitions("h", "k1", "place").mapInArrow(_shared, "k1 long, place int")
    places = shared.groupBy("k1").agg(F.collect_list("place").alias("places"))
    sources = written(places.join(first.select("k1", F.col("first_id").alias("s_id")), "k1").withColumn("s_tag", text_tag("k1")).drop("k1"), "anchors")
    at_source = (F.col("id") == F.col("s_id")) & (text_tag("k1") == F.col("s_tag"))
    begin, tag = F.shiftright("spot", 16), F.col("spot").bitwiseAND(0xFFFF)
    run_schema = "h long, c long, id long, spot long, size int"

    def reduced(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stretches that equal an earlier one, and the others of buckets that hold several, with their number n."""
        firsts = runs.groupBy("h", "c").agg(F.min(F.struct("id", "spot", "size")).alias("f"))
        later = (
            runs.join(firsts, ["h", "c"]).filter("NOT (id = f.id AND spot = f.spot)")
            .select("id", tag.alias("tag"), begin.alias("begin"), (begin + F.col("size")).alias("end"))
        )
        several = firsts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
        return later, firsts.join(several, "h").select("h", "n", "f.id", "f.spot", "f.size")

    def by_text(chosen: DataFrame, *fields: str) -> DataFrame:
        per_text = chosen.groupBy(F.col("id").alias("s_id"), tag.alias("s_tag")).agg(F.collect_list(F.struct(*fields)).alias("chosen"))
        return texts.join(per_text, at_source).select("id", "text", "chosen")

    runs = texts.join(sources, at_source).select("id", "k1", "text", "places").mapInArrow(_runs, run_schema)
    later, found = reduced(written(runs, "runs"))
    found = written(found, "found")
    crowded = F.col("n") > BUCKET_STRETCHES
    narrowed = by_text(found.filter(crowded), "h", "spot", "size").mapInArrow(_narrowed, run_schema)
    more, narrow = reduced(written(narrowed, "narrowed"))
    chosen = found.filter(~crowded).unionByName(narrow).withColumn("parts", F.ceil(F.col("n") / BUCKET_STRETCHES).cast("int"))
    per_text = by_text(chosen, "h", "parts", "spot", "size")
    stretches = per_text.mapInArrow(_stretches, "bucket long, id long, spot long, data binary")
    merged = stretches.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged, "id long, tag long, begin long, end long")
    spans = later.unionByName(more).unionByName(merged).groupBy("id", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("spans"), F.lit(False).alias("copy"))
    marks = spans.unionByName(
        copies.distinct().select("id", "tag", F.lit(None).cast("array<struct<begin:bigint,end:bigint>>").alias("spans"), F.lit(True).alias("copy"))
    ).withColumnsRenamed({"id": "s_id", "tag": "s_tag"})
    marked = texts.join(marks, at_source, "left")
    rest = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text")).filter("id IS NULL OR text IS NULL")
    none = F.lit(None).cast("array<struct<begin:bigint,end:bigint>>").alias("spans")
    return marked.select("id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans").unionByName(
        rest.select("id", "text", F.lit(False).alias("copy"), none)
    )


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]).add("kept", T.BinaryType()))
def kept_bytes(text: pa.Array, copy: pa.Array, spans: pa.Array) -> pa.Array:
    """What stays of the UTF-8 bytes, and how many bytes and unbroken stretches went."""
    rows = []
    data, offsets = text_bytes(text)
    begins, ends = (np.asarray(spans.flatten().field(i)) for i in (0, 1))
    counts = np.asarray(pc.fill_null(pc.list_value_length(spans), 0))
    at = np.cumsum(counts) - counts
    for i, c in enumerate(copy.to_pylist()):
        whole, mine = data[offsets[i] : offsets[i + 1]].tobytes(), slice(at[i], at[i] + counts[i])
        if c and len(whole) >= LENGTH:
            rows.append((len(whole), len(whole), 1, b""))
            continue
        order = np.argsort(begins[mine])
        begin, end = begins[mine][order], np.maximum.accumulate(ends[mine][order])
        # Spans that overlap or touch are one unbroken stretch.
        apart = np.flatnonzero(begin[1:] > end[:-1])
        cut = np.concatenate([begin[:1], begin[apart + 1]]).tolist()
        go_on = np.concatenate([end[apart], end[-1:]]).tolist()
        kept = b"".join(whole[s:e] for s, e in zip([0, *go_on], [*cut, len(whole)]))
        rows.append((len(whole), len(whole) - len(kept), len(cut), kept))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n_bytes", "n_removed", "n_spans", "kept"])
