"""Packing tokenized documents into sequences: dominance reduction, then best fit."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.session import scratch_path
from rillway.sources.fields import named

CAPACITY = 2048
END_ID = 0
# Bytes that a worker process may take to remember the ids of pre-tokens.
REMEMBERED_BYTES = 96 << 20
# Characters of texts that are looked up together: new pre-tokens go to the tokenizer in few calls.
TOGETHER = 1 << 18
# What an entry takes besides its key and value.
ENTRY_BYTES = 200


class Memory:
    """Ids by text, as many as fit a bound of bytes: the latest used.

    Two halves: when the newer one is full, it becomes the older one, which is forgotten but for what is asked for
    again. The parts of texts looked up together are held whatever their size, until the next ones.
    """

    def __init__(self, most: int = REMEMBERED_BYTES):
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most, self.size = most // 2, 0

    def missing(self, keys: list[str]) -> list[str]:
        """Those of the keys that are not remembered; all others are in ``known`` then, until the next call."""
        if self.size > self.most:
            self.known, self.older, self.size = {}, self.known, 0
        absent = set(filterfalse(self.known.__contains__, keys))
        again = {k: v for k in absent if (v := self.older.get(k)) is not None}
        self.add(again.items())
        return [k for k in absent if k not in again]

    def add(self, entries: Iterable[tuple[str, bytes]]) -> None:
        for key, value in entries:
            self.known[key] = value
            self.size += len(key) + len(value) + ENTRY_BYTES


# Up to here all Unicode versions class characters alike.
SURE_CHARS = 0x558


def spelled_out(pattern: str) -> str:
    """A pattern of ``regex`` with its character classes as ranges, which ``re`` knows, for texts below SURE_CHARS."""
    import regex

    def ranges(name: str) -> str:
        fits = [bool(regex.fullmatch(name, chr(c))) for c in range(SURE_CHARS)]
        starts = [c for c, x in enumerate(fits) if x and not (c and fits[c - 1])]
        ends = [c for c, x in enumerate(fits) if x and not (c + 1 < SURE_CHARS and fits[c + 1])]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))

    name = r"\\(?:p\{\w+\}|[sS])"

    def spelled(found) -> str:
        part = found[0]
        if part[0] == "[":
            return regex.sub(name, lambda inner: ranges(inner[0]), part)
        return f"[{ranges(part)}]" if regex.fullmatch(name, part) else part

    return regex.sub(rf"\[(?:\\.|[^\]\\])*\]|{name}|\\.", spelled, pattern)


def one_quote(pattern: str) -> str:
    """The same pattern with its leading alternatives that begin with a quote as one: others are ruled out by one look."""
    import re

    found = re.match(r"(?:'\w+\|){2,}", pattern)
    return f"'(?:{found[0][:-1].replace("'", "")})|{pattern[found.end() :]}" if found else pattern


@cache
def _encoder_of_many(path: str, pattern: str):
    """Texts to the bytes of their little-endian 32-bit ids, one by one.

    Byte-level BPE never merges across the pre-tokens that ``pattern`` finds, so ids are looked up
    per pre-token and only new ones go to the tokenizer, those of some texts together and as lines of one. Characters that Unicode versions class
    differently are left to the tokenizer, with the part of the text around them: a pre-token that holds a
    space behind another character is white space only, so a text may be cut before each space
    that follows another than a white-space character.

    A string of an added token inside a text is that token, as in the tokenizer's plain call; what
    lies between such strings is encoded by itself. A worker process keeps its encoder for its next
    tasks.
    """
    import re

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = {a.content: a for a in tokenizer.get_added_tokens_decoder().values()}
    # With these flags a token takes in, or depends on, what stands beside it.
    plain = not any(a.lstrip or a.rstrip or a.single_word or a.normalized for a in added.values())
    between = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split
    split = re.compile(spelled_out(one_quote(pattern))).findall
    cut = re.compile(r"(?<=\S)(?= )").split
    unsure = re.compile(f"[^\0-{chr(SURE_CHARS - 1)}]").search
    # Between line ends such a pre-token stays one, with the same ids, and the line ends stay tokens of their own.
    solid = re.compile(" ?[!-~\u00a1-\u0557]+").fullmatch
    memory = Memory()

    def pre_tokens(text: str) -> list[str]:
        if text.isascii() or not unsure(text):
            return split(text)
        return [p for part in cut(text) for p in ([part] if unsure(part) else split(part))]

    def encoded(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    line_end = encoded(["\n"])[0]

    def lines_encoded(lines: list[str]) -> list[bytes]:
        """As ``encoded``, of pre-tokens for which ``solid`` holds, as one text."""
        ids = np.frombuffer(encoded(["\n" + "\n".join(lines)])[0], "<u4")
        ends = np.flatnonzero(ids == np.frombuffer(line_end, "<u4")) * 4 if len(line_end) == 4 else ()
        if len(ends) != len(lines):
            return encoded(lines)
        raw, ends = ids.tobytes(), [*ends.tolist(), len(ids) * 4]
        return [raw[start + 4 : end] for start, end in zip(ends, ends[1:])]

    def learn(new: list[str]) -> None:
        lines = [p for p in new if solid(p)]
        others = [p for p in new if not solid(p)] if len(lines) < len(new) else []
        for some, encode_some in ((lines, lines_encoded), (others, encoded)):
            for low in range(0, len(some), 1000):
                part = some[low : low + 1000]
                memory.add(zip(part, encode_some(part)))

    def looked_up(texts: list[str]) -> list[bytes]:
        parts = [pre_tokens(t) for t in texts]
        found = [list(map(memory.known.get, p)) for p in parts]
        places = [[i for i, ids in enumerate(f) if ids is None] if None in f else [] for f in found]
        learn(memory.missing([p[i] for p, at in zip(parts, places) for i in at]))
        for p, f, at in zip(parts, found, places):
            for i in at:
                f[i] = memory.known[p[i]]
        return [b"".join(f) for f in found]

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def with_added(text: str) -> bytes:
        return b"".join(whole(t) if t in added else looked_up([t])[0] for t in between(text) if t) if plain else whole(text)

    def encode(texts: Iterable[str]) -> Iterator[bytes]:
        held, size = [], 0

        def done() -> Iterator[bytes]:
            marked = [any(a in t for a in added) for t in held]
            usual = iter(looked_up([t for t, m in zip(held, marked) if not m]))
            return (with_added(t) if m else next(usual) for t, m in zip(held, marked))

        for text in texts:
            if held and size + len(text) > TOGETHER:
                yield from done()
                held, size = [], 0
            held.append(text)
            size += len(text)
        yield from done()

    return encode


def _encoder(path: str, pattern: str):
    """Of one text."""
    return lambda text: next(_encoder_of_many(path, pattern)([text]))


def _pieces(path: str, pattern: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part, seen = _encoder_of_many(path, pattern), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(text.as_py() or "" for text in batch.column(1))):
                ids += np.array([END_ID], "<u4").tobytes()
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    length = end - start
                    rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * end]), part, seen[length]))
                    seen[length] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


Pattern = tuple[tuple[int, int], ...]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Sets that some best packing holds; their items are taken out of ``counts``.

    A feasible set with item j dominates all sets with j if each of those could be swapped into it
    part by part. That holds for j alone where nothing else fits; for j and the largest item beside
    it, if that fills the sequence, if no two more items fit, or if no three fit and no two together
    are larger than it. Equal items are handled as one number, until nothing changes.
    """
    fixed: list[tuple[int, Pattern]] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                counts[j] -= 1
                sizes = sorted(s for s, n in counts.items() if n)
                low = [s for s in sizes[:3] for _ in range(min(3, counts[s]))][:3]
                room = capacity - j
                at = bisect.bisect_right(sizes, room) - 1
                counts[j] += 1
                if at < 0:
                    fixed.append((counts.pop(j), ((j, 1),)))
                    changed = True
                    break
                k = sizes[at]
                single = k == room or len(low) < 2 or low[0] + low[1] > room
                if not single and (len(low) < 3 or sum(low) > room):
                    single = k >= _best_pair(sizes, counts, j, room)
                if not single:
                    break
                times = counts[j] // 2 if k == j else min(counts[j], counts[k])
                if not times:
                    break
                fixed.append((times, ((j, 2),) if k == j else ((j, 1), (k, 1))))
                for s in (j, k):
                    counts[s] -= times
                    if not counts[s]:
                        del counts[s]
                        if s == k == j:
                            break
                changed = True
    return fixed


def _best_pair(sizes: list[int], counts: dict[int, int], j: int, room: int) -> int:
    """The largest sum of two items, beside one of size j, within ``room``."""
    best, a, b = 0, 0, len(sizes) - 1
    while a <= b:
        total = sizes[a] + sizes[b]
        free = counts[sizes[a]] - (sizes[a] == j)
        if total > room or (a == b and free < 2):
            b -= 1
        else:
            best = max(best, total)
            a += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Largest items first, each into the fullest sequence that has room; equal steps are done at once."""
    open_bins: dict[int, list[tuple[int, Pattern]]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, pattern: Pattern) -> None:
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append((times, pattern))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                room, times, pattern = capacity, left, ()
            else:
                room = rooms[at]
                times, pattern = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            each = min(room // size, left)
            full = min(times, left // each)
            if pattern and times > full:
                put(room, times - full, pattern)
            put(room - each * size, full, (*pattern, (size, each)))
            left -= full * each
    return [group for groups in open_bins.values() for group in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Pattern]]:
    """(number of sequences, ((size, items of it), ...)) for all items; ``counts`` is per size."""
    left = {s: n for s, n in counts.items() if n}
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def _placer(planned: list[tuple[int, Pattern]]):
    """A function from (size, number among its equals) to (sequence, offset)."""
    used, rows, sequence = Counter(), [], 0
    for times, pattern in planned:
        offset = 0
        for size, each in pattern:
            rows.append((size, used[size], sequence, each, offset))
            used[size] += times * each
            offset += size * each
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    key = (table[:, 0] << 48) + table[:, 1]

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        size, nth = np.asarray(length), np.asarray(number)
        line = table[np.searchsorted(key, (size << 48) + nth, "right") - 1] if len(table) else np.empty((0, 5), np.int64)
        behind = nth - line[:, 1]
        return pa.StructArray.from_arrays(
            [pa.array(line[:, 2] + behind // line[:, 3]), pa.array(line[:, 4] + behind % line[:, 3] * size)], ["sequence_id", "offset"]
        )

    return place


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and the id 0; null text counts as empty. One longer than a sequence
    is cut into full pieces from its end, so that only the first may be shorter. Every row is packed,
    also those with a null or repeated id; an empty table gives no rows. Other columns are not read.

    Tokens are made once: pieces are written with their task's number for them. Sizes are at most
    ``capacity`` different numbers, so the packing of their counts is planned on the driver, however
    many documents there are: first sets that dominate all alternatives, then best fit for the rest.
    The n-th piece of a size, counted over tasks by one row per task and size, has its place in the
    plan.
    """
    spark = docs.sparkSession
    texts = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    path = scratch_path(spark, "pieces")
    schema = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    texts.mapInArrow(_pieces(tokenizer_path, pattern, capacity), schema).write.parquet(path)
    pieces = spark.read.parquet(path)
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    sizes = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = _placer(plan(sizes, capacity))
    before = per_part.selectExpr(
        "part", "length", "coalesce(sum(n) OVER (PARTITION BY length ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift"
    )
    numbered = pieces.join(before, ["part", "length"]).withColumn("p", place("length", F.col("nth") + F.col("shift")))
    return numbered.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")
