"""Fill-in-middle: texts cut at two code points, found in a Roaring-style set of code point boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.llm.word_arrays import text_bytes
from rillway.sources.fields import named

# One container covers so many byte positions.
SPAN = 1 << 16
# An array of 16-bit numbers is smaller than a bitmap up to so many members.
ARRAY_MOST = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Runs:
    """Members as runs: where each begins, and how many members lie before it."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(lengths)])

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


class Array:
    """Members as sorted 16-bit numbers."""

    def __init__(self, members: np.ndarray):
        self.members = members.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.members[k])


class Bitmap:
    """Members as bits, with the number of members before each 64-byte word."""

    WORD = 64

    def __init__(self, mask: np.ndarray):
        self.bits = np.packbits(np.pad(mask, (0, -len(mask) % (8 * self.WORD))), bitorder="little")
        counts = np.bitwise_count(self.bits).reshape(-1, self.WORD).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.bits[word * self.WORD : (word + 1) * self.WORD], bitorder="little")
        return word * self.WORD * 8 + int(np.flatnonzero(bits)[k - int(self.before[word])])


def container(mask: np.ndarray) -> Runs | Array | Bitmap:
    """The smallest of the three forms for the set positions of ``mask``, at most 2**16 of them."""
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    members = int((ends - starts).sum())
    if 4 * len(starts) <= min(2 * members, SPAN // 8):
        return Runs(starts, ends - starts)
    return Array(np.flatnonzero(mask)) if members <= ARRAY_MOST else Bitmap(mask)


class Boundaries:
    """Byte positions at which the code points of a UTF-8 text begin, in containers of 2**16 positions.

    ``cumulative[i]`` members lie in the containers before the i-th. Built container by container, so
    beside the text it takes an eighth of a byte per byte at most. Position 0 counts as a boundary also
    where the text is not valid UTF-8.
    """

    def __init__(self, data: np.ndarray):
        self.n_bytes = len(data)
        self.containers, counts = [], []
        for low in range(0, len(data), SPAN):
            mask = (data[low : low + SPAN] & 0xC0) != 0x80
            mask[0] |= low == 0
            self.containers.append(container(mask))
            counts.append(int(np.count_nonzero(mask)))
        self.cumulative = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, k: int) -> int:
        """Where code point k begins; the end of the text for k = n."""
        if k >= len(self):
            return self.n_bytes
        at = int(np.searchsorted(self.cumulative, k, "right")) - 1
        return at * SPAN + self.containers[at].select(k - int(self.cumulative[at]))


_CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")])


@F.arrow_udf(_CUTS.add("first", T.IntegerType()).add("second", T.IntegerType()))
def cuts(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    """Code points of a text, of its prefix and its middle, and the byte offsets of both cuts."""
    data, offsets = text_bytes(text)
    rows = np.zeros((len(text), 5), np.int64)
    for i, (a, b) in enumerate(zip(one.to_pylist(), other.to_pylist())):
        bounds = Boundaries(data[offsets[i] : offsets[i + 1]])
        n = len(bounds)
        low, high = sorted((a % (n + 1), b % (n + 1)))
        rows[i] = n, low, high - low, bounds.select(low), bounds.select(high)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["n", "prefix_chars", "middle_chars", "first", "second"]
    return pa.StructArray.from_arrays([pa.array(rows[:, i], kind) for i, kind in enumerate(kinds)], names)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) per document.

    The cuts are drawn from a hash of seed and id, so a document is cut alike in every run. ``psm`` gives
    prefix, suffix, middle, ``spm`` suffix, prefix, middle, each after its mark. ``plain`` texts stay as
    they are: a share of all, empty ones, and those that hold a mark, so that ``restore`` is exact.
    A null text is empty, a null id hashes like an empty one; repeated rows give equal rows, each its own;
    other columns are left out, whatever their names. No shuffle: a row is computed from itself.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"), h.alias("h"))
    group = lambda i: F.conv(F.substring("h", 8 * i - 7, 8), 16, 10).cast("long")
    cut = rows.withColumn("cut", cuts("text", group(1), group(2)))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(mark))
    plain = (F.col("cut.n") == 0) | marked | (group(3) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(group(4) % 100 < spm_percent, "spm").otherwise("psm")
    raw, first, second = F.col("text").cast("binary"), F.col("cut.first"), F.col("cut.second")
    prefix = F.substring(raw, F.lit(1), first)
    middle = F.substring(raw, first + 1, second - first)
    suffix = F.substring(raw, second + 1, F.octet_length("text") - second)
    mark = lambda m: F.lit(m).cast("binary")
    psm = F.concat(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle).cast("string")
    spm = F.concat(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle).cast("string")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    chars = lambda c: F.when(F.col("form") != "plain", F.col(f"cut.{c}")).alias(c)
    return cut.withColumn("form", form).select(
        "id", F.col("cut.n").alias("n"), "form", chars("prefix_chars"), chars("middle_chars"), output.alias("output")
    )


def restore(form: Column, output: Column) -> Column:
    """The text that ``fill_in_middle`` made an output of. Each mark stands in it once."""
    after = lambda mark: F.substring_index(output, mark, -1)
    head = lambda text, mark: F.substring_index(text, mark, 1)
    middle = after(MIDDLE)
    psm = F.concat(head(after(PREFIX), SUFFIX), middle, head(after(SUFFIX), MIDDLE))
    spm = F.concat(head(after(PREFIX), MIDDLE), middle, head(after(SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
