"""Benchmark decontamination by spaced seeds, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.sources.fields import named

# 1: the word at this place counts, 0: any word will do. The 12 places are in four groups of three, and each mask
# leaves out two groups, so any two substituted words are missed by a mask. The groups are chosen such that
# also any 3 substituted words of 15 to 19, and any 4 of 20 to 24, are missed by a mask at some place.
MASKS = ("001101110100", "101000010111", "011010011100", "100101100011", "010111101000", "110010001011")
SPAN = 12
# An item of fewer words is searched for as a whole, word by word; one below MIN_ITEM is too short to tell.
MIN_ITEM = 5
STRETCH = 24
AGREE_PERCENT = 80
# So many seeds of items, at about 50 bytes, may go to every task; more are joined by a shuffle.
BROADCAST_SEEDS = 500_000


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def _masks(short_lengths: list[int]) -> dict[str, list[int]]:
    return {m: [i for i, bit in enumerate(m) if bit == "1"] for m in [*MASKS, *("1" * n for n in short_lengths)]}


def _seeds(frame: DataFrame, keep: list[str], masks: dict[str, list[int]], of_items: bool = False) -> DataFrame:
    """(keep, words, place, h): a hash per mask and place of ``words`` where the mask fits.

    Of items, a mask of fewer than SPAN words is for those of as many words only.
    """
    shortest = min(len(m) for m in masks)
    # Unpacking a one-element array makes ``words`` a value that the places below share; as a plain
    # projection it would be computed again for every place.
    held = frame.select(*keep, F.explode_outer(F.array("words")).alias("words"))
    places = F.when(F.size("words") >= shortest, F.sequence(F.lit(0), F.size("words") - shortest))
    at = held.select(*keep, "words", F.explode(F.coalesce(places, F.array().cast("array<int>"))).alias("place"))
    hashes = []
    for number, (mask, ones) in enumerate(masks.items()):
        picked = [F.get("words", F.col("place") + i) for i in ones]
        h = F.xxhash64(F.lit(number), *picked)
        fits = F.size("words") == len(mask) if of_items and len(mask) < SPAN else F.size("words") >= F.col("place") + len(mask)
        hashes.append(F.when(fits, h))
    return at.select(*keep, "words", "place", F.explode(F.array(*hashes)).alias("h"))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id, item, place, n_matched, item_words) of every document with a stretch of a benchmark item.

    Words are lower-case runs of letters and digits. A document holds an item if, in some alignment
    without gaps, a stretch of 24 aligned words (of all words, for shorter items) agrees in at least
    80 %; an item of 5 to 11 words has to agree in full. Alignments come from equal hashes under one of six
    masks that ignore 6 of 12 words: one of them meets every such alignment, so none is lost, and what
    is found of an item does not depend on other items. For each alignment every word of the overlap is compared. The
    alignment with the most equal words is reported, the first of equals; ``place`` is where its
    first item word falls in the document, and is negative if the document begins inside the item.

    Seeds of items are sent to all tasks after they are counted; above BROADCAST_SEEDS the documents'
    seeds are shuffled by hash instead. Hits carry the aligned words, so texts are not fetched again.

    Null or blank texts and items match nothing; nor do items of fewer than 5 words. Null ids are
    left out. Rows that repeat an id count as one document. Empty tables give no rows. Other columns
    are neither read nor returned.
    """
    d = docs.select(named(id_col).alias("id"), plain_words(named(text_col)).alias("words")).filter("id IS NOT NULL AND words IS NOT NULL")
    b = items.select(named(item_col).alias("item"), plain_words(named(item_text_col)).alias("words")).filter(f"item IS NOT NULL AND size(words) >= {MIN_ITEM}")
    # At most SPAN - MIN_ITEM different numbers.
    short = sorted(r.n for r in b.filter(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().collect())
    masks = _masks(short)
    item_seeds = _seeds(b, ["item"], masks, of_items=True).filter("h IS NOT NULL").select("h", "item", F.col("place").alias("item_place"), F.size("words").alias("n")).distinct()
    if item_seeds.count() <= BROADCAST_SEEDS:
        item_seeds = F.broadcast(item_seeds)
    begin = F.col("place") - F.col("item_place")
    hits = (
        _seeds(d, ["id"], masks).join(item_seeds, "h")
        .select("id", "item", begin.alias("begin"), F.greatest(begin, F.lit(0)).alias("low"), F.least(begin + F.col("n"), F.size("words")).alias("high"), "words")
        .select("id", "item", "begin", F.slice("words", F.col("low") + 1, F.col("high") - F.col("low")).alias("overlap"))
        .groupBy("id", "item", "begin").agg(F.first("overlap").alias("overlap"))
    )
    low = F.greatest(-F.col("begin"), F.lit(0))
    theirs = F.slice("words", low + 1, F.size("overlap"))
    agree = F.zip_with("overlap", theirs, lambda x, y: F.when(x == y, 1).otherwise(0))
    same = hits.join(b, "item").select("id", "item", "begin", F.size("words").alias("item_words"), agree.alias("same"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    length = F.least("item_words", F.lit(STRETCH))
    starts = F.when(F.size("same") >= length, F.sequence(F.lit(0), F.size("same") - length))
    passes = F.exists(starts, lambda i: 100 * total(F.slice("same", i + 1, length)) >= AGREE_PERCENT * length)
    found = same.filter(passes).select("id", "item", "item_words", "begin", total(F.col("same")).alias("n_matched"))
    best = found.groupBy("id", "item").agg(F.max(F.struct("n_matched", (-F.col("begin")).alias("back"), "item_words")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("m.back")).alias("place"), "m.n_matched", "m.item_words")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns, whatever their names.

    Rows without an id stay; of rows that repeat an id none stays if one holds an item.
    """
    bad = "_".join(["bad", *docs.columns])
    found = contaminated(docs, items, id_col, **columns).select(F.col(id_col).alias(bad)).distinct()
    return docs.join(found, named(id_col) == named(bad), "left_anti")
