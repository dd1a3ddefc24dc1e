"""Burrows-Wheeler transforms of small collections of byte strings, merged by interleave refinement.

A collection's suffixes are sorted by their first DEPTH symbols at least. The end of a string is a
symbol of its own, below all bytes and different from all other ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Every suffix order here is exact in so many leading symbols.
DEPTH = 100


@dataclass
class Transform:
    """Rows in suffix order: the symbol before each suffix (0: none), its string and its place there."""

    before: np.ndarray
    string: np.ndarray
    place: np.ndarray
    n_strings: int


def transform(strings: list[bytes], first_number: int = 0) -> Transform:
    """Of one shard, by doubling the sorted prefix until it is DEPTH symbols or all suffixes differ."""
    size = np.array([len(s) + 1 for s in strings])
    bounds = np.concatenate([[0], np.cumsum(size)])
    symbols = np.zeros(bounds[-1], np.int64)
    for s, at in zip(strings, bounds):
        symbols[at : at + len(s)] = np.frombuffer(s, np.uint8).astype(np.int64) + len(strings)
    ends = bounds[1:] - 1
    symbols[ends] = np.arange(len(strings))
    n = len(symbols)
    # As many symbols as fit into 62 bits are compared first.
    bits = (len(strings) + 256).bit_length()
    step = 62 // bits
    key = np.zeros(n, np.int64)
    for i in range(step):
        key <<= bits
        key[: max(0, n - i)] |= symbols[i:]
    while True:
        order = np.argsort(key)
        fresh = np.concatenate([[0], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if step >= DEPTH or rank[order[-1]] == n - 1:
            break
        key = rank * (n + 1)
        key[: max(0, n - step)] += rank[step:] + 1
        step *= 2
    string = np.repeat(np.arange(len(strings)), size)
    place = np.arange(n) - bounds[string]
    before = np.zeros(n, np.uint16)
    before[1:] = symbols[:-1] - len(strings) + 1
    before[place == 0] = 0
    return Transform(before[order], string[order] + first_number, place[order], len(strings))


def merge(shards: list[Transform], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, common, ended) of all shards' suffixes in one order, without sorting suffixes again.

    ``row`` numbers the rows of the shards one after the other. The interleave says from which shard
    each place of the order takes its next row. It begins with shard after shard, which is right for
    0 symbols. If it is right for k symbols, then the symbols before the suffixes, read in this
    order and sorted stably, give the one that is right for k + 1: suffixes are grouped by first
    symbol and keep the order of their rest. Ends stay in the order of the strings. Two neighbours
    differ in symbol k + 1 or before exactly if their first symbols differ or something between
    their rests differs, so each round also tells which common prefixes end there: ``common`` is the
    number of leading symbols that a suffix shares with the one above, at most ``depth``. It ends
    after ``depth`` rounds, or when a round changes nothing.
    """
    sizes = [len(t.before) for t in shards]
    n, n_strings = sum(sizes), sum(t.n_strings for t in shards)
    before = np.concatenate([t.before for t in shards]) if shards else np.empty(0, np.uint16)
    source = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    ends = np.repeat(np.arange(len(shards), dtype=np.uint16), [t.n_strings for t in shards])
    common = np.full(n, depth, np.int64)
    common[:1] = 0
    group = np.zeros(n, np.int64)
    row = np.arange(n)
    for k in range(depth):
        symbol = before[row]
        order = np.argsort(symbol, kind="stable")
        new_source = source[order]
        # The rows of ends come first, one per string, each different from all others.
        new_source[:n_strings] = ends
        part, rest = symbol[order], group[order]
        differs = np.ones(n, bool)
        differs[1:] = (part[1:] != part[:-1]) | (rest[1:] != rest[:-1])
        differs[: n_strings + 1] = True
        found = differs & (common == depth)
        found[:1] = False
        common[found] = k
        same = np.array_equal(new_source, source) and not found.any()
        source, group = new_source, np.cumsum(differs)
        row[np.argsort(source, kind="stable")] = np.arange(n)
        if same:
            break
    return row, common, np.arange(n) < n_strings


def merge_repeats(shards: list[Transform], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, group) of the suffixes that share ``depth`` symbols or more with another, group by group.

    The same refinement as ``merge``, over rows that are not settled. A suffix that shares its first
    k symbols with no other is settled: whatever stands before it, k + 1 symbols are shared with no
    other either. So a round carries on only the rows before rows that still have a partner. The
    row of the suffix one symbol longer is found in its own shard, by last-to-first mapping.
    """
    sizes = np.cumsum([0] + [len(t.before) for t in shards])
    before = np.concatenate([t.before for t in shards]) if shards else np.empty(0, np.uint16)
    longer = np.empty(len(before), np.int32)
    for t, base in zip(shards, sizes):
        # Rows by (string, place), of which each stands once; the next longer suffix is the one before in the text.
        size = np.bincount(t.string - t.string.min(initial=0))
        by_text = np.empty(len(t.before), np.int64)
        by_text[(np.cumsum(size) - size)[t.string - t.string.min(initial=0)] + t.place] = np.arange(len(t.before))
        longer[base + by_text[1:]] = base + by_text[:-1]
    row, group = np.arange(len(before), dtype=np.int32), np.zeros(len(before), np.int32)
    for _ in range(depth):
        symbol = before[row]
        # Whole strings come first, and have no longer suffix.
        order = np.argsort(symbol, kind="stable")[len(symbol) - np.count_nonzero(symbol) :]
        part, rest = symbol[order], group[order]
        begins = np.ones(len(order) + 1, bool)
        begins[1:-1] = (part[1:] != part[:-1]) | (rest[1:] != rest[:-1])
        shared = ~(begins[:-1] & begins[1:])
        row = longer[row[order[shared]]]
        group = np.cumsum(begins[:-1], dtype=np.int32)[shared]
        if not len(row):
            break
    return row, group


def repeated(strings: list[bytes], depth: int = DEPTH, shard_bytes: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, string, place) of every stretch of ``depth`` bytes that stands in ``strings`` twice or more.

    Shards of about ``shard_bytes`` are transformed one by one and merged at once; a group is an
    interval of the merged order in which all share ``depth`` symbols or more.
    """
    shards, held, size, begun = [], [], 0, 0
    for i, s in enumerate(strings):
        held.append(s)
        size += len(s) + 1
        if size >= shard_bytes or i == len(strings) - 1:
            shards.append(transform(held, begun))
            held, size, begun = [], 0, i + 1
    row, group = merge_repeats(shards, depth)
    string = np.concatenate([t.string for t in shards]) if shards else np.empty(0, np.int64)
    place = np.concatenate([t.place for t in shards]) if shards else np.empty(0, np.int64)
    return group, string[row], place[row]
