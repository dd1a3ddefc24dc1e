"""Repeated text: each operator against brute force, over all odd cases."""

import hashlib
import os
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edge_rows import documents, frame, prose
from rillway.llm import bwt_merge, near_duplicates, repeated_bytes, repeated_passages
from rillway.llm.dedup_queries import op2_merged_transforms, op8_cover_anchors, op10_superminhash
from rillway.llm.groups import connected


def components(texts):
    """The smallest id reachable for (id, text) pairs."""
    sets = {i: near_duplicates.shingle_set(t) for i, t in texts}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def check_near(rows, got):
    want = components({(i, t) for i, t in rows if i is not None})
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_near_duplicates_on_odd_rows(spark):
    rows = documents()
    got = near_duplicates.near_duplicates(frame(spark)).collect()
    check_near(rows, got)
    assert sum(r.component_id == 0 for r in got) >= 6


def test_near_duplicates_with_borderline_groups(spark):
    """Copies with shared and own changes: some are linked to each other and not to their centre."""
    rng = random.Random(1)
    base = prose(rng, 90).split()
    changes = [(rng.randrange(90), rng.choice(["aa", "bb", "cc"])) for _ in range(12)]
    rows = []
    for i in range(120):
        words = list(base)
        for at, word in rng.sample(changes, rng.randint(0, 6)):
            words[at] = word
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(90)] = f"own{rng.random()}"
        rows.append((i, " ".join(words)))
    check_near(rows, near_duplicates.near_duplicates(frame(spark, rows)).collect())


def test_a_group_below_the_border_makes_few_pairs_to_verify(spark, monkeypatch):
    """Copies of one text, most with so many changes of their own that they are linked to no other: counts of rare
    shingles leave nearly all of their pairs open."""
    rng = random.Random(3)
    base = prose(rng, 150).split()
    rows = []
    for i in range(120):
        words = list(base)
        for k, at in enumerate(rng.sample(range(150), 1 if i % 3 else 4 + i % 2)):
            words[at] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    made, verify = [], near_duplicates._verify

    def counted(pairs, texts):
        made.append(pairs.count())
        return verify(pairs, texts)

    monkeypatch.setattr(near_duplicates, "_verify", counted)
    got = near_duplicates.near_duplicates(frame(spark, rows)).collect()
    check_near(rows, got)
    assert 10 < len({r.component_id for r in got}) and made[1] <= 20


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates.near_duplicates(frame(spark, []).limit(0)).collect() == []


def test_superminhash_estimates_similarity_and_reaches_every_rank_once():
    rng = np.random.default_rng(0)
    errors = []
    for size in (1, 3, 40, 2000):
        pool = rng.integers(0, 2**63, 3 * size).astype(np.uint64)
        a, b = np.unique(pool[: 2 * size]), np.unique(pool[size:])
        ranks = near_duplicates.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(abs((ranks[0] == ranks[1]).mean() - true))
    assert max(errors) < 0.15
    one = near_duplicates.superminhash(np.array([7], np.uint64), np.array([0, 1]))[0]
    assert sorted(one >> 32) == list(range(near_duplicates.RANKS))


def test_connected_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (300, 301)]
    links += [(500 + rng.randrange(60), 500 + rng.randrange(60)) for _ in range(40)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, connected(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()))
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_words(rows):
    window = repeated_passages.WINDOW
    starts = defaultdict(set)
    for i, t in rows:
        if i is not None:
            w = (t or "").encode().split()
            for k in range(len(w) - window + 1):
                starts[tuple(w[k : k + window])].add(i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and min(starts[tuple(w[k : k + window])]) < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


def test_passages_on_odd_rows(spark):
    marked = repeated_passages.mark_repeats(frame(spark))
    got = marked.select("id", repeated_passages.kept_words("text", "copy", "starts").alias("k")).select("id", "k.*").collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(documents())
    assert repeated_passages.mark_repeats(frame(spark, []).limit(0)).collect() == []


def test_passages_are_cut_out_and_columns_stay(spark):
    docs = frame(spark).withColumn("n_chars", F.length("text"))
    cut = repeated_passages.remove_repeats(docs, length_col="n_chars")
    assert cut.schema.names == docs.schema.names and cut.count() == docs.count()
    left = sorted(((r.doc_id, len((r.text or "").split()), r.bucket) for r in cut.collect()), key=repr)
    assert left == sorted(((i, n - gone, "bucket") for i, n, gone, _ in brute_words(documents())), key=repr)
    before = {(r.doc_id, r.text) for r in docs.collect()}
    for r in cut.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
        if r.doc_id == 21:
            assert (21, r.text) in before


def test_cover_meets_every_alignment():
    period, cover = repeated_passages.PERIOD, repeated_passages.COVER
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert repeated_passages.ANCHOR + period - 1 == repeated_passages.WINDOW


def brute_bytes(rows):
    first, length = {}, repeated_bytes.LENGTH
    order = sorted({(i, t) for i, t in rows if i is not None and t})
    for i, t in order:
        data = t.encode()
        for k in range(len(data) - length + 1):
            first.setdefault(data[k : k + length], (i, k))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            if i is not None and first[data[k : k + length]] < (i, k):
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [repeated_bytes.BUCKET_STRETCHES, 1])
def test_bytes_on_odd_rows(spark, monkeypatch, most):
    """Also with every bucket cut up."""
    monkeypatch.setattr(repeated_bytes, "BUCKET_STRETCHES", most)
    marked = repeated_bytes.repeat_spans(frame(spark))
    got = marked.select("id", repeated_bytes.kept_bytes("text", "copy", "spans").alias("k")).select("id", "k.*").collect()
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=repr) == brute_bytes(documents())
    assert repeated_bytes.repeat_spans(frame(spark, []).limit(0)).collect() == []


def test_a_frequent_anchor_sends_one_row_a_batch_to_its_hash():
    """The others go anywhere, so neither a sample of the anchors nor a range through a hash is needed."""
    rng = random.Random(4)
    line = "a passage that stands in every text of the table, of about a hundred and thirty bytes, in the very same words each time, always"
    texts = [f"{prose(rng, 30)} {line} {prose(rng, 30)}" for _ in range(60)]
    batches = [pa.record_batch([pa.array(range(i, i + 30)), pa.array(texts[i : i + 30])], ["k1", "text"]) for i in (0, 30)]
    rows = [tuple(r.values()) for b in repeated_bytes._anchors(iter(batches)) for r in b.to_pylist()]
    frequent = [r for r in rows if sum(r[0] == x[0] for x in rows) == 60]
    kinds = [r[3] for r in frequent if r[0] == frequent[0][0]]
    assert kinds.count(repeated_bytes.MET) == 2 and kinds.count(repeated_bytes.SPREAD) == 58
    parts = [sorted(r for r in rows if (r[3] == repeated_bytes.SPREAD) == spread) for spread in (False, True)]
    names = ["h", "k1", "place", "met"]
    got = set()
    for part in parts:
        cut = [part[i : i + 7] for i in range(0, len(part), 7)]
        columns = [pa.record_batch([pa.array(c, k) for c, k in zip(zip(*p), (pa.int64(), pa.int64(), pa.int32(), pa.int8()))], names) for p in cut]
        got |= {tuple(r.values()) for b in repeated_bytes._shared(iter(columns)) for r in b.to_pylist()}
    assert got == {r[1:3] for r in rows if sum(r[0] == x[0] for x in rows) > 1}


def test_runs_hold_all_windows_and_follow_their_bytes():
    rng = random.Random(5)
    texts = [b"", b"ab" * 90, prose(rng, 60).encode(), b"x" * 99, b"x" * 100, prose(rng, 40).encode(), b"", b"short"]
    part, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    for gram in (repeated_bytes.GRAM, repeated_bytes.NARROW_GRAM):
        _, _, (owner, first, last, anchor) = repeated_bytes._runs_of(part, bounds, gram)
        windows = [(o, w, a) for o, s, e, a in zip(owner, first, last, anchor) for w in range(s, e + 1)]
        assert [w[:2] for w in windows] == [(o, b + i) for o, (b, t) in enumerate(zip(bounds, texts)) for i in range(len(t) - 99)]
        at = defaultdict(set)
        for _, w, a in windows:
            at[bytes(part[w : w + 100])].add(a - w)
        assert all(len(v) == 1 and 0 <= min(v) <= 100 - gram for v in at.values())


@pytest.mark.parametrize("seed", range(30))
def test_merged_transforms_find_all_repeats(monkeypatch, seed):
    rng = random.Random(seed)
    depth = rng.choice([3, 5, 9])
    monkeypatch.setattr(bwt_merge, "DEPTH", depth)
    base = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(0, 40))) for _ in range(4)]
    strings = [bytes(rng.choices(b"abc", k=rng.randint(0, 5))) + rng.choice(base) for _ in range(rng.randint(0, 12))]
    group, string, place = bwt_merge.repeated(strings, depth, rng.choice([1, 20, 1000]))
    got, want = defaultdict(set), defaultdict(set)
    for g, s, p in zip(group, string, place):
        got[g].add((int(s), int(p)))
    for i, s in enumerate(strings):
        for k in range(len(s) - depth + 1):
            want[s[k : k + depth]].add((i, k))
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def test_merge_gives_common_prefixes_and_the_order_of_one_sort():
    strings = [b"banana", b"bandana", b"an", b"", b"banana"]
    whole = bwt_merge.transform(strings)
    shards = [bwt_merge.transform(strings[:2]), bwt_merge.transform(strings[2:4], 2), bwt_merge.transform(strings[4:], 4)]
    row, common, _ = bwt_merge.merge(shards)
    string, place = (np.concatenate([getattr(s, f) for s in shards])[row] for f in ("string", "place"))
    assert list(zip(string, place)) == list(zip(whole.string, whole.place))
    suffixes = [strings[s][p:] for s, p in zip(string, place)]
    assert list(common[1:]) == [len(os.path.commonprefix([a, b])) for a, b in zip(suffixes, suffixes[1:])]


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_queries_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check_near(rows, op10_superminhash(spark, SMALL).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted(map(tuple, op8_cover_anchors(spark, SMALL).collect()), key=repr)
    assert got == sorted(((i, n, g, sha(k.encode())) for i, n, g, k in brute_words(rows)), key=repr)
    got = sorted(map(tuple, op2_merged_transforms(spark, SMALL).collect()), key=repr)
    assert got == sorted(((i, n, g, s, sha(k)) for i, n, g, s, k in brute_bytes(rows)), key=repr)


def test_text_bytes_of_sliced_and_null_columns():
    from rillway.llm.word_arrays import split_words, text_bytes

    column = pa.array(["skip", "a b", None, "", " c\x0bd ", "ab"], pa.string()).slice(1)
    data, offsets = text_bytes(column)
    assert [bytes(data[s:e]) for s, e in zip(offsets, offsets[1:])] == [b"a b", b"", b"", b" c\x0bd ", b"ab"]
    for limit in (1, 3, 100):
        found = []
        for w in split_words(column, limit):
            for i in range(len(w.first) - 1):
                found.append([bytes(w.data[s:e]) for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])])
        assert found == [[b"a", b"b"], [], [], [b"c", b"d"], [b"ab"]]


def test_a_worker_holds_small_arrays_for_many_texts():
    rng = random.Random(8)
    texts = [prose(rng, 400) for _ in range(800)]
    batch = pa.record_batch([pa.array(range(800)), pa.array(texts)], ["k1", "text"])
    assert sum(map(len, texts)) > 3 << 19
    for _ in repeated_passages._anchors(iter([batch])):
        pass
    tracemalloc.start()
    for _ in repeated_passages._anchors(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
