"""Quality rules, decontamination, packing, URL lists and archives against brute force, over all odd cases."""

import base64
import datetime as dt
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from edge_rows import documents, frame, prose
from rillway.llm import contamination, packing, quality_votes, url_lists, warc
from rillway.llm.filter_queries import op5_rule_votes
from rillway.llm.packing_queries import TOKENIZER, pack_documents
from rillway.session import scratch_path

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(repeated), failed


def test_measures_and_verdicts_on_odd_rows(spark):
    rows, name = quality_votes.judged(frame(spark))
    got = rows.select("doc_id", "text", f"{name}.*").collect()
    assert name != "judged" and len(got) == len(documents())
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_measures(r.text)
        assert r.kept == (not r.base_failed and r.probability >= 0.5)
    assert all(r.kept for r in got if r.doc_id in (0, 1, 21))
    rows, name = quality_votes.judged(frame(spark, []).limit(0))
    assert rows.collect() == []


def test_bad_texts_go_and_good_ones_stay(spark):
    rng = random.Random(8)
    good = [prose(rng, rng.randint(60, 300)) for _ in range(300)]
    bad = [" ".join(w + "$$$" for w in t.split()) for t in good[:20]] + [t.upper().replace(" ", "!! ") for t in good[20:40]] + [t.replace(" ", " | ") for t in good[40:60]]
    rows, name = quality_votes.judged(frame(spark, list(enumerate(good + bad))))
    kept = {r.doc_id for r in rows.filter(F.col(name).getField("kept")).collect()}
    assert kept == set(range(300))


def test_accuracies_are_recovered_from_votes():
    """Three bad sorts, each seen by its own rules only; rules abstain at times."""
    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.85
    votes = np.ones((20000, len(quality_votes.RULES)), int)
    sort = rng.integers(0, 3, 20000)
    for rule in range(3):
        hit = ~good & (sort == rule) & (rng.random(20000) < 0.9)
        false = good & (rng.random(20000) < 0.002)
        votes[hit | false, rule] = -1
    votes[rng.random(votes.shape) < 0.05] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = quality_votes.estimate(patterns, counts)
    # False alarms are taken for more frequent than they are here, so some bad texts are half believed.
    assert abs(found.good_share - 0.85) < 0.06
    # A tenth of the bad texts gets no vote against and passes for good.
    assert all(abs(b - 1 / 3) < 0.05 for b in found.on_bad[:3]) and all(b < 0.05 for b in found.on_bad[3:])
    nothing = quality_votes.estimate(np.empty((0, len(quality_votes.RULES))), np.empty(0))
    assert 0.5 < nothing.good_share < 1


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op5_rule_votes(spark, SMALL).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == {i: brute_measures(t) for i, t in texts.items()}


def test_probabilities_follow_from_the_votes(spark):
    measured = spark.read.parquet(f"{SMALL}/documents.parquet").select(quality_votes.text_measures("text").alias("m"))
    m = F.col("m")
    learned = quality_votes.learn_accuracies(measured, m)
    votes = F.array(*[rule.vote(m) for rule in quality_votes.RULES]).alias("votes")
    for r in measured.select(votes, quality_votes.probability(m, learned).alias("p")).collect():
        share = [np.log(g / (1 - b)) for v, g, b in zip(r.votes, learned.on_good, learned.on_bad) if v > 0]
        odds = np.log(learned.good_share / (1 - learned.good_share)) + (np.mean(share) if share else 0)
        odds += sum(np.log((1 - g) / b) for v, g, b in zip(r.votes, learned.on_good, learned.on_bad) if v < 0)
        p = 1 / (1 + np.exp(-odds))
        assert abs(r.p - (p if min(r.votes) < 0 else max(p, 0.5))) < 1e-9


def test_verdicts_against_labels(spark):
    """No more bad texts stay, and no fewer good ones, than if every rule had to pass."""
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows, name = quality_votes.judged(spark.read.parquet(f"{MIDDLE}/documents.parquet").join(labels, "doc_id"))
    j = F.col(name)
    passes = ~j.getField("base_failed") & (F.least(*[rule.vote(j) for rule in quality_votes.RULES]) >= 0)
    counts = {
        r.label: (r.kept, r.passed)
        for r in rows.filter("label IN (0, 1)").groupBy("label")
        .agg(F.count_if(j.getField("kept")).alias("kept"), F.count_if(passes).alias("passed")).collect()
    }
    assert counts[0][0] <= counts[0][1] and counts[1][0] >= counts[1][1]


def brute_contaminated(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for doc, text in docs:
        d = words(text)
        for item, item_text in items:
            b = words(item_text)
            if doc is None or item is None or len(b) < contamination.MIN_ITEM:
                continue
            best = None
            for begin in range(-len(b) + 1, len(d)):
                low, high = max(begin, 0), min(begin + len(b), len(d))
                same = [d[p] == b[p - begin] for p in range(low, high)]
                length = min(len(b), contamination.STRETCH)
                percent = contamination.AGREE_PERCENT if len(b) >= contamination.SPAN else 100
                good = any(100 * sum(same[i : i + length]) >= percent * length for i in range(len(same) - length + 1))
                if good and (best is None or sum(same) > best[1]):
                    best = (begin, sum(same), len(b))
            if best:
                out[doc, item] = max(out.get((doc, item), best), best, key=lambda x: (x[1], -x[0]))
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("length", range(contamination.SPAN, contamination.STRETCH + 1))
def test_masks_meet_every_alignment(length):
    """All placements of as many substituted words as the rule allows."""
    masks = [sum(1 << i for i, bit in enumerate(m) if bit == "1") for m in contamination.MASKS]
    allowed = length - -(-contamination.AGREE_PERCENT * length // 100)
    changed = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(length), allowed)])
    met = [(changed & (m << place)) == 0 for m in masks for place in range(length - contamination.SPAN + 1)]
    assert np.any(met, axis=0).all()


def test_substitutions_are_found_whatever_other_items_there_are(spark):
    rng = random.Random(12)
    item = [f"w{i}" for i in range(12)]
    swaps = [c for k in (1, 2) for c in itertools.combinations(range(12), k)]
    docs = [(i, prose(rng, 9) + " " + " ".join("other" if j in c else w for j, w in enumerate(item)) + " " + prose(rng, 9)) for i, c in enumerate(swaps)]
    docs.append((1000, "five short words of one " + prose(rng, 30)))
    for more in ([], [(2, "five short words of one"), (3, prose(rng, 7))]):
        got = contamination.contaminated(frame(spark, docs), frame(spark, [(1, " ".join(item)), *more], doc_id="item_id")).collect()
        assert sorted(r.doc_id for r in got if r.item_id == 1) == list(range(78))
        assert [r.doc_id for r in got if r.item_id == 2] == [1000] * bool(more)


def test_contamination_on_odd_rows(spark):
    rng = random.Random(4)
    items = [(1, prose(rng, 40)), (2, prose(rng, 16)), (3, prose(rng, 8)), (4, "too short"), (5, None), (None, prose(rng, 30)), (6, ""), (7, prose(rng, 60))]
    texts = dict(items)
    swap = lambda t, at: " ".join("other" if i in at else w for i, w in enumerate(t.split()))
    docs = [
        (100, prose(rng, 30) + " " + texts[1] + " " + prose(rng, 20)),
        (101, "begin " + swap(texts[1], {3, 11, 20, 30}) + " end"),
        (102, texts[1].upper().replace(" ", "\n--")),
        (103, texts[2]), (104, swap(texts[2], {5})), (105, prose(rng, 9) + " " + texts[3]), (106, swap(texts[3], {2})),
        (107, "too short"), (108, " ".join(texts[7].split()[20:50])), (109, " ".join(texts[7].split()[:10])),
        (110, " ".join(texts[1].split()[-26:]) + " " + prose(rng, 30)), (None, texts[1]), (111, None), (100, texts[1]),
        (112, texts[1] + " " + texts[1]),
    ]
    rows = documents() + docs
    got = contamination.contaminated(frame(spark, rows), frame(spark, items, doc_id="item_id", bucket="h2"))
    want = brute_contaminated(rows, items)
    assert sorted(map(tuple, got.collect())) == want
    assert {d for d, *_ in want} >= {100, 101, 102, 103, 104, 105, 108, 110, 112} and not {d for d, *_ in want} & {106, 107, 109}
    docs_frame = frame(spark, rows)
    left = contamination.drop_contaminated(docs_frame, frame(spark, items, doc_id="item_id"))
    bad = {d for d, *_ in want}
    assert left.columns == docs_frame.columns and left.count() == sum(i not in bad for i, _ in rows)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_contamination_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(contamination, "BROADCAST_SEEDS", limit)
    rng = random.Random(9)
    items = [(i, prose(rng, 20)) for i in range(5)]
    rows = [(i, prose(rng, 50) + (" " + items[i][1] if i < 5 else "")) for i in range(10)]
    df = contamination.contaminated(frame(spark, rows), frame(spark, items, doc_id="item_id"))
    assert sorted((r.doc_id, r.item_id) for r in df.collect()) == [(i, i) for i in range(5)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_contamination_of_nothing(spark):
    some, none = frame(spark), frame(spark, []).limit(0)
    item = frame(spark, [(1, "one two three four five six")], doc_id="item_id")
    assert contamination.contaminated(none, item).collect() == []
    assert contamination.contaminated(some, none.withColumnRenamed("doc_id", "item_id")).collect() == []


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]


def check_packed(rows, got, encode, capacity):
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for i, all_of in texts.items():
        want = []
        for t in all_of:
            ids = encode(t)
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            want += [(n, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for n, (s, e) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]) == sorted(want)
    total = sum(r.length for r in got)
    return len(fill), -(-total // capacity)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_on_odd_rows(spark, encode, capacity):
    rows = documents() + [(900, "  two  spaces "), (901, "\r\n x\t y"), (902, "it's  'll 12ab é🙂‍"), (903, "ends in space ")]
    df = packing.pack(frame(spark, rows), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, capacity)
    used, least = check_packed(rows, df.collect(), encode, capacity)
    assert used <= 1.1 * least + 1
    assert pack_documents(frame(spark, []).limit(0)).collect() == []


def test_ids_are_those_of_the_whole_text(encode):
    ids = packing._encoder(public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    runs = [" \u00a0 \u00a0 ", "\u00a0 \u00a0", "\n \n", "\t \t", " \n  x", "\r\n ", "\u2003 \u3000 ", "\x1c \x85 ", "  ", " "]
    texts = [f"{a}{r}{b}" for r in runs for a in ("a", "", "1.", "\0") for b in ("b", "", "'s", "\0 c")]
    texts += ["it\u2019s  here 12\u00b2 \u2014 \u00bd x\n\u2028 y", "\u2019" * 30, " \u2019 \u2019", "a\u0558b 1\u058b2", "\U00010940a x", "日本 語  \u3000 x"]
    rng = random.Random(7)
    texts += ["".join(rng.choice(" \u00a0\n\tab1é'.\0") for _ in range(40)) for _ in range(300)]
    for text in texts:
        assert [*np.frombuffer(ids(text), "<u4")] == encode(text)[:-1], repr(text)


def test_texts_looked_up_together_make_few_calls_of_the_tokenizer(encode, monkeypatch):
    """New pre-tokens of many texts are lines of one, whatever stands between, and each text gets its own ids."""
    import tokenizers

    calls = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.inner, name)

    class Source:
        from_file = staticmethod(lambda path, load=tokenizers.Tokenizer.from_file: Counted(load(path)))

    monkeypatch.setattr(tokenizers, "Tokenizer", Source)
    rng = random.Random(9)
    many = packing._encoder_of_many.__wrapped__(public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    odd = ["", "\n", " ", "a\nb", "\n\n x", "it's 'll ''s", "\u00a0\u0558 \u2028é", "a <|endoftext|> new1 b", "\x1c\x85 \xad?!'"]
    texts = [" ".join(f"{rng.choice('abé')}w{rng.randrange(10**6)}{rng.choice(['', '!', chr(10), '  '])}" for _ in range(40)) for _ in range(150)]
    texts = [t for pair in zip(texts, odd * 20) for t in pair]
    assert [[*np.frombuffer(ids, "<u4")] for ids in many(iter(texts))] == [encode(t)[:-1] for t in texts]
    assert calls.count("encode_batch_fast") < 40
    assert list(many([])) == []
    monkeypatch.setattr(packing, "TOGETHER", 100)
    assert [[*np.frombuffer(ids, "<u4")] for ids in many(texts)] == [encode(t)[:-1] for t in texts]


def test_remembered_ids_stay_within_their_bytes(encode):
    ids = packing._encoder(public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    small = packing.Memory(20_000)
    for i in range(3000):
        keys = [f"word{i}", "often", f"word{i % 50}"]
        new = small.missing(keys)
        small.add((k, k.encode()) for k in new)
        assert all(small.known[k] == k.encode() for k in keys) and (i == 0 or "often" not in new)
    assert sum(len(k) + len(v) + packing.ENTRY_BYTES for half in (small.known, small.older) for k, v in half.items()) < 22_000
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(200_000))
    assert [*np.frombuffer(ids(text), "<u4")] == encode(text)[:-1]


def test_strings_of_added_tokens_are_these_tokens(encode):
    ids = packing._encoder(public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    end = "<|endoftext|>"
    assert 50256 in encode(end)
    for text in (end, f"a {end} b", f"{end}{end}x", f" {end}  y\u00a0 {end} ", f"<|{end}|>", "<|endoftext| >"):
        assert [*np.frombuffer(ids(text), "<u4")] == encode(text)[:-1], repr(text)


def test_packing_a_table(spark, encode):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check_packed(rows, pack_documents(spark.read.parquet(f"{SMALL}/documents.parquet")).collect(), encode, 2048)
    assert used <= 1.02 * least + 1


def best_number(sizes, capacity):
    """The least number of sequences, by trying all."""
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in {b: n for n, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_dominant_sets_belong_to_a_best_packing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 37])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
    counts = dict(Counter(sizes))
    fixed = packing.reduce_by_dominance(counts, capacity)
    left = [s for s, n in counts.items() for _ in range(n)]
    assert sorted(left + [s for t, p in fixed for s, n in p for _ in range(n * t)]) == sorted(sizes)
    assert sum(t for t, _ in fixed) + best_number(left, capacity) == best_number(sizes, capacity)
    planned = packing.plan(dict(Counter(sizes)), capacity)
    assert all(sum(s * n for s, n in p) <= capacity for _, p in planned)


def url_keys(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*([^?#]*)", url or "")
    host = m and m[1].lower().rstrip(".")
    if not host:
        return None, set()
    labels, parts = host.split("."), [p for p in m[2].split("/") if p]
    domains = {".".join(labels[i:]) for i in range(len(labels) - 1)} or {host}
    return host, domains | {host + "/" + "/".join(parts[: i + 1]) for i in range(len(parts))}


def test_dated_lists_on_odd_rows(spark):
    rng = random.Random(6)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(90))
    keys = ["a.example.com", "example.com", "b.example.org/x", "b.example.org/x/y", "other.net", "localhost"]
    entries = [(rng.choice(["l1", "l2"]), rng.choice(keys), day(), rng.random() < 0.5) for _ in range(150)]
    entries += [("l1", "Other.NET", dt.date(2023, 12, 1), True), (None, "other.net", day(), True), ("l1", None, day(), True), ("l1", "example.com", None, True), ("l2", "example.com", day(), None)]
    urls = ["http://a.example.com/", "https://u:p@A.Example.COM.:80/x?y#z", "http://b.example.org/x/y/z/", "http://b.example.org/xy", "http://other.net", "http://localhost/a", "no url", "", None, "http://", "ftp://example.com//x"]
    rows = [(i, rng.choice(urls), dt.datetime.combine(day(), dt.time(rng.randrange(24)))) for i in range(300)]
    rows += [(None, urls[0], rows[0][2]), (5, urls[1], None), rows[7], rows[7]]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched timestamp").withColumns({c: F.lit(1) for c in ("id", "day", "key", "month", "host")})
    listed = spark.createDataFrame(entries, "list string, key string, day date, listed boolean").withColumn("note", F.lit("x"))
    state = defaultdict(dict)
    for name, key, when, on in entries:
        if name and key and when:
            state[name, key.lower()][when] = state[name, key.lower()].get(when, False) or bool(on)

    def active(url, at):
        out = set()
        for (name, key), days in state.items():
            past = [d for d in days if at and d <= at.date()]
            if key in url_keys(url)[1] and past and days[max(past)]:
                out.add((name, key))
        return out

    got = url_lists.judge_captures(captures, listed)
    want = []
    for i, url, at in rows:
        hit = active(url, at)
        want.append((i, at, url_keys(url)[0], bool(hit), sorted({n for n, _ in hit}), sorted({k for _, k in hit})))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {w[3] for w in want} == {True, False}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert url_lists.judge_captures(captures.limit(0), listed).collect() == []
    assert not any(r.blocked for r in url_lists.judge_captures(captures, listed.limit(0)).collect())


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_archives_round_trip(spark, chunk):
    rows = [(1, "http://a/\r\n", "same"), (5, "http://b/", "same"), (3, None, "same"), (2, "u", "é" * 20000), (4, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n"), (8, "u", "x"), (None, "n", "same"), (9, "u", "y"), (9, "u", "y"), (9, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("record", "payload", "digest", "total")}).repartition(2)
    top = {}
    for i, _, t in rows:
        if i is not None:
            top[t or ""] = max(top.get(t or "", -1), i)
    archives = warc.write_archives(pages, scratch_path(spark, "warc"), chunk_bytes=chunk, archive_bytes=100)
    assert archives.count() > 2 and archives.agg(F.sum("records")).first()[0] == len(rows)
    got = [tuple(r) for r in warc.read_records(archives).collect()]
    want = []
    for i, url, t in rows:
        data = (t or "").encode()
        revisits = None if i == top[t or ""] else top[t or ""]
        header = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
        want.append((
            warc.record_uri(i), header, "response" if revisits is None else "revisit", None if revisits is None else warc.record_uri(revisits),
            len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), True,
        ))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    chunks = warc.read_archives(archives, chunk_bytes=chunk).filter("record_id = '<urn:page:2>'").orderBy("chunk").collect()
    assert b"".join(bytes(r.data) for r in chunks) == ("é" * 20000).encode()
    assert [bytes(r.digest) for r in chunks] == [hashlib.sha1(("é" * 20000).encode()[: r.start + len(r.data)]).digest() for r in chunks]
    assert max(len(r.data) for r in chunks) <= chunk
    nothing = warc.write_archives(pages.limit(0), scratch_path(spark, "warc"))
    assert nothing.count() == 0 and warc.read_records(nothing).collect() == []
    all_responses = warc.write_archives(pages, scratch_path(spark, "warc"), min_revisit_bytes=5)
    assert all(r.record_type == "response" for r in warc.read_records(all_responses).filter("payload_bytes < 5").collect())


def test_spelled_out_patterns_split_alike(encode):
    import re

    import regex

    pattern = public_tokenizers.PATTERN
    spelled = packing.spelled_out(pattern)
    assert r"\p" not in spelled and r"\s" not in spelled
    rng = random.Random(11)
    chars = [chr(c) for c in range(packing.SURE_CHARS)]
    near = "'stvelmrd \t\n\x1c\x85\xa019aé²"
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice((chars, near))) for _ in range(30))
        assert re.findall(spelled, text) == regex.findall(pattern, text), repr(text)
