"""Trained models: held-out accuracy, gradients, odd rows; and the pipeline against its parts done by brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edge_rows import documents, frame, prose
from rillway.llm import quality_classifier, quality_votes, toxicity
from rillway.llm.model_queries import op1_nb_support_vectors, op6_attentive_gru
from rillway.llm.word_arrays import split_words
from test_dedup import brute_words, components
from test_judging import brute_contaminated

SMALL, MIDDLE, LARGE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))


def rank_share(scores, labels):
    """How often a positive scores above a negative."""
    pos, neg = scores[labels == 1], scores[labels == 0]
    return (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()


def held_out(spark, rows, label, folder):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    some = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    return np.array([s for s, _ in some]), np.array([y for _, y in some])


def test_quality_query(spark):
    rows = op1_nb_support_vectors(spark, MIDDLE).collect()
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert rank_share(*held_out(spark, rows, "quality", MIDDLE)) > 0.93


def test_toxicity_query(spark):
    rows = op6_attentive_gru(spark, LARGE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert rank_share(*held_out(spark, rows, "toxic", LARGE)) > 0.9


def test_features_are_the_runs_and_words_of_a_text():
    texts = ["ab ab", None, "", "abc"]
    found = {row + i: set(f) for row, some in quality_classifier.indicators(pa.array(texts)) for i, f in enumerate(some)}
    alone = next(quality_classifier.indicators(pa.array(["ab ab"])))[1][0]
    assert found[0] == set(alone) and found[1] == found[2] == set()
    # Runs: a, b, blank, ab, "b ", " a", "ab ", "b a", " ab"; one word; one pair.
    assert len(found[0]) == 11 and len(found[3]) == 7


def test_very_long_texts_do_not_fill_the_features(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60_000)]
    some = [(" ".join(rng.choices(vocabulary[:500], k=60)) + (" vile scum" * 3 if i % 2 else ""), 1 - i % 2) for i in range(200)]
    model, square = quality_classifier.fit(spark.createDataFrame(some, "text string, label int"), "text", "label")
    long = [" ".join(rng.choices(vocabulary[500:], k=700_000)) for _ in range(2)]
    texts = [long[0] + " vile scum", long[0], long[1]]
    assert all(len(t) > 4 << 20 for t in texts)
    features = [f for _, rows in quality_classifier.indicators(pa.array(texts)) for f in rows]
    assert all(len(f) < 0.5 * (1 << quality_classifier.BITS) for f in features)
    got = quality_classifier._margins(features, model.weights, square)
    assert got[0] < got[1] and got[1] != got[2]


def test_one_very_long_text_does_not_end_the_sample(spark):
    short, long = [f"text {i}" for i in range(40)], ["long " * (50 + i) for i in range(40)]
    rows = spark.createDataFrame([(t,) for t in short + long], "text string")
    picked = quality_classifier.bounded_sample(rows, 100, 600)
    assert sum(map(len, picked)) <= 600 and len(picked) == len(set(picked)) and sum(t in short for t in picked) > 20
    # All short ones fit when no long one does, however few rows a turn looks at.
    assert sorted(quality_classifier.bounded_sample(rows, 100, 240)) == sorted(quality_classifier.bounded_sample(rows.filter("length(text) < 50"), 100, 240))
    assert len(quality_classifier.bounded_sample(rows, 7, 240)) == 7
    assert quality_classifier.bounded_sample(rows.filter("length(text) > 50"), 7, 10) == [long[0]]


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 4))
    y = np.where(x @ [1, -2, 0.5, 0] + 0.3 * rng.standard_normal(60) > 0, 1, -1)
    rows = [(np.arange(4), v) for v in x]
    w = quality_classifier.dual_coordinate_descent(rows, y, 4, np.full(60, 0.5), rounds=2000)
    loss = lambda v: v @ v / 2 + 0.5 * np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(loss(w) <= loss(w + 0.02 * rng.standard_normal(4)) + 1e-3 for _ in range(300))


def labelled(spark):
    rng = random.Random(2)
    rows = [(prose(rng, 40) + (" vile scum" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)] + [(None, 1), ("", 0), ("x", None)]
    return spark.createDataFrame(rows, "text string, label int").withColumn("h", F.lit(1))


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_models_on_odd_rows(spark, module):
    def scored(model, docs):
        return module.score(docs, *model) if isinstance(model, tuple) else module.score(docs, model)

    model = module.fit(labelled(spark), "text", "label", fit_texts=100)
    got = scored(model, frame(spark)).select("doc_id", "text", "score").collect()
    assert len(got) == len(documents()) and all(0 <= r.score <= 1 for r in got)
    same = {}
    for r in got:
        # Sums of 32-bit numbers depend on what else is in a batch.
        assert abs(same.setdefault(r.text, r.score) - r.score) < 1e-6
    assert scored(model, frame(spark, []).limit(0)).collect() == []
    pair = scored(model, frame(spark, [(1, "kara lora " * 2000 + "vile scum " + "mira nura " * 20), (2, "kara lora " * 2000)]))
    toxic, clean = (r.score for r in pair.orderBy("doc_id").collect())
    assert toxic > clean
    for none in (labelled(spark).limit(0), labelled(spark).filter("label = 1")):
        flat = module.fit(none, "text", "label")
        assert len({round(r.score, 6) for r in scored(flat, frame(spark)).collect()}) == 1


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    words = next(split_words(pa.array(["alpha beta gamma delta eps zeta", "one two three", ""])))
    t = toxicity.tokens(words)
    net = toxicity.Network.new(rng, t.key[:4])
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    _, begin, length = toxicity.windows_of(words)
    steps = np.arange(toxicity.WINDOW)[:, None]
    mask, at = steps < length, t.of[np.minimum(begin + steps, len(t.of) - 1)]
    sign = np.array([1, -1])

    def loss():
        return np.log1p(np.exp(-sign * toxicity.forward(net, toxicity.inputs(net, t), at, mask))).sum()

    keep = {}
    x = toxicity.inputs(net, t)
    out = toxicity.forward(net, x, at, mask, keep)
    g = toxicity.gradients(net, t, x, at, mask, keep, -sign / (1 + np.exp(sign * out)))
    for name, value in net.p.items():
        for place in np.argwhere(np.abs(g[name]) > 1e-4)[:3]:
            place, old = tuple(place), value[tuple(place)]
            value[place] = old + 1e-2
            up = loss()
            value[place] = old - 1e-2
            down = loss()
            value[place] = old
            assert abs((up - down) / 2e-2 - g[name][place]) < 1e-3 * max(1, abs(g[name][place])), name


def test_windows_cover_all_words_and_overlap():
    words = next(split_words(pa.array(["", "w " * 5, "w " * 32, "w " * 33, "w " * 1000])))
    text, begin, length = toxicity.windows_of(words)
    for i, n in enumerate(words.counts()):
        mine = begin[text == i] - words.first[i], length[text == i]
        covered = sorted({b + k for b, size in zip(*mine) for k in range(size)})
        assert covered == list(range(n)) and all(np.diff(mine[0]) <= toxicity.STEP)


def test_scores_are_the_highest_of_windows_at_every_word():
    rng = random.Random(6)
    texts = [prose(rng, n) for n in (5, 32, 33, 47, 48, 90, 200)]
    net = toxicity.Network.new(np.random.default_rng(2), next(toxicity.split_words(pa.array(texts))).hashes()[:20])
    got = toxicity.text_odds(net, pa.array(texts), 0.0)
    for text, odds in zip(texts, got):
        w = text.split()
        alone = [" ".join(w[i : i + toxicity.WINDOW]) for i in range(max(1, len(w) - toxicity.WINDOW + 1))]
        assert abs(toxicity.text_odds(net, pa.array(alone), 0.0).max() - odds) < 1e-4


def test_windows_go_through_onnx_runtime_with_the_same_odds(monkeypatch):
    rng = random.Random(7)
    words = next(toxicity.split_words(pa.array([prose(rng, 150)])))
    t = toxicity.tokens(words)
    net = toxicity.Network.new(np.random.default_rng(3), t.key[:20])
    net.p["query"] *= 5
    x, steps = toxicity.inputs(net, t), np.arange(toxicity.WINDOW)[:, None]
    at = t.of[steps + np.arange(150 - toxicity.WINDOW + 1)]
    wanted = toxicity.forward(net, x, at, np.ones(at.shape, bool))
    monkeypatch.setattr(toxicity, "GRAPH_RUN", 50)
    assert toxicity.session(toxicity.WINDOW, toxicity.HIDDEN, toxicity.ATTENTION) is not None
    for odds in (toxicity.odds_at_every_word, toxicity.odds_in_numpy):
        assert np.abs(odds(net, x, t.of) - wanted).max() < 1e-5
        assert len(odds(net, x, t.of[: toxicity.WINDOW - 1])) == 0


def test_windows_of_any_place_get_the_odds_of_the_plain_network(monkeypatch):
    rng = random.Random(8)
    words = next(toxicity.split_words(pa.array([prose(rng, n) for n in (70, 5, 32, 33)])))
    t = toxicity.tokens(words)
    net = toxicity.Network.new(np.random.default_rng(4), t.key[:20])
    net.p["query"] *= 5
    net.p |= {k: net.p[k] + np.float32(0.3) for k in ("cf", "cb", "bias")}
    x, (_, begin, length) = toxicity.inputs(net, t), toxicity.windows_of(words, step=3)
    assert np.abs(toxicity.many_inputs(net, t) - x).max() < 1e-5 and len(set(length)) == 2
    steps = np.arange(toxicity.WINDOW)[:, None]
    wanted = toxicity.forward(net, x, t.of[np.minimum(begin + steps, len(t.of) - 1)], steps < length)
    for run in (toxicity.RUN, 7, 1):
        monkeypatch.setattr(toxicity, "RUN", run)
        assert np.abs(toxicity.window_odds(net, t, begin, length) - wanted).max() < 1e-5
        every = toxicity.odds_in_numpy(net, x, t.of)
        full = length == toxicity.WINDOW
        assert len(every) == len(t.of) - toxicity.WINDOW + 1 and np.abs(every[begin[full]] - wanted[full]).max() < 1e-5
    assert toxicity.many_inputs(net, toxicity.tokens(next(toxicity.split_words(pa.array(["", " "]))))).shape == (0, 2 * toxicity.WIDTH)


def test_both_ways_to_score_windows_are_taken(monkeypatch):
    words = next(toxicity.split_words(pa.array([prose(random.Random(9), 60)])))
    t = toxicity.tokens(words)
    net = toxicity.Network.new(np.random.default_rng(5), t.key[:9])
    x, got = toxicity.inputs(net, t), []
    for fast in (True, False):
        monkeypatch.setattr(toxicity, "numpy_is_fast", lambda fast=fast: fast)
        if fast:
            monkeypatch.setattr(toxicity, "session", lambda *a: pytest.fail("numpy was to be taken"))
        else:
            monkeypatch.undo()
            monkeypatch.setattr(toxicity, "numpy_is_fast", lambda: False)
            monkeypatch.setattr(toxicity, "odds_in_numpy", lambda *a: pytest.fail("ONNX Runtime was to be taken"))
        got.append(toxicity.odds_at_every_word(net, x, t.of))
    assert np.abs(got[0] - got[1]).max() < 1e-5


def brute_stages(spark, rows, items):
    """(id, text) after each stage but the last; the rules' verdicts are taken from the operator."""
    verdict, name = quality_votes.judged(spark.createDataFrame(rows, "doc_id long, text string"))
    out = [sorted((r.doc_id, r.text) for r in verdict.filter(F.col(name).getField("kept")).collect())]
    groups = components(out[-1])
    out.append([(i, t) for i, t in out[-1] if groups[i][1] == i])
    words = {i: k.split() for i, _, _, k in brute_words(out[-1])}
    out.append([(i, words[i]) for i, _ in out[-1]])
    bad = {d for d, *_ in brute_contaminated([(i, " ".join(w)) for i, w in out[-1]], items)}
    out.append([(i, w) for i, w in out[-1] if i not in bad])
    return out


def test_pipeline_on_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute_stages(spark, [tuple(r) for r in docs.select("doc_id", "text").collect()], items)
    got = docs
    for (_, stage), texts in zip(corpus_pipeline.STAGES[:-1], want):
        got = stage(spark, got, SMALL)
        assert got.columns == docs.columns
        rows = got.collect()
        split = isinstance(texts[0][1], list)
        assert sorted((r.doc_id, r.text.split() if split else r.text) for r in rows) == texts
        assert all(r.n_chars == len(r.text) for r in rows)
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in want[-1]}


def test_stages_on_odd_rows(spark):
    docs = frame(spark).withColumn("lang", F.lit("en"))
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SMALL)
            assert out.columns == docs.columns and out.count() <= rows.count()
        assert (corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).count() > 0) == (rows is docs)


def test_stages_keep_rows_and_columns_apart(spark):
    rng = random.Random(3)
    t, u, item = prose(rng, 80), prose(rng, 80), spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    other = prose(rng, 80) + " " + item
    docs = spark.createDataFrame([(1, t), (2, t), (2, u), (3, other)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(c) for c in ("_copy", "copy", "key", "_bad", "bad", "text_key", "kept", "component_id")})
    stages = dict(corpus_pipeline.STAGES)
    near = stages["near duplicates"](spark, docs, SMALL)
    assert sorted((r.doc_id, r.text) for r in near.collect()) == sorted([(1, t), (2, u), (3, other)]) and near.columns == docs.columns
    clean = stages["benchmark decontamination"](spark, docs, SMALL)
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 2] and clean.columns == docs.columns
