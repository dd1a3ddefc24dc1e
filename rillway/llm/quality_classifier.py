"""Text quality by Naive Bayes support vectors over hashed n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.word_arrays import byte_values, mix, split_words
from rillway.session import scratch_path
from rillway.sources.fields import named

# Half of the features are for pairs of words, so that these never fill up those of words and bytes:
# 20 MB of joined texts of sf0.1 set 60 % of the pairs and 18 % of the others, 5 MB 25 % and 9 %.
BITS = 22
CHAR_GRAMS = (1, 2, 3)
# The linear model is fitted on so many texts, and so many bytes of each kind of label, at most.
FIT_TEXTS = 4000
FIT_BYTES = 8 << 20


def indicators(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For chunks of texts: the first row, and each text's distinct features.

    Features are words, pairs of words and runs of 1 to 3 bytes, hashed to ``bits`` bits. Pairs have
    the upper half of the numbers to themselves.
    """
    shift, half = np.uint64(65 - bits), np.int32(1 << (bits - 1))
    values = byte_values(7, False)
    for words in split_words(texts):
        h = words.hashes()
        pair = words.windows(2)
        pairs = mix(h[pair] * np.uint64(3) + h[pair + 1])
        n = len(words.first) - 1
        v, bounds = values[words.data], words.offsets
        found = [(h >> shift).astype(np.int32), (pairs >> shift).astype(np.int32) + half]
        gram = np.zeros(len(v), np.uint64)
        owners = []
        runs = []
        for k in range(1, max(CHAR_GRAMS) + 1):
            m = max(0, len(v) - k + 1)
            gram = (gram[:m] if k > 1 else np.zeros(m, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + v[k - 1 : k - 1 + m]
            if k in CHAR_GRAMS:
                runs.append((mix(gram + np.uint64(k)) >> shift).astype(np.int32))
                owners.append(k)
        first_pair = np.searchsorted(pair, words.first)
        out = []
        for i in range(n):
            s, e = bounds[i], bounds[i + 1]
            parts = [found[0][words.first[i] : words.first[i + 1]], found[1][first_pair[i] : first_pair[i + 1]]]
            parts += [r[s : max(s, e - k + 1)] for r, k in zip(runs, owners)]
            out.append(_distinct(parts, bits))
        yield words.row, out


def _distinct(parts: list[np.ndarray], bits: int) -> np.ndarray:
    """Sorted; by flags where there are so many numbers that these are faster than a sort."""
    if sum(map(len, parts)) << 5 > 1 << bits:
        flags = np.zeros(1 << bits, bool)
        for part in parts:
            flags[part] = True
        return np.flatnonzero(flags).astype(np.int32)
    at = np.concatenate(parts)
    at.sort()
    new = np.ones(len(at), bool)
    np.not_equal(at[1:], at[:-1], out=new[1:])
    return at[new]


def _counted(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts per feature and label of one partition, with feature -1 for the texts themselves."""
        counts, texts = np.zeros((2, 1 << bits), np.int32), [0, 0]
        for batch in batches:
            labels = np.asarray(batch.column(1))
            for row, features in indicators(batch.column(0), bits):
                for i, at in enumerate(features):
                    counts[labels[row + i], at] += 1
                    texts[labels[row + i]] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.record_batch(
            [pa.array(np.append(at, -1), pa.int32()), *(pa.array(np.append(c[at], n), pa.int64()) for c, n in zip(counts, texts))],
            ["feature", "negative", "positive"],
        )

    return run


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int


def log_ratios(counted: DataFrame, bits: int, smoothing: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Log of how much likelier a feature is in a positive text, and the texts of both labels.

    At most 2 ** bits + 1 rows reach the driver, as Arrow columns.
    """
    rows = counted.groupBy("feature").agg(F.sum("negative").alias("n"), F.sum("positive").alias("p")).toArrow()
    feature, found = rows["feature"].to_numpy(), np.stack([rows["n"].to_numpy(), rows["p"].to_numpy()])
    counts = np.full((2, 1 << bits), smoothing)
    counts[:, feature[feature >= 0]] += found[:, feature >= 0]
    texts = found[:, feature < 0].sum(axis=1).astype(float)
    share = counts / (texts[:, None] + 2 * smoothing)
    return np.log(share[1] / share[0]), texts


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, costs: np.ndarray, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + sum of cost * hinge loss; rows are (features, values).

    Each step solves the dual in the variable of one row exactly, in a new random order per round,
    and moves the weights by its change.
    """
    w, alpha, rng = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([float(v @ v) for _, v in rows])
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            if square[i] == 0:
                continue
            gradient = signs[i] * (w[at] @ v) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), costs[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * signs[i] * v
                largest = max(largest, abs(new - alpha[i]))
                alpha[i] = new
        if largest < 1e-4:
            break
    return w


def _margins(features: list[np.ndarray], weights: np.ndarray, ratios_square: np.ndarray) -> np.ndarray:
    norm = np.array([max(np.sqrt(ratios_square[at].sum()), 1e-9) for at in features])
    return np.array([weights[at].sum() for at in features]) / norm


def calibrate(margins: np.ndarray, positive: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of the logistic curve of best likelihood, by Newton steps."""
    hits, misses = positive.sum(), (~positive).sum()
    target = np.where(positive, (hits + 1) / (hits + 2), 1 / (misses + 2))
    ab = np.array([1.0, np.log((hits + 1) / (misses + 1))])
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * ab)
        ab = ab + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


def bounded_sample(rows: DataFrame, most: int, most_bytes: int = FIT_BYTES) -> list[str]:
    """At most ``most`` different texts of ``most_bytes`` together, in the order of their hashes.

    A text that does not fit what is left of the bytes is passed over. If none fits, the shortest is taken.
    """
    sizes = rows.select(F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes")).distinct()
    picked, left, last, seen = [], most_bytes, None, most
    while len(picked) < most and seen == most:
        # Each turn begins behind the last one's rows, with those that still fit.
        some = sizes.filter(F.col("bytes") <= left)
        found = (some if last is None else some.filter(F.col("h") > last)).orderBy("h").limit(most).collect()
        seen = len(found)
        for r in found:
            last = r.h
            if r.bytes <= left and len(picked) < most:
                picked.append(r.h)
                left -= r.bytes
    if not picked:
        picked = [r.h for r in sizes.orderBy("bytes", "h").limit(1).collect()]
    if not picked:
        return []
    texts = rows.filter(F.xxhash64("text").isin(picked)).select("text").distinct()
    return [r.text for r in texts.orderBy(F.xxhash64("text")).limit(len(picked)).collect()]


def fit(labelled: DataFrame, text_col: str, label_col: str, *, bits: int = BITS, fit_texts: int = FIT_TEXTS, fit_bytes: int = FIT_BYTES, cost: float = 1.0) -> tuple[Model, np.ndarray]:
    """The model of rows (text, label 0 or 1), and the squares of the log-count ratios.

    Log-count ratios come from all labelled rows. The linear model is fitted on the driver, on at
    most ``fit_texts`` rows, the half of them for each label, and ``fit_bytes`` of text for each: those
    with the smallest hashes of their text that fit, so the sample does not depend on how rows lie. Both
    labels have the same total cost. Its probabilities are calibrated on a fifth of the sample that
    an earlier fit did not see, weighted back to the labels' shares.
    """
    rows = labelled.select(named(text_col).cast("string").alias("text"), named(label_col).cast("int").alias("label"))
    path = scratch_path(labelled.sparkSession, "labelled")
    rows.filter("text IS NOT NULL AND label IN (0, 1)").write.parquet(path)
    rows = labelled.sparkSession.read.parquet(path)
    counted = rows.mapInArrow(_counted(bits), "feature int, negative long, positive long")
    ratios, texts_of = log_ratios(counted, bits)
    square = ratios**2
    sample = [(label, text) for label in (0, 1) for text in bounded_sample(rows.filter(F.col("label") == label), fit_texts // 2, fit_bytes)]
    if len({label for label, _ in sample}) < 2:
        share = (sum(label for label, _ in sample) + 1) / (len(sample) + 2)
        return Model(np.zeros(1 << bits), 0.0, 1.0, float(np.log(share / (1 - share))), bits), square
    features = [f for _, some in indicators(pa.array([t for _, t in sample], pa.string()), bits) for f in some]
    positive = np.array([label == 1 for label, _ in sample])

    def weights_of(chosen: np.ndarray) -> np.ndarray:
        scaled = [(features[i], ratios[features[i]] / max(np.sqrt(square[features[i]].sum()), 1e-9)) for i in chosen]
        sides = np.array([positive[chosen].sum(), (~positive[chosen]).sum()])
        costs = cost * len(chosen) / 2 / np.where(positive[chosen], sides[0], sides[1])
        return dual_coordinate_descent(scaled, np.where(positive[chosen], 1, -1), 1 << bits, costs) * ratios

    everyone = np.arange(len(sample))
    unseen = everyone % 5 == 0
    first = weights_of(everyone[~unseen])
    margins = _margins([features[i] for i in everyone[unseen]], first, square)
    slope, shift = calibrate(margins, positive[unseen])
    hits = positive[unseen].sum()
    shift += float(np.log((texts_of[1] + 1) / (texts_of[0] + 1)) - np.log((hits + 1) / (unseen.sum() - hits + 1)))
    return Model(weights_of(everyone), 0.0, slope, shift, bits), square


def score(docs: DataFrame, model: Model, square: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and the probability of label 1, between 0 and 1.

    The whole text counts. A null or empty text has no features and the score of the calibration's
    shift. Each row is scored by itself, so repeated rows score alike; an empty table stays empty.
    """
    weights, bits, slope, shift = model.weights, model.bits, model.slope, model.shift
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), square.astype(np.float32)))

    @F.arrow_udf("double")
    def probability(text: pa.Array) -> pa.Array:
        w, s = shared.value
        out = np.zeros(len(text))
        for row, features in indicators(text, bits):
            out[row : row + len(features)] = _margins(features, w, s)
        return pa.array(1 / (1 + np.exp(-np.clip(slope * out + shift, -30, 30))))

    return docs.withColumn(out, probability(named(text_col).cast("string")))
