"""Quality by weak supervision: rules vote or abstain, and their accuracies are estimated."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.llm.word_arrays import mix, split_words, text_bytes
from rillway.sources.fields import named

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper", "n_letter_words", "n_shouts", "n_distinct",
)


def _per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in _MEASURES]))
def text_measures(text: pa.Array) -> pa.Array:
    """Counts over a whole text; null counts as empty. Letters are A-Z, a-z and all beyond ASCII."""
    symbols, shouts = _table(b"#*$%&|<>"), _table(b"!?")
    parts: dict[str, list] = {name: [] for name in _MEASURES}
    data, offsets = text_bytes(text)
    for words in split_words(text):
        d, bounds, first = words.data, words.offsets, words.first
        solid = ~((d == 32) | ((d >= 9) & (d <= 13)))
        begins = (d & 0xC0) != 0x80
        upper = (d >= 65) & (d <= 90)
        letter = (upper | ((d >= 97) & (d <= 122)) | (d >= 0x80)) & begins
        letters = np.zeros(len(d) + 1, np.int64)
        np.cumsum(letter, out=letters[1:])
        n = len(first) - 1
        owner = np.repeat(np.arange(n), words.counts())
        h = words.hashes() + mix(owner.astype(np.uint64))
        at = words.windows(3)
        gram = mix((h[at] * np.uint64(3) + h[at + 1]) * np.uint64(5) + h[at + 2]) if len(at) else np.empty(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        same = gram[order[1:]] == gram[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        repeated = np.zeros(len(h), bool)
        for i in range(3):
            repeated[at[twice] + i] = True
        distinct = np.unique(h, return_index=True)[1]
        lines, dups = [], []
        for i in range(n):
            full = [x for x in d[bounds[i] : bounds[i + 1]].tobytes().split(b"\n") if x.strip()]
            lines.append(len(full))
            dups.append(len(full) - len(set(full)))
        parts["n_words"].append(words.counts())
        parts["word_chars"].append(_per_text(solid & begins, bounds))
        parts["n_symbols"].append(_per_text(symbols[d], bounds))
        parts["n_dup_lines"].append(np.array(dups))
        parts["n_repeat_words"].append(_per_text(repeated, first))
        parts["n_lines"].append(np.array(lines))
        parts["n_letters"].append(_per_text(letter, bounds))
        parts["n_upper"].append(_per_text(upper, bounds))
        parts["n_letter_words"].append(_per_text(letters[words.end] > letters[words.start], first))
        parts["n_shouts"].append(_per_text(shouts[d[words.end - 1]] if len(h) else np.empty(0, bool), first))
        parts["n_distinct"].append(np.bincount(owner[distinct], minlength=n))
    arrays = [pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)) for x in parts.values()]
    return pa.StructArray.from_arrays(arrays, list(_MEASURES))


@dataclass(frozen=True)
class Rule:
    """Votes bad beyond ``bad`` and good within ``good``; abstains between and without a value.

    ``of`` gives a ratio of two measures, which is null where the second is 0; with ``root`` it is a ratio
    to the square root of the second.
    """

    name: str
    of: tuple[str, str]
    good: float
    bad: float
    root: bool = False

    def vote(self, m: Column) -> Column:
        """1 good, -1 bad, 0 no vote."""
        top, under = (m.getField(x).cast("double") for x in self.of)
        ratio = F.when(under > 0, top / (F.sqrt(under) if self.root else under))
        good, bad = (ratio <= self.good, ratio >= self.bad) if self.good < self.bad else (ratio >= self.good, ratio <= self.bad)
        return F.when(good, 1).when(bad, -1).otherwise(0)


RULES = (
    Rule("short words", ("word_chars", "n_words"), good=3.0, bad=2.0),
    Rule("long words", ("word_chars", "n_words"), good=10.0, bad=15.0),
    Rule("symbols", ("n_symbols", "n_words"), good=0.02, bad=0.2),
    Rule("repeated lines", ("n_dup_lines", "n_lines"), good=0.1, bad=0.5),
    Rule("repeated words", ("n_repeat_words", "n_words"), good=0.1, bad=0.3),
    Rule("words with letters", ("n_letter_words", "n_words"), good=0.9, bad=0.7),
    Rule("capitals", ("n_upper", "n_letters"), good=0.15, bad=0.5),
    Rule("shouts", ("n_shouts", "n_words"), good=0.05, bad=0.3),
    # The number of different words grows like a root of the length; these are shares of 0.2 and 0.05 at MIN_WORDS.
    Rule("few different words", ("n_distinct", "n_words"), good=0.2 * MIN_WORDS**0.5, bad=0.05 * MIN_WORDS**0.5, root=True),
)


@dataclass(frozen=True)
class Accuracies:
    """Share of good texts; per rule, how often its vote on a good and on a bad text is right."""

    good_share: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


# How often a rule may at most vote against a good text.
FALSE_ALARMS = 0.005


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Accuracies:
    """Expectation-maximisation over the distinct vote patterns.

    It begins with texts that some rule votes against as likely bad. Most bad texts fail one rule
    only, so agreement between rules alone does not tell a bad text from a rule that errs on good
    ones. Two things tie the classes down: rules are written to spare good texts, so votes against
    those stay within FALSE_ALARMS; and there is no sign of badness but a vote, so texts without one
    against them count as good throughout. Votes for a text are not independent, as nearly every text gets
    nearly all of them: together they weigh as much as one, their mean. Each share has a few pseudo-counts. Without any text, what the pseudo-counts say is returned.
    """
    n_rules = votes.shape[1] if votes.size else len(RULES)
    votes, counts = votes.reshape(-1, n_rules), counts.astype(float)
    spared = ~(votes < 0).any(axis=1)
    n_for = np.maximum((votes > 0).sum(axis=1), 1)
    good = np.where(spared, 1.0, 0.1)
    for _ in range(rounds):
        wg, wb = counts * good, counts * (1 - good)
        share = np.clip((wg.sum() + 8) / (counts.sum() + 10), 0.05, 0.95)
        right_good = np.clip((wg @ (votes > 0) + 8) / (wg @ (votes != 0) + 10), 1 - FALSE_ALARMS, 0.9999)
        right_bad = np.clip((wb @ (votes < 0) + 5) / (wb @ (votes != 0) + 10), 1 - right_good, 0.999)
        odds = np.log(share / (1 - share)) + (votes > 0) @ np.log(right_good / (1 - right_bad)) / n_for + (votes < 0) @ np.log((1 - right_good) / right_bad)
        now = np.where(spared, 1.0, 1 / (1 + np.exp(-odds)))
        if len(now) == 0 or np.abs(now - good).max() < 1e-9:
            break
        good = now
    return Accuracies(float(share), tuple(map(float, right_good)), tuple(map(float, right_bad)))


def probability(m: Column, accuracies: Accuracies) -> Column:
    """The posterior probability that a text is good, from its votes; 0.5 at least without one against."""
    votes = [rule.vote(m) for rule in RULES]
    in_favour, n_for, against, spared = F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(True)
    for vote, g, b in zip(votes, accuracies.on_good, accuracies.on_bad):
        in_favour = in_favour + F.when(vote > 0, float(np.log(g / (1 - b)))).otherwise(0.0)
        n_for = n_for + F.when(vote > 0, 1).otherwise(0)
        against = against + F.when(vote < 0, float(np.log((1 - g) / b))).otherwise(0.0)
        spared = spared & (vote >= 0)
    odds = float(np.log(accuracies.good_share / (1 - accuracies.good_share))) + in_favour / F.greatest(n_for, F.lit(1)) + against
    good = 1 / (1 + F.exp(-odds))
    return F.when(spared, F.greatest(good, F.lit(0.5))).otherwise(good)


def learn_accuracies(measured: DataFrame, m: Column) -> Accuracies:
    """From all rows. The driver gets one row per vote pattern: at most 3 ** (number of rules)."""
    pattern = F.array(*[rule.vote(m) for rule in RULES]).alias("votes")
    found = measured.select(pattern).groupBy("votes").count().orderBy("votes").collect()
    return estimate(np.array([r.votes for r in found]), np.array([r["count"] for r in found]))


def base_failed(m: Column) -> Column:
    return (m.getField("n_words") < MIN_WORDS) | (100 * m.getField("n_repeat_words") > MAX_REPEAT_PERCENT * m.getField("n_words"))


def judged(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` and one struct more, whose (free) name is returned.

    The struct holds the measures, ``base_failed``, ``probability`` and ``kept``. A text is kept if
    it has 50 words or more, at most half of them in repeated 3-word windows, and is good with a
    probability of 0.5 or more. Null and empty texts fail the base. Each row is judged by itself
    given the accuracies, so repeated rows are all kept or all not; an empty table stays empty.
    The accuracies come from one scan of all rows, the verdicts from a second; no text is shuffled.
    """
    name = "judged"
    while name in (c.lower() for c in docs.columns):
        name = "_" + name
    measured = docs.withColumn(name, text_measures(named(text_col).cast("string")))
    m = F.col(name)
    accuracies = learn_accuracies(measured.select(m), m)
    good = probability(m, accuracies)
    out = measured.withColumn(
        name,
        F.struct(*[m.getField(x).alias(x) for x in _MEASURES], base_failed(m).alias("base_failed"), good.alias("probability"), (~base_failed(m) & (good >= 0.5)).alias("kept")),
    )
    return out, name
