"""Toxicity: a bidirectional gated recurrent network with attention over characters and words.

It is trained in numpy; windows at every word are scored in numpy too, or by ONNX Runtime where numpy has no registers of 512 bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.quality_classifier import FIT_BYTES, bounded_sample, calibrate
from rillway.llm.unrolled_network import session
from rillway.llm.word_arrays import Rolling, Words, byte_values, mix, split_words
from rillway.session import scratch_path
from rillway.sources.fields import named

WINDOW = 32
# Windows to learn from begin so many words apart; scores come from windows at every word.
STEP = 16
# Words of fewer training texts share one vector.
MIN_TEXTS = 5
CHAR_ROWS = 1 << 14
# Runs of so many bytes of a word, with a mark at both ends of it.
CHAR_GRAMS = (3, 5, 7)
WIDTH = 12
HIDDEN = 12
ATTENTION = 8
# Bytes of training texts whose words are numbered together: it decides which random numbers leave out a vector.
PART_BYTES = 1 << 20
# Texts that the network is trained on, the half of them for each label.
FIT_TEXTS = 4000
EPOCHS = 12
# Windows that go through the network together: any ones, and such as begin at consecutive words, whose arrays fit a core's cache.
BATCH = 4096
RUN = 1696
# ... where ONNX Runtime takes them, to which each of the graph's nodes is a call.
GRAPH_RUN = 2048
HALF = np.array(0.5, np.float32)


@dataclass
class Network:
    """All weights by name, and the hashes of the words with a vector of their own.

    Gates stand in the order update, reset, new.
    """

    p: dict[str, np.ndarray]
    vocabulary: np.ndarray

    @classmethod
    def new(cls, rng: np.random.Generator, vocabulary: np.ndarray) -> Network:
        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        p = {"word": normal(len(vocabulary) + 1, WIDTH, scale=0.1), "char": normal(CHAR_ROWS, WIDTH, scale=0.1)}
        for side in ("f", "b"):
            p["w" + side] = normal(2 * WIDTH, 3 * HIDDEN, scale=(2 * WIDTH) ** -0.5)
            p["u" + side] = normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            p["c" + side] = np.zeros(3 * HIDDEN, np.float32)
        p |= {"attend": normal(2 * HIDDEN, ATTENTION, scale=(2 * HIDDEN) ** -0.5), "query": normal(ATTENTION, scale=1.0)}
        p |= {"out": normal(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5), "bias": np.zeros(1, np.float32)}
        return cls(p, np.sort(vocabulary))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class Tokens:
    """Distinct words of some texts, their character runs, and which of them each word is."""

    key: np.ndarray
    char_row: np.ndarray
    char_bounds: np.ndarray
    of: np.ndarray


def letters_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The word bounds without punctuation at both ends; a word of punctuation only stays whole."""
    d = words.data
    letter = ((d | 32) >= 97) & ((d | 32) <= 122) | (d >= 0x80) | ((d >= 48) & (d <= 57))
    at = np.flatnonzero(letter)
    low, high = np.searchsorted(at, words.start), np.searchsorted(at, words.end) - 1
    some = low <= high
    start, end = words.start.copy(), words.end.copy()
    start[some], end[some] = at[low[some]], at[high[some]] + 1
    return start, end


def tokens(words: Words) -> Tokens:
    start, end = letters_of(words)
    values = byte_values(11, True)[words.data]
    h = Rolling(values).of(start, end)
    distinct, first, of = np.unique(h, return_index=True, return_inverse=True)
    s, size = start[first], (end - start)[first] + 2
    # The distinct words one after the other, each with a mark before and after it.
    place = np.concatenate([[0], np.cumsum(size)])
    own = np.repeat(np.arange(len(s)), size)
    line = np.arange(place[-1])
    within = line - place[own]
    inner = (within > 0) & (within < size[own] - 1)
    ext = np.ones(len(line), np.uint64)
    ext[inner] = values[(s[own] + within - 1)[inner]]
    number = [np.maximum(size - n + 1, 0) for n in CHAR_GRAMS]
    bounds = np.concatenate([[0], np.cumsum(np.sum(number, axis=0))])
    rows, free, rolled = np.empty(bounds[-1], np.int64), bounds[:-1].copy(), np.zeros(len(ext), np.uint64)
    shift = np.uint64(64 - (CHAR_ROWS.bit_length() - 1))
    for n in range(1, max(CHAR_GRAMS) + 1):
        m = max(0, len(ext) - n + 1)
        rolled = rolled[:m] * np.uint64(0x9E3779B97F4A7C15) + ext[n - 1 : n - 1 + m]
        if n in CHAR_GRAMS:
            # A word's runs stand together, those of one size after the other.
            whole = np.flatnonzero(within[:m] + n <= size[own[:m]])
            rows[free[own[whole]] + within[whole]] = mix(rolled[whole] + np.uint64(n)) >> shift
            free += number[CHAR_GRAMS.index(n)]
    return Tokens(distinct, rows, bounds, of)


def windows_of(words: Words, window: int = WINDOW, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, length) of all overlapping windows; the last one of a text ends with it."""
    counts = words.counts()
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - window) // step)), 0)
    text = np.repeat(np.arange(len(counts)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.minimum(number * step, np.maximum(counts[text] - window, 0))
    return text, words.first[text] + begin, np.minimum(counts[text], window)


def word_rows(net: Network, key: np.ndarray) -> np.ndarray:
    """The row of each word's vector; 0 is that of all other words."""
    known = net.vocabulary
    if not len(known):
        return np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return np.where(known[at] == key, at + 1, 0)


def inputs(net: Network, t: Tokens) -> np.ndarray:
    """A row per distinct word: its own vector and the scaled sum of its runs' vectors."""
    p = net.p
    if not len(t.key):
        return np.zeros((0, 2 * WIDTH), np.float32)
    sums = np.add.reduceat(p["char"][t.char_row], t.char_bounds[:-1], axis=0)
    return np.concatenate([p["word"][word_rows(net, t.key)], sums / np.sqrt(np.diff(t.char_bounds)[:, None].astype(np.float32))], axis=1)


def many_inputs(net: Network, t: Tokens) -> np.ndarray:
    """The same as ``inputs`` but for the order of sums, for many words: the next run of all words that have one is added at once."""
    out = np.zeros((len(t.key), 2 * WIDTH), np.float32)
    if not len(t.key):
        return out
    size, char = np.diff(t.char_bounds), net.p["char"]
    order = np.argsort(-size, kind="stable")
    at, size = t.char_bounds[:-1][order], size[order]
    sums = np.zeros((len(size), WIDTH), np.float32)
    for k, n in enumerate(np.searchsorted(-size, -np.arange(size[0]))):
        sums[:n] += char[t.char_row[at[:n] + k]]
    out[:, :WIDTH] = net.p["word"][word_rows(net, t.key)]
    out[order, WIDTH:] = sums / np.sqrt(size[:, None].astype(np.float32))
    return out


def _run(u: np.ndarray, gates: np.ndarray, mask: np.ndarray, order: range, keep: list | None) -> np.ndarray:
    """Hidden states (time, batch, hidden) of one direction; gates (time, batch, 3 hidden) of the inputs."""
    steps, batch, _ = gates.shape
    out = np.empty((steps, batch, HIDDEN), np.float32)
    h = np.zeros((batch, HIDDEN), np.float32)
    for t in order:
        hu = h @ u
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        m = mask[t][:, None]
        if keep is not None:
            keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
        h = np.where(m, new, h)
        out[t] = h
    return out


def gates_of(net: Network, x: np.ndarray) -> dict[str, np.ndarray]:
    """What the inputs give to the gates of each direction, per row of ``x``.

    In products so small that the linear algebra library takes no threads, which would go on waiting at full load.
    """
    out = {side: np.empty((len(x), 3 * HIDDEN), np.float32) for side in ("f", "b")}
    for side, gates in out.items():
        for low in range(0, len(x), 256):
            np.matmul(x[low : low + 256], net.p["w" + side], out=gates[low : low + 256])
        gates += net.p["c" + side]
    return out


def forward(
    net: Network, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None, gates: dict[str, np.ndarray] | None = None
) -> np.ndarray:
    """Log-odds of windows: ``at`` (time, batch) points into the rows of ``x``, whose gates may be given."""
    p, states = net.p, []
    gates = gates_of(net, x) if gates is None else gates
    for side, order in (("f", range(len(at))), ("b", range(len(at) - 1, -1, -1))):
        trace = None if keep is None else keep.setdefault(side, [])
        states.append(_run(p["u" + side], gates[side][at], mask, order, trace))
    h = np.concatenate(states, axis=2)
    a = np.tanh(h @ p["attend"])
    e = np.where(mask, a @ p["query"], np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    weight = e / e.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", weight, h)
    if keep is not None:
        keep |= {"h": h, "a": a, "weight": weight, "pooled": pooled}
    return pooled @ p["out"] + p["bias"]


def gradients(net: Network, t: Tokens, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict, d_odds: np.ndarray) -> dict[str, np.ndarray]:
    """Of the loss by every weight, from its derivative by the log-odds of each window."""
    p = net.p
    g = {k: np.zeros_like(v) for k, v in p.items()}
    h, a, weight, pooled = keep["h"], keep["a"], keep["weight"], keep["pooled"]
    g["out"], g["bias"] = pooled.T @ d_odds, d_odds.sum(keepdims=True)
    d_pooled = d_odds[:, None] * p["out"]
    dh = weight[:, :, None] * d_pooled
    d_weight = np.einsum("bh,tbh->tb", d_pooled, h)
    d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["query"] = np.einsum("tb,tba->a", d_e, a)
    d_a = d_e[:, :, None] * p["query"] * (1 - a * a)
    g["attend"] = np.einsum("tbh,tba->ha", h, d_a)
    dh = dh + d_a @ p["attend"].T
    dx = np.zeros_like(x)
    for i, side in enumerate(("f", "b")):
        u = p["u" + side]
        back = np.zeros((at.shape[1], HIDDEN), np.float32)
        d_gates = np.zeros((*at.shape, 3 * HIDDEN), np.float32)
        for step, before, z, r, n, hn in reversed(keep[side]):
            full = dh[step, :, i * HIDDEN : (i + 1) * HIDDEN] + back
            m = mask[step][:, None]
            d = np.where(m, full, 0)
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (before - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            d_gates[step] = np.concatenate([dz, dr, dn], axis=1)
            from_h = np.concatenate([dz, dr, dn * r], axis=1)
            g["u" + side] += before.T @ from_h
            back = d * z + from_h @ u.T + np.where(m, 0, full)
        flat = np.zeros((len(x), 3 * HIDDEN), np.float32)
        np.add.at(flat, at.ravel(), d_gates.reshape(-1, 3 * HIDDEN))
        g["c" + side] = flat.sum(axis=0)
        g["w" + side] = x.T @ flat
        dx += flat @ p["w" + side].T
    np.add.at(g["word"], word_rows(net, t.key), dx[:, :WIDTH])
    size = np.diff(t.char_bounds)
    np.add.at(g["char"], t.char_row, np.repeat(dx[:, WIDTH:] / np.sqrt(size[:, None].astype(np.float32)), size, axis=0))
    return g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float, decay: float):
        self.m, self.v = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        self.rate, self.decay, self.t = rate, decay, 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, w in p.items():
            self.m[k] += np.float32(0.1) * (g[k] - self.m[k])
            self.v[k] += np.float32(0.001) * (g[k] * g[k] - self.v[k])
            w -= np.float32(rate) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8)) + np.float32(self.rate * self.decay) * w


@cache
def numpy_is_fast() -> bool:
    """Whether numpy has registers of 512 bits: its hyperbolic tangents then took no longer than ONNX Runtime's, on an earlier machine nine times as long."""
    return "AVX512_SKX" in np.show_config(mode="dicts")["SIMD Extensions"].get("found", [])


def odds_at_every_word(net: Network, x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Log-odds of all windows of WINDOW words in the row of words ``of``, which point into the rows of ``x``.

    The same as ``forward``: windows begin one after the other, so what a step reads of the inputs is a
    slice of them, or all of them.
    """
    run = None if numpy_is_fast() else session(WINDOW, HIDDEN, ATTENTION)
    return odds_in_numpy(net, x, of) if run is None else odds_in_graph(run, net, gates_of(net, x), of)


def odds_in_graph(run, net: Network, inputs_give: dict[str, np.ndarray], of: np.ndarray) -> np.ndarray:
    """As ``odds_at_every_word``, by ONNX Runtime."""
    p = net.p
    feed = {"query": p["query"][None]}
    for i, side in enumerate(("f", "b")):
        own, u = slice(i * HIDDEN, (i + 1) * HIDDEN), np.ascontiguousarray(p["u" + side].T)
        feed |= {"u_zr_" + side: u[: 2 * HIDDEN], "u_n_" + side: u[2 * HIDDEN :]}
        feed |= {"attend_" + side: np.ascontiguousarray(p["attend"][own].T), "out_" + side: p["out"][None, own]}
    n_windows = len(of) - WINDOW + 1
    out = np.empty(max(n_windows, 0), np.float32)
    for low in range(0, n_windows, GRAPH_RUN):
        size = min(GRAPH_RUN, n_windows - low)
        for side, table in inputs_give.items():
            gates = np.ascontiguousarray(table[of[low : low + size + WINDOW - 1]].T)
            feed |= {"zr_" + side: gates[: 2 * HIDDEN], "n_" + side: gates[2 * HIDDEN :]}
        feed |= {"start": np.zeros((HIDDEN, size), np.float32), "size": np.array([size])}
        out[low : low + size] = run.run(["odds"], feed)[0]
    return out + p["bias"]


def _aligned(*shape: int) -> np.ndarray:
    """An array that begins at a multiple of 64 bytes, as wide registers are loaded best."""
    n = int(np.prod(shape))
    raw = np.empty(n + 16, np.float32)
    first = -(raw.ctypes.data // 4) % 16
    return raw[first : first + n].reshape(shape)


def _weights(net: Network) -> list[tuple[range, np.ndarray, np.ndarray, np.ndarray]]:
    """Of both directions: the order of the steps, what a state gives to gates, attention and output, what an input gives to the
    gates, and what they always get. A sigmoid is a tanh of half its argument, and those halves are taken into the weights.
    """
    p, out, fold = net.p, [], np.repeat(np.float32([0.5, 1]), [2 * HIDDEN, HIDDEN])[:, None]
    for i, (side, order) in enumerate((("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1)))):
        own = slice(i * HIDDEN, (i + 1) * HIDDEN)
        by_state = np.concatenate([p["u" + side].T * np.float32(0.5), p["attend"][own].T, p["out"][None, own]])
        out.append((order, np.ascontiguousarray(by_state), np.ascontiguousarray(p["w" + side].T) * fold, p["c" + side][:, None] * fold))
    return out


def _give(by_input: np.ndarray, always: np.ndarray, words: np.ndarray, out: np.ndarray) -> None:
    """What words (word, input) give to the gates (gate, word), in products as small as those of ``gates_of``."""
    for low in range(0, len(words), 256):
        np.matmul(by_input, words[low : low + 256].T, out=out[:, low : low + 256])
    np.add(out, always, out=out)


def _cell(y: np.ndarray, gates: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """One step; ``y`` has what the states before it give, and is written over."""
    zr, z, r, new = y[: 2 * HIDDEN], y[:HIDDEN], y[HIDDEN : 2 * HIDDEN], y[2 * HIDDEN : 3 * HIDDEN]
    np.add(zr, gates[: 2 * HIDDEN], out=zr)
    np.tanh(zr, out=zr)
    np.multiply(new, r, out=r)
    np.add(new, r, out=new)
    np.add(new, gates[2 * HIDDEN :], out=new)
    np.tanh(new, out=new)
    np.subtract(before, new, out=r)
    np.multiply(r, HALF, out=r)
    np.multiply(z, r, out=z)
    np.add(r, z, out=r)
    np.add(r, new, out=after)


def full_window_odds(net: Network, x: np.ndarray, of: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log-odds of the windows of WINDOW words that begin anywhere in the row of words ``of``. Arrays are (feature, window)."""
    out = np.empty(len(begin), np.float32)
    for low in range(0, len(begin), RUN):
        b = begin[low : low + RUN]
        y, g, h = (_aligned(n, len(b)) for n in (3 * HIDDEN + ATTENTION + 1, 3 * HIDDEN, HIDDEN))
        read = np.zeros((WINDOW, ATTENTION + 1, len(b)), np.float32)
        for order, by_state, by_input, always in _weights(net):
            h[:], y[:] = 0, 0
            for t in order:
                _give(by_input, always, x[of[b + t]], g)
                _cell(y, g, h, h)
                np.matmul(by_state, h, out=y)
                read[t] += y[3 * HIDDEN :]
        e = np.einsum("a,tab->tb", net.p["query"], np.tanh(read[:, :ATTENTION]))
        e = np.exp(e - e.max(axis=0))
        out[low : low + RUN] = (e * read[:, ATTENTION]).sum(axis=0) / e.sum(axis=0)
    return out + net.p["bias"]


def odds_in_numpy(net: Network, x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """As ``odds_at_every_word``. Arrays are (feature, column), and a column is a place of the text, not a window: in each step
    the states move on to the next word, so that all steps read the same gates, as they lie in memory.

    States that move are the same array read from one element earlier or later. What comes into a row's end that way
    belongs to windows that begin outside, which are not read.
    """
    n_windows = len(of) - WINDOW + 1
    out = np.empty(max(n_windows, 0), np.float32)
    if n_windows <= 0:
        return out
    each = -(-n_windows // -(-n_windows // RUN))
    # A word's states come out one column from its own: after it, or before it where words are read from the end.
    columns = -(-(each + WINDOW + 1) // 16) * 16
    cells = HIDDEN * columns
    y, g, states = _aligned(3 * HIDDEN + ATTENTION + 1, columns), _aligned(3 * HIDDEN, columns), _aligned(cells + 32)
    seen, attend = y[3 * HIDDEN :], y[3 * HIDDEN : 3 * HIDDEN + ATTENTION]
    h = states[16 : 16 + cells].reshape(HIDDEN, columns)
    first_read = _aligned(WINDOW, ATTENTION + 1, columns)
    weights, reads = _aligned(WINDOW, columns), _aligned(WINDOW, columns)
    at, sides = np.zeros(columns, np.int64), _weights(net)
    for low in range(0, n_windows, each):
        size = min(each, n_windows - low)
        for i, (order, by_state, by_input, always) in enumerate(sides):
            at[:] = 0
            at[2 * i : 2 * i + size + WINDOW - 1] = of[low : low + size + WINDOW - 1]
            _give(by_input, always, x[at], g)
            moved = states[15 + 2 * i : 15 + 2 * i + cells].reshape(HIDDEN, columns)
            states[:], y[:] = 0, 0
            for t in order:
                _cell(y, g, moved, h)
                np.matmul(by_state, moved, out=y)
                if i == 0:
                    first_read[t] = seen
                else:
                    np.add(seen, first_read[t], out=seen)
                    np.tanh(attend, out=attend)
                    np.matmul(net.p["query"], attend, out=weights[t])
                    reads[t] = seen[ATTENTION]
        # Step t of a window is t columns on from where the window begins.
        e, read = (np.lib.stride_tricks.as_strided(a[:, 1:], (WINDOW, size), (a.strides[0] + 4, 4)) for a in (weights, reads))
        e = np.exp(e - e.max(axis=0))
        out[low : low + size] = (e * read).sum(axis=0) / e.sum(axis=0)
    return out + net.p["bias"]


def window_odds(net: Network, t: Tokens, begin: np.ndarray, length: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
    """Log-odds of any windows; those of WINDOW words take the faster way."""
    out = np.zeros(len(begin), np.float32)
    x = many_inputs(net, t) if x is None else x
    full = length == WINDOW
    out[full] = full_window_odds(net, x, t.of, begin[full])
    short = np.flatnonzero(~full)
    if len(short):
        steps, gates = np.arange(WINDOW)[:, None], gates_of(net, x)
        for low in range(0, len(short), BATCH):
            some = short[low : low + BATCH]
            at = t.of[np.minimum(begin[some] + steps, len(t.of) - 1)]
            out[some] = forward(net, x, at, steps < length[some], gates=gates)
    return out


def text_odds(net: Network, texts: pa.Array, empty: float) -> np.ndarray:
    """The highest log-odds of all windows of each text, at every word; ``empty`` without a word."""
    out = np.full(len(texts), empty, np.float32)
    for words in split_words(texts):
        t, counts = tokens(words), words.counts()
        x = many_inputs(net, t)
        top = np.full(len(counts), empty, np.float32)
        short = np.flatnonzero((counts > 0) & (counts < WINDOW))
        top[short] = window_odds(net, t, words.first[short], counts[short], x)
        full = np.flatnonzero(counts >= WINDOW)
        if len(full):
            # The texts with a full window one after the other; windows across two texts count for none.
            long = np.repeat(counts >= WINDOW, counts)
            odds = odds_at_every_word(net, x, t.of[long])
            last = np.cumsum(counts[full])
            bounds = np.stack([last - counts[full], last - WINDOW + 1], axis=1).ravel()
            top[full] = np.maximum.reduceat(np.append(odds, np.float32(-np.inf)), bounds)[::2]
        out[words.row : words.row + len(counts)] = top
    return out


@dataclass
class Part:
    """A chunk of the training texts: its words, and the text, first word and length of each window."""

    tokens: Tokens
    text: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    owner: np.ndarray


def _parts(texts: list[str]) -> list[Part]:
    out = []
    for words in split_words(pa.array(texts, pa.large_string()), PART_BYTES):
        text, begin, length = windows_of(words)
        if len(text):
            owner = words.row + np.repeat(np.arange(len(words.first) - 1), words.counts())
            out.append(Part(tokens(words), words.row + text, begin, length, owner))
    return out


def _joined(parts: list[Part]) -> Tokens:
    """The words of all parts as one: rows and characters numbered on from part to part."""
    rows = np.cumsum([0] + [len(p.tokens.key) for p in parts])
    chars = np.cumsum([0] + [len(p.tokens.char_row) for p in parts])
    bounds = [p.tokens.char_bounds[:-1] + c for p, c in zip(parts, chars)] + [chars[-1:]]
    of = np.concatenate([p.tokens.of + r for p, r in zip(parts, rows)])
    return Tokens(np.concatenate([p.tokens.key for p in parts]), np.concatenate([p.tokens.char_row for p in parts]), np.concatenate(bounds), of)


def _some(t: Tokens, at: np.ndarray) -> tuple[Tokens, np.ndarray]:
    """The words that ``at`` points to, and ``at`` numbered within them."""
    used, local = np.unique(at, return_inverse=True)
    size = np.diff(t.char_bounds)[used]
    bounds = np.concatenate([[0], np.cumsum(size)])
    chars = np.repeat(t.char_bounds[used] - bounds[:-1], size) + np.arange(bounds[-1])
    return Tokens(t.key[used], t.char_row[chars], bounds, local), local.reshape(at.shape)


def train(texts: list[str], toxic: np.ndarray, *, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, decay: float = 0.02, seed: int = 0) -> Network:
    """A network for windows, from labels of whole texts.

    A text is as toxic as its worst window. In each epoch a toxic text stands for the window that
    scores highest, at first by how much more often its words occur in toxic texts; a clean text
    stands for its highest and a random window. Word vectors are at times left out, so that
    characters are learned too.
    """
    rng = np.random.default_rng(seed)
    parts = _parts(texts)
    if not parts:
        return Network.new(rng, np.empty(0, np.uint64))
    t = _joined(parts)
    shift = np.cumsum([0] + [len(p.tokens.of) for p in parts])
    text = np.concatenate([p.text for p in parts])
    begin = np.concatenate([p.begin + s for p, s in zip(parts, shift)])
    length = np.concatenate([p.length for p in parts])
    owner = np.concatenate([p.owner for p in parts])
    words, number = np.unique(t.key, return_inverse=True)
    seen = np.unique(owner * len(words) + number[t.of])
    hits = np.bincount(seen % len(words), toxic[seen // len(words)], minlength=len(words))
    misses = np.bincount(seen % len(words), 1 - toxic[seen // len(words)], minlength=len(words))
    net = Network.new(rng, words[hits + misses >= MIN_TEXTS])
    ratio = np.log((hits + 1) / (toxic.sum() + 2)) - np.log((misses + 1) / ((1 - toxic).sum() + 2))
    ratio = (ratio * np.minimum(1, (hits + misses) / 10))[number[t.of]]
    odds = np.array([ratio[b : b + n].max() for b, n in zip(begin, length)])
    adam = Adam(net.p, rate, decay)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    filled = np.flatnonzero(first[1:] > first[:-1])
    steps = np.arange(WINDOW)[:, None]
    for epoch in range(epochs):
        if epoch >= 2:
            odds = np.concatenate([window_odds(net, p.tokens, p.begin, p.length) for p in parts])
        top = np.array([first[i] + np.argmax(odds[first[i] : first[i + 1]]) for i in filled])
        clean = filled[toxic[filled] == 0]
        other = first[clean] + (rng.random(len(clean)) * (first[clean + 1] - first[clean])).astype(int)
        chosen = np.concatenate([top, other])
        label = np.concatenate([toxic[filled], np.zeros(len(other))]).astype(np.float32)
        side = np.where(label == 1, len(label) / 2 / max(label.sum(), 1), len(label) / 2 / max((1 - label).sum(), 1)).astype(np.float32)
        order = rng.permutation(len(chosen))
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            mask = steps < length[chosen[some]]
            part, at = _some(t, t.of[np.minimum(begin[chosen[some]] + steps, len(t.of) - 1)])
            x = inputs(net, part)
            x[:, :WIDTH] *= (rng.random(len(x)) > 0.25)[:, None]
            keep: dict = {}
            out = forward(net, x, at, mask, keep)
            d = (_sigmoid(out) - label[some]) * side[some] / len(some)
            adam.step(net.p, gradients(net, part, x, at, mask, keep, d))
        adam.rate *= 0.8
    return net


@dataclass(frozen=True)
class Detector:
    net: Network
    slope: float
    shift: float
    empty: float


def fit(labelled: DataFrame, text_col: str, label_col: str, *, fit_texts: int = FIT_TEXTS, fit_bytes: int = FIT_BYTES) -> Detector:
    """A detector from rows (text, label 0 or 1).

    Trained on the driver on at most ``fit_texts`` texts, the half of them for each label and
    ``fit_bytes`` for each, taken by the smallest hashes of the texts that fit. A fifth of them is set aside to turn a text's
    highest log-odds into a probability, at the labels' shares in all labelled rows. Without texts
    of both labels every text gets the share of label 1.
    """
    rows = labelled.select(named(text_col).cast("string").alias("text"), named(label_col).cast("int").alias("label"))
    path = scratch_path(labelled.sparkSession, "labelled")
    rows.filter("text IS NOT NULL AND label IN (0, 1)").write.parquet(path)
    rows = labelled.sparkSession.read.parquet(path)
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    sample = [(label, text) for label in (0, 1) for text in bounded_sample(rows.filter(F.col("label") == label), fit_texts // 2, fit_bytes)]
    all_odds = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    label = np.array([x for x, _ in sample])
    if len(set(label)) < 2:
        return Detector(Network.new(np.random.default_rng(0), np.empty(0, np.uint64)), 0.0, all_odds, 0.0)
    texts = [x for _, x in sample]
    aside = np.arange(len(texts)) % 5 == 0
    net = train([x for x, a in zip(texts, aside) if not a], label[~aside])
    odds = text_odds(net, pa.array([x for x, a in zip(texts, aside) if a], pa.large_string()), 0.0)
    positive = label[aside] == 1
    slope, shift = calibrate(odds, positive)
    shift += all_odds - float(np.log((positive.sum() + 1) / ((~positive).sum() + 1)))
    return Detector(net, slope, shift, float(odds.min()))


def score(docs: DataFrame, detector: Detector, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and the probability, between 0 and 1, that a text is toxic.

    All windows of 32 words of the whole text, one from each word, are scored; the highest counts. A null
    or blank text gets the lowest score seen when the detector was fitted. Each row is scored by
    itself, so repeated rows score alike; an empty table stays empty.
    """
    slope, shift, empty = detector.slope, detector.shift, detector.empty
    # Plain arrays: a worker need not have this package to read them.
    shared = docs.sparkSession.sparkContext.broadcast((detector.net.p, detector.net.vocabulary))

    @F.arrow_udf("double")
    def probability(text: pa.Array) -> pa.Array:
        odds = text_odds(Network(*shared.value), text, empty).astype(float)
        return pa.array(1 / (1 + np.exp(-np.clip(slope * odds + shift, -30, 30))))

    return docs.withColumn(out, probability(named(text_col).cast("string")))
