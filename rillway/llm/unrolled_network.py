"""The network of ``toxicity`` over consecutive windows as a graph for ONNX Runtime.

Its kernels take a hyperbolic tangent in a ninth of numpy's time. The few messages of the ONNX format that the graph needs
are written here, as the package that builds them is another one than the package that runs them.
"""

from __future__ import annotations

from functools import cache

import numpy as np

FLOAT, INT64 = 1, 7
INT_ATTRIBUTE = 2


def _number(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _int(field: int, n: int) -> bytes:
    return _number(field << 3) + _number(n)


def _bytes(field: int, value: str | bytes) -> bytes:
    value = value.encode() if isinstance(value, str) else value
    return _number(field << 3 | 2) + _number(len(value)) + value


def _node(op: str, inputs: list[str], outputs: list[str], **attributes: int) -> bytes:
    named = [_bytes(5, _bytes(1, k) + _int(3, v) + _int(20, INT_ATTRIBUTE)) for k, v in attributes.items()]
    return b"".join([*(_bytes(1, x) for x in inputs), *(_bytes(2, x) for x in outputs), _bytes(4, op), *named])


def _constant(name: str, value: int) -> bytes:
    """A tensor of one integer."""
    return _int(1, 1) + _int(2, INT64) + _bytes(8, name) + _bytes(9, np.array([value], "<i8").tobytes())


def _value(name: str, kind: int, shape: tuple[int | str, ...]) -> bytes:
    dims = b"".join(_bytes(1, _int(1, d) if isinstance(d, int) else _bytes(2, d)) for d in shape)
    return _bytes(1, name) + _bytes(2, _bytes(1, _int(1, kind) + _bytes(2, dims)))


def graph(window: int, hidden: int, attention: int) -> bytes:
    """A model whose inputs are the weights and, by direction, what each word gives to the gates.

    Arrays are (feature, window): windows begin at consecutive words, so step t reads a slice of the words' gates.
    """
    nodes: list[bytes] = []

    def add(op: str, inputs: list[str], output: str, **attributes: int) -> str:
        nodes.append(_node(op, inputs, [output], **attributes))
        return output

    for side, order in (("f", range(window)), ("b", range(window - 1, -1, -1))):
        h = "start"
        for t in order:
            k = f"_{side}{t}"
            end = add("Add", ["size", f"at{t}"], "end" + k)
            both, new = (add("Slice", [gate + side, f"at{t}", end, "at1"], f"{gate}{k}") for gate in ("zr_", "n_"))
            both = add("Sigmoid", [add("Gemm", ["u_zr_" + side, h, both], "zr_sum" + k)], "zr" + k)
            nodes.append(_node("Split", [both], ["z" + k, "r" + k], axis=0))
            reset = add("Mul", ["r" + k, add("MatMul", ["u_n_" + side, h], "hn" + k)], "reset" + k)
            n = add("Tanh", [add("Add", [reset, new], "n_sum" + k)], "n" + k)
            kept = add("Mul", ["z" + k, add("Sub", [h, n], "change" + k)], "kept" + k)
            h = add("Add", [n, kept], "h" + k)
            for what in ("attend", "out"):
                if side == "f":
                    add("MatMul", [f"{what}_f", h], f"{what}_f{t}")
                else:
                    add("Gemm", [f"{what}_b", h, f"{what}_f{t}"], f"{what}_b{t}")
    for t in range(window):
        add("MatMul", ["query", add("Tanh", [f"attend_b{t}"], f"attended{t}")], f"weight{t}")
    weight = add("Softmax", [add("Concat", [f"weight{t}" for t in range(window)], "weights", axis=0)], "shares", axis=0)
    read = add("Concat", [f"out_b{t}" for t in range(window)], "reads", axis=0)
    add("ReduceSum", [add("Mul", [weight, read], "parts"), "at0"], "odds", keepdims=0)

    inputs = [("size", INT64, (1,)), ("start", FLOAT, (hidden, "windows")), ("query", FLOAT, (1, attention))]
    for side in ("f", "b"):
        inputs += [("zr_" + side, FLOAT, (2 * hidden, "words")), ("n_" + side, FLOAT, (hidden, "words"))]
        inputs += [("u_zr_" + side, FLOAT, (2 * hidden, hidden)), ("u_n_" + side, FLOAT, (hidden, hidden))]
        inputs += [("attend_" + side, FLOAT, (attention, hidden)), ("out_" + side, FLOAT, (1, hidden))]
    whole = [_bytes(1, n) for n in nodes] + [_bytes(2, "windows")] + [_bytes(5, _constant(f"at{t}", t)) for t in range(max(window, 2))]
    whole += [_bytes(11, _value(*x)) for x in inputs] + [_bytes(12, _value("odds", FLOAT, ("windows",)))]
    return _int(1, 8) + _bytes(8, _bytes(1, "") + _int(2, 14)) + _bytes(7, b"".join(whole))


@cache
def session(window: int, hidden: int, attention: int):
    """What runs the graph in one thread, kept by a worker process for its next tasks; None without ONNX Runtime."""
    try:
        import onnxruntime
    except ImportError:
        return None
    onnxruntime.disable_telemetry_events()
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    # A plan of the memory would be kept for every number of windows.
    options.enable_mem_pattern = False
    return onnxruntime.InferenceSession(graph(window, hidden, attention), options, providers=["CPUExecutionProvider"])
