"""A logistic model as ONNX bytes, written field by field (the onnx package is not needed)."""

from __future__ import annotations

import struct


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _int(field, value):
    return _varint(field << 3) + _varint(value)


def _part(field, body):
    body = body.encode() if isinstance(body, str) else body
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _tensor(name, dims, values):
    return b"".join(_int(1, d) for d in dims) + _int(2, 1) + _part(8, name) + _part(9, struct.pack(f"<{len(values)}f", *values))


def _node(kind, inputs, output):
    return b"".join(_part(1, i) for i in inputs) + _part(2, output) + _part(4, kind)


def _value(name, width):
    dims = _part(1, _part(2, "N")) + _part(1, _int(1, width))
    return _part(1, name) + _part(2, _part(1, _int(1, 1) + _part(2, dims)))


def logistic(weights: list[float], bias: float, width: int = 1) -> bytes:
    """``sigmoid(x . weights + bias)``; with ``width`` 2 the columns are (1 - p, p)."""
    signs = [1.0] if width == 1 else [-1.0, 1.0]
    graph = (
        _part(1, _node("MatMul", ["x", "w"], "xw"))
        + _part(1, _node("Add", ["xw", "b"], "z"))
        + _part(1, _node("Sigmoid", ["z"], "p"))
        + _part(2, "g")
        + _part(5, _tensor("w", [len(weights), width], [w * s for w in weights for s in signs]))
        + _part(5, _tensor("b", [width], [bias * s for s in signs]))
        + _part(11, _value("x", len(weights)))
        + _part(12, _value("p", width))
    )
    return _int(1, 8) + _part(7, graph) + _part(8, _part(1, "") + _int(2, 13))
