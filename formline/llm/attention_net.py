"""The attention model's arithmetic as one graph for onnxruntime: what ``AttentionLM`` says in numpy, in single precision.

A graph is written as the bytes of ONNX's own format, since its runtime is here and its builder is not.  Rows that choose
within a class are dealt into blocks of equal length, one class each, filled up with rows of weight 0, so that all classes
are one product.  A session has one thread: Spark's tasks are the parallelism.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import onnxruntime

_KINDS = {"float32": 1, "int32": 6, "int64": 7}


def _varint(n: int) -> bytes:
    out, n = b"", n & (2**64 - 1)
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _part(field: int, raw: bytes | str) -> bytes:
    raw = raw.encode() if isinstance(raw, str) else raw
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


class Graph:
    """Nodes, constants, inputs and outputs, as they are asked for."""

    def __init__(self) -> None:
        self.nodes, self.fixed, self.ends, self.n, self.names = b"", b"", b"", 0, []

    def input(self, name: str, kind: str, *shape: int | str) -> str:
        dims = b"".join(_part(1, _number(1, d) if isinstance(d, int) else _part(2, d)) for d in shape)
        self.ends += _part(11, _part(1, name) + _part(2, _part(1, _number(1, _KINDS[kind]) + _part(2, dims))))
        return name

    def constant(self, values) -> str:
        values, self.n = np.asarray(values), self.n + 1
        self.fixed += _part(5, b"".join(_number(1, d) for d in values.shape) + _number(2, _KINDS[str(values.dtype)]) + _part(8, f"c{self.n}") + _part(9, values.tobytes()))
        return f"c{self.n}"

    def __call__(self, kind: str, *ins: str, name: str = "", domain: str = "", **said: int | float | str) -> str:
        self.n += 1
        name, own = name or f"t{self.n}", b""
        for k, v in said.items():
            value = _varint(2 << 3 | 5) + struct.pack("<f", v) + _number(20, 1) if isinstance(v, float) else _number(3, v) + _number(20, 2) if isinstance(v, int) else _part(4, v) + _number(20, 3)
            own += _part(5, _part(1, k) + value)
        self.nodes += _part(1, b"".join(_part(1, i) for i in ins) + _part(2, name) + _part(4, kind) + own + _part(7, domain))
        return name

    def output(self, name: str, made: str) -> None:
        self("Identity", made, name=name)
        self.ends += _part(12, _part(1, name) + _part(2, _part(1, _number(1, 1))))
        self.names.append(name)

    def session(self) -> onnxruntime.InferenceSession:
        said = onnxruntime.SessionOptions()
        said.intra_op_num_threads, said.inter_op_num_threads, said.log_severity_level = 1, 1, 3
        said.enable_mem_pattern = False  # a plan of memory is kept for every number of rows, and no two steps have the same
        raw = _number(1, 8) + _part(7, self.nodes + _part(2, "net") + self.fixed + self.ends) + b"".join(_part(8, _part(1, d) + _number(2, v)) for d, v in (("", 17), ("com.microsoft", 1)))
        return onnxruntime.InferenceSession(raw, said, providers=["CPUExecutionProvider"])


@cache
def network(window: int, width: int, inner: int, levels: tuple, slots: int, learns: bool) -> tuple[onnxruntime.InferenceSession, list[str]]:
    """The session for windows of slots, and its outputs' names: log probabilities of choices, and gradients if it ``learns``."""
    g, grads = Graph(), {}
    x32 = lambda name, *shape: g.input(name, "float32", *shape)
    i64 = lambda name, *shape: g.input(name, "int64", *shape)
    ints = lambda *v: g.constant(np.array(v, np.int64))
    low, high = g.constant(np.float32(-60)), g.constant(np.float32(60))
    flat, deep = (lambda v: g("Reshape", v, ints(-1, width))), (lambda v: g("Reshape", v, ints(-1, window, width)))
    times = lambda a, b, **k: g("FusedMatMul", a, b, domain="com.microsoft", **k)

    zeros = lambda v: g("ConstantOfShape", g("Shape", v))
    slot, counted = i64("slot", "b", window), i64("counted", "n")
    emb, pos, wa, wm = x32("emb", slots, width), x32("pos", window, width), x32("wa", width, width), x32("wm", width, width)
    w1, b1, w2 = x32("w1", width, inner), x32("b1", inner), x32("w2", inner, width)
    x = g("Add", g("Gather", emb, slot), pos)
    q, v = g("MatMul", x, wa), g("MatMul", x, wm)
    s = g("Clip", times(q, x, transB=1), low, high)
    s = g("Softmax", g("Add", s, g.constant(np.triu(np.full((window, window), -1e9, np.float32), 1))), axis=-1)
    c = g("MatMul", s, v)
    y = flat(g("Add", x, c))
    u = g("Relu", g("Gemm", y, w1, b1))
    z = g("Gemm", u, w2, y)
    known = g("Gather", z, counted)

    def choice(rows, weights, bias, which, name, of=None):
        """Log probabilities of one choice of each row; its gradient by what is chosen from, if the network learns.  ``which`` are places in all rows' choices."""
        e = g("Clip", g("Add", g("MatMul", rows, weights), bias), low, high)
        row = lambda v: g("Gather", g("Reshape", v, ints(-1)), which)
        if not learns:
            total = g("ReduceSum", g("Exp", e), ints(-1), keepdims=0)
            g.output(f"lp_{name}", g("Sub", row(e), g("Reshape", g("Log", total), ints(-1))))
            return None
        p = g("Softmax", e, axis=-1)
        g.output(f"lp_{name}", g("Log", g("Max", row(p), g.constant(np.float32(1e-37)))))
        e = g("Reshape", g("ScatterElements", g("Reshape", p, ints(-1)), which, g("Expand", g.constant(np.float32(-1)), g("Shape", which)), reduction="add"), g("Shape", p))
        return g("Mul", e, of) if of else e

    back = None
    for i, (h, n_classes, size) in enumerate(levels):
        wh, bh, wc, bc = x32(f"wh{i}", width, h + n_classes + 1), x32(f"bh{i}", h + n_classes + 1), x32(f"wc{i}", n_classes, width, size), x32(f"bc{i}", n_classes, size)
        rows, first, of = (i64(f"rows{i}", f"r{i}"), i64(f"first{i}", f"r{i}"), x32(f"of{i}", f"r{i}", 1)) if i else ("", i64("first0", "n"), None)
        kind, at, own, of_own = i64(f"kind{i}", f"k{i}"), i64(f"at{i}", f"k{i}", f"l{i}"), i64(f"own{i}", f"m{i}"), x32(f"of_own{i}", f"k{i}", f"l{i}", 1)
        here = g("Gather", known, rows) if i else known
        inside, own_w = g("Gather", known, at), g("Gather", wc, kind)
        e = choice(here, wh, bh, first, f"first{i}", of)
        f = choice(inside, own_w, g("Unsqueeze", g("Gather", bc, kind), ints(1)), own, f"own{i}", of_own)
        if learns:
            grads |= {f"wh{i}": g("Gemm", here, e, transA=1), f"bh{i}": g("ReduceSum", e, ints(0), keepdims=0)}
            grads |= {f"wc{i}": times(inside, f, transA=1), f"bc{i}": g("ReduceSum", f, ints(1), keepdims=0)}  # by block
            d = times(e, wh, transB=1)
            back = g("ScatterND", back, g("Unsqueeze", rows, ints(1)), d, reduction="add") if i else d
            back = g("ScatterND", back, g("Unsqueeze", at, ints(2)), times(f, own_w, transB=1), reduction="add")
    if learns:
        dz = g("ScatterND", zeros(z), g("Unsqueeze", counted, ints(1)), back)
        du = g("Mul", times(dz, w2, transB=1), g("Cast", g("Greater", u, g.constant(np.float32(0))), to=1))
        dy = deep(g("Gemm", du, w1, dz, transB=1))
        ds = g("Mul", g("Sub", times(dy, v, transB=1), g("ReduceSum", g("Mul", dy, c), ints(-1))), s)
        dq, dv = flat(g("MatMul", ds, x)), flat(times(s, dy, transA=1))
        grads |= {"w2": g("Transpose", g("Gemm", dz, u, transA=1)), "w1": g("Gemm", y, du, transA=1), "b1": g("ReduceSum", du, ints(0), keepdims=0)}
        grads |= {"wa": g("Gemm", flat(x), dq, transA=1), "wm": g("Gemm", flat(x), dv, transA=1)}
        dx = g("Gemm", dq, wa, flat(g("Add", dy, times(ds, q, transA=1))), transB=1)
        dx = deep(g("Gemm", dv, wm, dx, transB=1))
        grads |= {"pos": g("ReduceSum", dx, ints(0), keepdims=0), "emb": g("ScatterND", zeros(emb), g("Unsqueeze", slot, ints(-1)), dx, reduction="add")}
        for name, made in grads.items():
            g.output(f"d_{name}", made)
    return g.session(), g.names
