"""Bases of many rows at once: the texts of an Arrow column as one array of bytes, their contexts and k-mer numbers.

One byte is one base. Loops run over batches and over the bases of a k-mer, never over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bases that are worked on together, which bounds memory.
PART = 1 << 18
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i


def codes(data: np.ndarray) -> np.ndarray:
    """0 to 3 for A, C, G and T, 4 for any other byte."""
    return _CODE[data]


def flat(column: pa.Array, between: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, each followed by ``between``, and where each begins with one entry more for the end. Nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = pc.binary_join_element_wise(column, between, "") if between else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8), at - at[0]


def parts(batch: pa.RecordBatch, column: str, most: int = PART) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``most`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def texts(letters: np.ndarray) -> pa.Array:
    """Rows of a matrix of bytes as strings."""
    n, k = letters.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * k, k, dtype=np.int32) if k else np.zeros(n + 1, np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))


def differing(a: pa.Array, b: pa.Array, bisulfite: bool = False) -> np.ndarray:
    """Places where two texts of each row differ, one by one from the start, and by how much one is longer; with bisulfite a T of the first may stand on a C."""
    (one, at), (two, to) = flat(a), flat(b)
    n, m = np.diff(at), np.diff(to)
    if not len(n) or (n[0] == n).all() and (n == m).all():
        x, y, row = one, two, None
    else:
        both = np.minimum(n, m)
        row = np.repeat(np.arange(len(n)), both)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
        x, y = one[at[row] + inner], two[to[row] + inner]
    bad = x != y
    if bisulfite:
        bad &= (x != ord("T")) | (y != ord("C"))
    return bad.reshape(len(n), -1).sum(axis=1) if row is None and len(n) else np.bincount(row if row is not None else [], bad, minlength=len(n)).astype(np.int64) + abs(n - m)


def edits(a: pa.Array, b: pa.Array, most: int) -> np.ndarray:
    """Edit distance of two texts of each row, -1 beyond ``most``; only the diagonals within ``most`` are computed, of all rows of equal lengths together."""
    (one, at), (two, to) = flat(a), flat(b)
    n, m = np.diff(at), np.diff(to)
    out = np.full(len(n), -1)
    steps, far = np.arange(2 * most + 1), most + 1
    sizes, group = np.unique(np.stack([n, m], axis=1), axis=0, return_inverse=True)
    group = group.ravel()
    order = np.argsort(group, kind="stable")
    for (t, u), rows in zip(sizes.tolist(), np.split(order, np.cumsum(np.bincount(group))[:-1])):
        if abs(t - u) > most:
            continue
        x = one[at[rows][:, None] + np.arange(t)]
        y = np.zeros((len(rows), u + 2 * most + max(t - u, 0)), np.uint8)
        y[:, most : most + u] = two[to[rows][:, None] + np.arange(u)]
        cost = np.broadcast_to(np.where(steps >= most, steps - most, far), (len(rows), len(steps)))
        for i in range(1, t + 1):
            here = cost + (x[:, i - 1 : i] != y[:, i - 1 : i + 2 * most])
            here[:, :-1] = np.minimum(here[:, :-1], cost[:, 1:] + 1)
            j = i + steps - most
            here[:, (j < 0) | (j > u)] = far
            if i <= most:
                here[:, most - i] = i
            cost = np.minimum(np.minimum.accumulate(here - steps, axis=1) + steps, far)
        last = cost[:, u - t + most]
        out[rows] = np.where(last <= most, last, -1)
    return out


#: Every byte as a string of its own.
LETTERS = pa.array([chr(i) if i < 128 else "" for i in range(256)])


def contexts(data: np.ndarray) -> np.ndarray:
    """Cytosine contexts by the rule of ``dna.context``, for texts with two other bytes between them."""
    c, g = np.zeros(len(data) + 4, bool), np.zeros(len(data) + 4, bool)
    c[2:-2], g[2:-2] = data == ord("C"), data == ord("G")
    out = np.full(len(data), 3, np.uint8)
    forward, back = np.where(g[3:-1], 0, np.where(g[4:], 1, 2)), np.where(c[1:-3], 0, np.where(c[:-4], 1, 2))
    np.copyto(out, forward, where=c[2:-2], casting="unsafe")
    np.copyto(out, back, where=g[2:-2], casting="unsafe")
    return out


def numbers(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the k-mer at each place in base 4 (k up to 31), and whether it holds only A, C, G and T; the last places have none."""
    n = max(len(data) - k + 1, 0)
    base = _CODE[data]
    bad = np.concatenate([[0], np.cumsum(base > 3, dtype=np.int32)])
    power, done, value, have = (base & 3).astype(np.uint64), 1, None, 0  # k-mers of doubling length, joined by the binary digits of k
    rest = k
    while rest:
        if rest & 1:
            value, have = (power[:n], done) if value is None else ((value << np.uint64(2 * done)) | power[have : have + n], have + done)
        rest >>= 1
        if rest:
            power, done = (power[:-done] << np.uint64(2 * done)) | power[done:], 2 * done
    return (value if n else np.empty(0, np.uint64)), (bad[k:] == bad[:-k])[:n] if n else np.empty(0, bool)


def spelled(codes: np.ndarray, k: int) -> pa.Array:
    """The k-mers of numbers."""
    shifts = np.arange(2 * (k - 1), -1, -2, dtype=np.uint64)
    return texts(np.frombuffer(b"ACGT", np.uint8)[((codes.astype(np.uint64)[:, None] >> shifts) & np.uint64(3)).astype(np.intp)])
