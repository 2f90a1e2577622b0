"""Suffix order of single texts, for sequences that fit a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suffix_array(text: bytes) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the compared length."""
    n = len(text)
    rank = np.frombuffer(text, np.uint8).astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while n > 1:
        second = np.full(n, -1, np.int64)
        second[: max(0, n - k)] = rank[k:]
        order = np.lexsort((second, rank))
        new = np.zeros(n, np.int64)
        step = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        new[order] = np.concatenate([[0], np.cumsum(step)])
        rank, k = new, 2 * k
        if rank.max() == n - 1:
            break
    return order


def transformed(text: bytes) -> tuple[bytes, int]:
    """The Burrows-Wheeler transform with its end left out, and the row where that would stand."""
    order = suffix_array(text)
    rows = np.concatenate([[len(text)], order])
    at = int(np.flatnonzero(rows == 0)[0])
    return bytes(text[i - 1] for i in rows if i), at


def inverted(last: bytes, at: int) -> bytes:
    """The text of a transform."""
    symbols = np.insert(np.frombuffer(last, np.uint8).astype(np.int64) + 1, at, 0)
    order = np.argsort(symbols, kind="stable")
    first = np.empty(len(symbols), np.int64)
    first[order] = np.arange(len(symbols))  # the row that begins with each row's last symbol
    row, out = 0, []
    for _ in range(len(last)):
        out.append(int(symbols[row]) - 1)
        row = first[row]
    return bytes(reversed(out))


def found(text: bytes, order: np.ndarray, pattern: bytes) -> tuple[int, int]:
    """The range of suffixes that begin with a pattern, by two binary searches."""
    low, high = 0, len(order)
    while low < high:
        mid = (low + high) // 2
        if text[order[mid] : order[mid] + len(pattern)] < pattern:
            low = mid + 1
        else:
            high = mid
    first, high = low, len(order)
    while low < high:
        mid = (low + high) // 2
        if text[order[mid] : order[mid] + len(pattern)] <= pattern:
            low = mid + 1
        else:
            high = mid
    return first, low


def proper(text: bytes, order: np.ndarray) -> bool:
    """Whether an array is the suffix array of a text."""
    if sorted(order.tolist()) != list(range(len(text))):
        return False
    return all(text[a:] < text[b:] for a, b in zip(order.tolist(), order.tolist()[1:]))


def suffixes(contigs: DataFrame) -> DataFrame:
    """``chrom_id, rank, site``: the suffix array of each contig."""

    @F.pandas_udf("array<int>")
    def run(seq: pd.Series) -> pd.Series:
        return pd.Series([suffix_array(s.encode()).tolist() for s in seq], index=seq.index)

    return contigs.select("chrom_id", F.posexplode(run("seq")).alias("rank", "site"))
