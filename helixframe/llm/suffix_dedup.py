"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are compared only through ``threshold`` bytes, most significant digits first, and only as
long as their group has more than one member:

1. A window is reached through its anchor, the place in it where the hash of ``digit`` bytes is least
   (the last such place). Equal windows have equal anchors, so the first digit is the anchor's bytes.
   The windows that share an anchor place are consecutive and travel as one row.
2. Rows whose anchor bytes are unique drop out. If all bytes that a row's windows cover recur, all
   its windows recur. Other rows are cut into runs of ``run`` windows; their next digit is the bytes
   that the windows of the run have in common.
3. Of runs whose digit recurs, but not all their bytes, each window takes the whole depth.

A digit is a 64-bit hash and each key holds the digits before it, so a decision rests on 128 bits.
Groups are counted with partial sums and never gathered; a task holds one block of texts. Where rows of
a group are settled and others are not, one settled row of each kind goes on as a witness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import lean, partitions, released, written

THRESHOLD = 400
#: Bytes of the first digit, windows of a run, bytes of a block.
DIGIT, RUN, BLOCK_BYTES = 192, 16, 4_000_000
#: Largest groups whose rows are dealt over all partitions when they are joined.
HOT = 1_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_U = np.uint64


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of any range of a block's bytes: polynomial prefix sums modulo 2**64, then mixed."""

    _table = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
    _up = np.zeros(0, np.uint64)
    _down = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray):
        cls = Hashes
        if len(cls._up) <= len(data):
            n = max(len(data), BLOCK_BYTES) + 1
            cls._up, cls._down = _powers(n, _BASE), _powers(n, _U(pow(int(_BASE), -1, 2**64)))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(cls._table[data] * cls._up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * Hashes._down[start])

    def all(self, size: int) -> np.ndarray:
        """Of each range of ``size`` bytes."""
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * Hashes._down[:n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xA0761D6478BD642F)
    h ^= h >> _U(32)
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    n = len(keys)
    full = np.full(-(-n // width) * width, ~_U(0))
    full[:n] = keys
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


#: Low bits of an anchor's key: its place, so that the last of equals is least. Longer texts go by overlapping parts.
_PLACE = 22


def anchored(hashes: Hashes, starts: np.ndarray, ends: np.ndarray, threshold: int, digit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of windows that share an anchor: the anchor's digit, its place, and the first and last window."""
    width, part = threshold - digit + 1, 1 << _PLACE
    digits = hashes.all(digit) if len(hashes.sums) > digit else np.zeros(0, np.uint64)
    low = _U(part - 1)
    found: list[tuple[np.ndarray, ...]] = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        for first in range(a, b - threshold + 1, part - width):  # windows starting in [first, last)
            last = min(first + part - width, b - threshold + 1)
            own = digits[first : last + width - 1]
            keys = (own & ~low) | (low - np.arange(len(own), dtype=np.uint64))
            at = (low - (_least(keys, width) & low)).astype(np.int64) + first
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            found.append((at[new], new + first, np.concatenate([new[1:], [len(at)]]) + first - 1))
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    place, one, two = (np.concatenate(x) for x in zip(*found))
    return digits[place], place, one, two


BLOCKS = "block string, ids array<bigint>, sizes array<bigint>, data binary"
ROWS = "key bigint, full bigint, block string, place int, first int, last int"
RUNS = "key bigint, core bigint, full bigint, block string, first int, last int, each binary, weight int"


def _blocks(block_bytes: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, ids, data, held = TaskContext.get().partitionId(), 0, [], [], 0
        packer = zstandard.ZstdCompressor(3)

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{n}"]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in data]], pa.list_(pa.int64())), pa.array([packer.compress(b"".join(data))], pa.binary())], names=["block", "ids", "sizes", "data"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                if held and held + len(raw) > block_bytes:
                    yield block()
                    n, ids, data, held = n + 1, [], [], 0
                ids.append(key)
                data.append(raw)
                held += len(raw)
        if ids:
            yield block()

    return run


def _opened(sizes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    ends = np.cumsum(np.array(sizes, np.int64))
    return raw, ends - np.array(sizes, np.int64), ends


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _first_digit(threshold: int, digit: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw, starts, ends = _opened(row["sizes"], row["data"])
                hashes = Hashes(raw)
                key, place, first, last = anchored(hashes, starts, ends, threshold, digit)
                for i in range(0, len(key), 100_000):
                    s = slice(i, i + 100_000)
                    full = hashes.of(first[s], last[s] + threshold) if len(first) else first[s]
                    yield pa.RecordBatch.from_arrays([_signed(key[s]), _signed(full), pa.array([row["block"]] * len(key[s])), *(pa.array(x[s].astype(np.int32)) for x in (place, first, last))], names=["key", "full", "block", "place", "first", "last"])

    return run


def _next_digit(threshold: int, run_of: int):
    def run(_key, blocks: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            raw, _, _ = _opened(row["sizes"], row["data"])
            hashes = Hashes(raw)
            key = rows["key"].to_numpy()
            place, first, last = (rows[c].to_numpy().astype(np.int64) for c in ("place", "first", "last"))
            near, far = (place - last) // run_of, (place - first) // run_of  # runs are cut by the distance to the anchor, so that equal windows share them
            cuts = far - near + 1
            owner = np.repeat(np.arange(len(first)), cuts)
            step = far[owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
            end = place[owner] - step * run_of  # the last window that the run would have
            one, two = np.maximum(end - run_of + 1, first[owner]), np.minimum(end, last[owner])
            size = two - one + 1
            flat = np.repeat(one - (np.cumsum(size) - size), size) + np.arange(size.sum())
            each = hashes.of(flat, flat + threshold).tobytes()
            at = np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int32)
            out.append(pa.table([pa.array(key[owner]), _signed(hashes.of(end, end - run_of + 1 + threshold)), _signed(hashes.of(one, two + threshold)), pa.array([row["block"]] * len(one), pa.string()), pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(each)]), rows["weight"].take(pa.array(owner))], names=["key", "core", "full", "block", "first", "last", "each", "weight"]))
        return pa.concat_tables(out)

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the runs."""
    for batch in batches:
        key, block, first, each, weight = (batch.column(c) for c in ("key", "block", "first", "each", "weight"))
        size = np.array([len(x) // 8 for x in each.to_pylist()], np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        place = first.to_numpy().astype(np.int64)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        full = np.frombuffer(b"".join(each.to_pylist()), np.uint64)
        yield pa.RecordBatch.from_arrays([key.take(pa.array(owner)), _signed(full), block.take(pa.array(owner)), pa.array(place.astype(np.int32)), weight.take(pa.array(owner))], names=["key", "full", "block", "first", "weight"])


def _covered(raw: np.ndarray, first: np.ndarray, last: np.ndarray, threshold: int) -> np.ndarray:
    """Whether each byte lies in a repeated window."""
    depth = np.zeros(len(raw) + 1, np.int32)
    np.add.at(depth, first, 1)
    np.add.at(depth, last + threshold, -1)
    return np.cumsum(depth)[:-1] > 0


def _kept(threshold: int, texts: bool):
    def run(_key, blocks: pa.Table, spans: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for row in blocks.to_pylist():
            raw, starts, ends = _opened(row["sizes"], row["data"])
            gone = _covered(raw, spans["first"].to_numpy().astype(np.int64), spans["last"].to_numpy().astype(np.int64), threshold)
            for key, a, b in zip(row["ids"], starts.tolist(), ends.tolist()):
                own = gone[a:b]
                left = raw[a:b][~own].tobytes()
                runs = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(bool(len(own)) and bool(own[0]))
                for x, v in zip(out, (key, b - a, int(np.count_nonzero(own)), runs, left if texts else hashlib.sha256(left).hexdigest())):
                    x.append(v)
        return pa.table([pa.array(out[0], pa.int64()), *(pa.array(x, pa.int64()) for x in out[1:4]), pa.array(out[4], pa.binary() if texts else pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if texts else "kept_sha256"])

    return run


def _met(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row for each ``keys`` and its number of rows in ``size``.

    The rows of the ``HOT`` largest groups are dealt over all partitions by a salt, and these groups
    repeated for each salt; any other group holds at most one row in ``HOT``. No more than ``HOT``
    keys are broadcast, whatever the input.
    """
    deal = partitions(rows.sparkSession)
    hot = F.broadcast(groups.where(F.col(size) >= deal).orderBy(F.desc(size), *keys).limit(HOT).select(*keys, F.lit(deal).alias("deal")))
    dealt = F.col("deal").isNotNull()
    salted = rows.join(hot, keys, "left").withColumn("salt", F.when(dealt, F.pmod(F.xxhash64("block", "first"), "deal")).otherwise(F.lit(0))).drop("deal")
    repeated = groups.drop(size).join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(dealt, F.col("deal") - 1).otherwise(F.lit(0)).cast("bigint")))).drop("deal")
    return salted.join(repeated, [*keys, "salt"], how).drop("salt")


def _counted(rows: DataFrame, digit: str, tag: str) -> DataFrame:
    """``rows`` whose (key, digit) occurs more than once; ``whole``: so does all that the row covers; ``mixed``: not so for each row of that digit.

    The counts are written before rows meet them: they are read several times.
    """
    keys = list(dict.fromkeys(["key", digit]))
    groups = written(rows.groupBy(*keys, "full").agg(F.sum("weight").alias("n")), "groups")
    more = written(groups.groupBy(*keys).agg(F.sum("n").alias("all"), F.min("n").alias("least")).where("all > 1").select(*keys, "all", (F.col("least") == 1).alias("mixed")), "more")
    again = groups.where("n > 1").withColumn("again", F.lit(True))
    known = _met(_met(rows, more, keys, "all", "inner"), again, [*keys, "full"], "n", "left")
    out = written(known.withColumn("whole", F.coalesce("again", F.lit(False))).drop("again", "weight"), tag)
    for df in (groups, more):
        released(rows.sparkSession, df)
    return out


def _rest(counted: DataFrame, digit: str) -> DataFrame:
    """What the next digit decides, and of recurring rows beside it one witness each, which counts twice."""
    witness = counted.where("whole and mixed").dropDuplicates(list(dict.fromkeys(["key", digit, "full"])))
    return counted.where("not whole").withColumn("weight", F.lit(1)).unionByName(witness.withColumn("weight", F.lit(2)))


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, digit: int | None = None, run_of: int = RUN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans`` and ``kept`` (bytes) or its ``kept_sha256``.

    Removed is each byte in a string of ``threshold`` bytes that starts anywhere else too, judged on
    the input; matches do not cross texts. Null texts are empty; texts shorter than the threshold stay
    whole; null and repeated ids pass through, each row on its own; other columns are left aside.
    """
    digit, run_of = digit or min(DIGIT, max(1, threshold // 2)), min(run_of, threshold)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = written(rows.mapInArrow(_blocks(block_bytes), BLOCKS), "repeats")
    first = _counted(blocks.mapInArrow(_first_digit(threshold, digit), ROWS).withColumn("weight", F.lit(1)), "key", "first-digit")
    rest = _rest(first, "key").select("key", "block", "place", "first", "last", "weight")
    runs = blocks.groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(_next_digit(threshold, run_of), RUNS)
    second = _counted(runs, "core", "next-digit")
    windows = _rest(second, "core").mapInArrow(_windows, "key bigint, full bigint, block string, first int, weight int")
    several = written(windows.groupBy("key", "full").agg(F.sum("weight").alias("n")).where("n > 1"), "windows")
    repeated = _met(windows, several, ["key", "full"], "n", "inner")
    spans = (
        first.where("whole").select("block", "first", "last")
        .unionByName(second.where("whole").select("block", "first", "last"))
        .unionByName(repeated.select("block", "first", F.col("first").alias("last")))
    )
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, " + ("kept_sha256 string" if digest else "kept binary")
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_kept(threshold, not digest), schema)
