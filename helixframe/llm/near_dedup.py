"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its shingles of five words. The weight is the count times an inverse
document frequency that only shingles of more than a tenth of the documents lose by. Frequencies are
counted in a hashed table of fixed size; for shingles that may lose weight they are counted again, each
text as one by the number of texts alike (the size of its median bucket without weights), so that the
copies of a text do not count against each other. Each text takes one weighted sample for each hash; samples are banded, and texts of a band are
linked if their weighted Jaccard similarity, computed in full, reaches 0.8.

Of a bucket no pairs are listed. Its members are compared with one leader, the member whose own buckets
are largest, and linked texts become components. Members outside of the leader's component are then
compared with a few drawn members, those that share most samples, so that components that touch become
one early. What is left is joined exactly, each text once and not bucket by bucket: two texts of that
similarity share a shingle among the rarest of both (a prefix that leaves less weight than their overlap
needs), at places behind which enough weight is left, and their total weights are alike. Texts that are
linked to their leader take part only where the triangle inequality lets another member of their bucket
come near. Equal texts are one text throughout.
"""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import fresh, lean, released, written
from helixframe.llm.components import connected

SIMILARITY, SHINGLE = 0.8, 5
#: Bands and rows: a pair at 0.8 shares a band with probability 1 - (1 - 0.8 ** 2) ** 10 = 0.99996.
BANDS, ROWS = 10, 2
#: Bits of the table of document frequencies, and its parts as they travel.
BITS, PARTS = 18, 16
#: Characters and texts that a task takes at a time (a longer text alone).
CHARS, TEXTS = 400_000, 4096
#: Shares of a leader's members, members that are drawn of a bucket, those of them that a member meets, and the ratio between classes of total weight.
SALTS, DRAWN, MET, STEP = 64, 48, 6, 1.1

#: Characters that are neither ASCII nor part of a word.
NO_WORD = re.compile(r"[^\w\x00-\x7f]+")
_U = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


class Shingler:
    """Hashes of texts' different shingles (52 bits, above 12 empty ones) and their counts.

    Words are runs of letters, digits and underscores in lower case; their hashes are differences of
    polynomial prefix sums over the bytes of all texts at a time.
    """

    _byte = np.random.default_rng(5).integers(0, 2**64, 256, _U)
    _inside = np.array([c >= 128 or chr(c).isalnum() or c == 95 for c in range(256)])
    _base = 0x9E3779B97F4A7C15
    _up = _down = np.zeros(0, _U)

    def __init__(self, words: int = SHINGLE):
        self.words = words

    @classmethod
    def _powers(cls, n: int) -> None:
        if len(cls._up) < n:
            n = max(n, CHARS + TEXTS)
            cls._up, cls._down = (np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, x, _U)])) for x in (_U(cls._base), _U(pow(cls._base, -1, 2**64))))

    def _summed(self, h: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(h) - k + 1, _U)
        for i in range(k):
            out += h[i : len(h) - k + 1 + i] * _FACTORS[i % len(_FACTORS)] + _U(i)
        return out

    def _hashed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, and how many each text has."""
        raw = [(t if t.isascii() else NO_WORD.sub(" ", t)).encode() for t in map(str.lower, texts)]
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        del raw
        edges = np.flatnonzero(np.diff(self._inside[data].view(np.int8))) + 1
        first, end = edges[::2], edges[1::2]
        self._powers(len(data))
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(self._byte[data] * self._up[: len(data)], out=sums[1:])
        h = _mixed((sums[end] - sums[first]) * self._down[first])
        return h, np.diff(np.searchsorted(first, np.concatenate([[0], np.cumsum(sizes) + 1])))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of up to 4096 texts: hashes by text and size, counts, and where each text begins (and the end)."""
        h, sizes = self._hashed(texts)
        k, ends = self.words, np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts), dtype=_U), sizes)
        if len(h) >= k:
            inside = np.arange(len(h) - k + 1) + k <= np.repeat(ends, sizes)[: len(h) - k + 1]
            keys = [(_mixed(self._summed(h, k)[inside]) >> _U(12)) | (owner[: len(inside)][inside] << _U(52))]
        else:
            keys = [np.zeros(0, _U)]
        for i in np.flatnonzero((sizes > 0) & (sizes < k)).tolist():  # fewer words are one shingle
            one = self._summed(h[ends[i] - sizes[i] : ends[i]], int(sizes[i]))
            keys.append((_mixed(one) >> _U(12)) | _U(i << 52))
        key = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts, key = np.diff(np.append(first, len(key))), key[first]
        return key << _U(12), counts, np.searchsorted(key >> _U(52), np.arange(len(texts) + 1, dtype=_U))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.batch([text])[:2]


def _portions(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows, whose last item is the text, in lists of bounded size."""
    held, chars = [], 0
    for row in rows:
        if held and (chars + len(row[-1]) > CHARS or len(held) == TEXTS):
            yield held
            held, chars = [], 0
        held.append(row)
        chars += len(row[-1])
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch], once: bool = False) -> Iterator[tuple]:
    """The batches' rows; with ``once`` those whose first item did not come before in the batch."""
    for batch in batches:
        seen = set()
        for at in range(0, batch.num_rows, 512):  # few texts as Python strings at a time
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                if not once or row[0] not in seen:
                    seen.add(row[0])
                    yield row


def idf(counts: np.ndarray, n: int) -> np.ndarray:
    """1 up to a tenth of the documents, then falling with the logarithm."""
    return np.clip(np.log10(max(n, 1) / (counts + 1)), 0.05, 1).astype(np.float32)


def _frequencies(bits: int, parts: int, words: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shingles, n = np.zeros(1 << bits, np.int64), Shingler(words), 0
        for held in _portions(_rows(batches)):
            h, _, bounds = shingles.batch([t for (t,) in held])
            places = (h >> _U(64 - bits)) | (np.repeat(np.arange(len(held), dtype=_U), np.diff(bounds)) << _U(bits))
            places = places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places
            table += np.bincount((places & _U((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
            n += len(held)
        if n:
            pack = zstandard.ZstdCompressor(3).compress
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([n] * parts, pa.int64()), pa.array([pack(x.astype(np.uint32).tobytes()) for x in np.split(table, parts)], pa.binary())], names=["part", "n", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for part, n, counts in zip(*(c.to_pylist() for c in batch.columns)):
            own = sums.setdefault(part, [0, 0])
            own[0] += n
            own[1] = own[1] + np.frombuffer(unpack(counts), np.uint32).astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].tobytes() for x in sums.values()], pa.binary())], names=["part", "n", "counts"])


def _suspect(table, words: int):
    """Of texts that hold a shingle in a marked place of the table: key and the marked places."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, marked = Shingler(words), table.value
        bits = len(marked).bit_length() - 1
        for held in _portions(_rows(batches, once=True)):
            h, _, bounds = shingles.batch([t for _, t in held])
            places = (h >> _U(64 - bits)).astype(np.int32)
            seen = marked[places]
            keys, slots = [], []
            for (key, _), a, b in zip(held, bounds[:-1].tolist(), bounds[1:].tolist()):
                if seen[a:b].any():
                    keys.append(key)
                    slots.append(np.unique(places[a:b][seen[a:b]]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(slots, pa.list_(pa.int32()))], names=["key", "slots"])

    return run


def _shares(size: int):
    """Of ``slots, n``: a row for each place and task, the sum of 1 / n."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size)
        for batch in batches:
            lists = batch.column(0)
            share = np.repeat(1 / batch.column(1).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            table += np.bincount(lists.flatten().to_numpy(zero_copy_only=False), share, size)
        found = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(table[found])], names=["slot", "n"])

    return run


def frequencies(texts: DataFrame, words: int = SHINGLE, bits: int = BITS) -> np.ndarray:
    """In how many rows of ``texts`` (one column) each place of the table occurs; its size is fixed by ``bits``."""
    schema = "part int, n bigint, counts binary"
    rows = texts.mapInArrow(_frequencies(bits, PARTS, words), schema).repartition(PARTS, "part").mapInArrow(_summed, schema).orderBy("part").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]) if rows else np.zeros(1 << bits, np.int64)


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class Sampler:
    """Consistent weighted samples: for each hash the shingle and level of least value, as one number."""

    def __init__(self, hashes: int):
        g = _gamma_quantiles()
        self.r, self.log_c = g.astype(np.float32), np.log(g).astype(np.float32)
        self.b = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
        self.seeds = _mixed(np.arange(1, hashes + 1, dtype=_U) * _FACTORS[0])

    def __call__(self, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of texts whose shingles begin at ``starts`` (none is empty): an array of texts by hashes.

        A value and its shingle make one number: its order is that of the values, and it is the same
        in two texts only for the same shingle at the same level.
        """
        other = np.flatnonzero(weights != 1)
        log_w = np.log(weights[other])
        out = np.empty((len(starts), len(self.seeds)), _U)
        low = _U(0xFFFF)
        for k, seed in enumerate(self.seeds):
            x = (shingles ^ seed) * _FACTORS[4]
            x ^= x >> _U(29)
            x *= _FACTORS[5]
            r, b = self.r[x >> _U(48)], self.b[(x >> _U(32)) & low]
            above = 1 - b  # the level less b, and one; of weight 1 the level is 0
            if len(other):
                above[other] += np.floor(log_w / r[other] + b[other])
            value = (self.log_c[(x >> _U(16)) & low] - r * above).view(np.int32)
            value ^= (value >> 31) & 0x7FFFFFFF  # floats in the order of integers
            packed = (value.astype(np.int64) << 32) | (x & _U(0xFFFFFFFF)).view(np.int64)
            out[:, k] = np.minimum.reduceat(packed, starts).view(_U)
        return _mixed(out)


def _weights(table: np.ndarray, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    bits = len(table).bit_length() - 1
    return counts.astype(np.float32) * table[(shingles >> _U(64 - bits)).astype(np.int64)]


def _signatures(table, bands: int, rows: int, words: int, changed: bool = False):
    """Total weight, samples and buckets of each text with words; with ``changed`` only of texts that hold a weight below 1."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sampler = Shingler(words), Sampler(bands * rows)
        for held in _portions(_rows(batches, once=True)):
            h, counts, bounds = shingles.batch([t for _, t in held])
            if changed:
                below = np.concatenate([[0], np.cumsum(_weights(table.value, h, np.ones(len(h))) < 1)])
                some = np.flatnonzero(np.diff(below[bounds]))
                inside = np.repeat(np.diff(below[bounds]) > 0, np.diff(bounds))
                h, counts, size = h[inside], counts[inside], np.diff(bounds)[some]
                starts = np.cumsum(size) - size
            else:
                some = np.flatnonzero(np.diff(bounds))
                starts = bounds[some]
            if not len(some):
                continue
            weights = _weights(table.value, h, counts)
            s = sampler(h, weights, starts)
            buckets = np.zeros((len(some), bands), _U)
            for i in range(rows):
                buckets = _mixed(buckets * _FACTORS[2] + s[:, i::rows])
            buckets = _mixed(buckets + np.arange(1, bands + 1, dtype=_U) * _FACTORS[3])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(np.ascontiguousarray(buckets).reshape(-1).view(np.int64)))
            short = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands * rows), pa.array(np.ascontiguousarray(s >> _U(32)).astype(np.uint32).reshape(-1).view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in some.tolist()], pa.string()), pa.array(np.add.reduceat(weights.astype(float), starts)), short, lists], names=["key", "weight", "samples", "buckets"])

    return run


def similarity(table: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' shingles and counts."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = _weights(table, *a).astype(float), _weights(table, *b).astype(float)
    shared = np.minimum(wa[i], wb[j]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


def _verified(table, words: int, least: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, recent = Shingler(words), OrderedDict()

        def of(key: str, text: str):
            if key in recent:
                recent.move_to_end(key)
            else:
                recent[key] = shingles(text)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[key]

        def linked(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["a", "b", "similarity"])

        out: list[list] = [[], [], []]
        for a, b, x, y in _rows(batches):
            if (s := similarity(table.value, of(a, x), of(b, y))) >= least:
                for c, v in zip(out, (a, b, s)):
                    c.append(v)
            if len(out[0]) == 10_000:
                yield linked(out)
                out = [[], [], []]
        yield linked(out)

    return run


def _class_of(weight: float) -> int:
    return math.floor(math.log(weight) / math.log(STEP))


_PREFIX = "token bigint, class int, side int, id bigint, root bigint, w double, left double"


def _prefixes(table, order, words: int, t: float, asks: bool):
    """Rows of a text's rarest shingles: to ask with for texts of at most its weight, or to be found by texts of at least it.

    ``left`` is the weight of the shingle and all behind it. Side 0 holds pairs that ask for texts
    that are linked to their leader or not, side 1 the linked ones' questions for the others.
    """
    slack = 1e-9

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bits = Shingler(words), len(order.value).bit_length() - 1
        for held in _portions(_rows(batches)):
            h, counts, bounds = shingles.batch([r[-1] for r in held])
            weights = _weights(table.value, h, counts).astype(float)
            out: list[list] = [[] for _ in range(7)]
            for (key, root, apart, _), a, b in zip(held, bounds[:-1].tolist(), bounds[1:].tolist()):
                by = np.lexsort((h[a:b], order.value[(h[a:b] >> _U(64 - bits)).astype(np.int64)]))
                own = weights[a:b][by]
                w = own.sum()
                left = w - np.cumsum(own) + own
                enough = left >= (t if asks else 2 * t / (1 + t)) * w * (1 - slack)
                for token, rest in zip(h[a:b][by][enough].view(np.int64).tolist(), left[enough].tolist()):
                    if asks:
                        most = min(w, rest * (1 + t) / t - w) * (1 + slack)
                        rows = [(c, 0 if apart else 1) for c in range(_class_of(t * w * (1 - slack)), _class_of(most) + 1)] if most > 0 else []
                    else:
                        rows = [(_class_of(w), side) for side in ((0, 1) if apart else (0,))]
                    for c, side in rows:
                        for x, v in zip(out, (token, c, side, key, root, w, rest)):
                            x.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["token", "class", "side", "id", "root", "w", "left"])

    return run


def text_key(column: str = "text"):
    return F.md5(F.col(column).cast("binary"))


def _shared(signed: DataFrame) -> DataFrame:
    """``bucket, key, weight, n`` of buckets with ``n > 1`` members."""
    members = signed.select("key", "weight", F.explode("buckets").alias("bucket"))
    return written(members.join(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"), "members")


def _weighed(keyed: DataFrame, counts: np.ndarray, words: int, bands: int, rows: int) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """The table of weights, the signatures under them, and the members of shared buckets.

    Shingles of at most a tenth of the texts weigh 1, and the first signatures hold for texts of these
    alone. Where places of the table lie above, a text counts as one by the size of its median bucket,
    so that the copies of a text count about once.
    """
    spark, bits = keyed.sparkSession, len(counts).bit_length() - 1
    schema = "key string, weight double, samples array<int>, buckets array<bigint>"
    broadcast = spark.sparkContext.broadcast
    ones = broadcast(np.ones(1 << bits, np.float32))
    signed = written(keyed.mapInArrow(_signatures(ones, bands, rows, words), schema).dropDuplicates(["key"]), "signatures")
    members = _shared(signed)
    alike = members.groupBy("key").agg(F.sort_array(F.collect_list("n"), asc=False).alias("n"))  # at most one for each band
    alike = alike.select("key", F.get("n", F.lit((bands - 1) // 2)).alias("n")).where("n is not null")
    n = signed.count()
    fewer, copies = alike.agg(F.sum(1 / F.col("n")), F.count("*")).first()
    classes = n - copies + (fewer or 0)
    marked = idf(counts, classes) < 1
    if not marked.any():
        return ones.value, signed, members
    held = keyed.mapInArrow(_suspect(broadcast(marked), words), "key string, slots array<int>").dropDuplicates(["key"])
    told = held.join(alike, "key", "left").select("slots", F.coalesce("n", F.lit(1)).cast("double").alias("n"))
    again = told.mapInArrow(_shares(1 << bits), "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # at most the table's size
    counts = counts.astype(float)
    for r in again:
        counts[r["slot"]] = r["n"]
    weights = idf(counts, classes)
    if not (weights < 1).any():
        return weights, signed, members
    less = written(keyed.mapInArrow(_signatures(broadcast(weights), bands, rows, words, changed=True), schema).dropDuplicates(["key"]), "signatures")
    every = signed.join(less.select("key"), "key", "left_anti").unionByName(less)
    new = _shared(every)
    released(spark, members)
    return weights, every, new


def inverse_frequencies(texts: DataFrame, words: int = SHINGLE, bits: int = BITS, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The table of weights, from all rows of ``texts`` (one column)."""
    return _weighed(texts.select(text_key().alias("key"), "text"), frequencies(texts, words, bits), words, bands, rows)[0]


def links(docs: DataFrame, text_col: str = "text", similar: float = SIMILARITY, words: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, ``a, b, similarity`` by the texts' keys, and the components, ``node, root``.

    The links connect all that is linked; of texts that others connect already a link may be left out.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = texts.sparkSession
    counts = frequencies(texts, words, bits)
    keyed = texts.select(text_key().alias("key"), "text")
    weights, signed, members = _weighed(keyed, counts, words, bands, rows)
    table, order = spark.sparkContext.broadcast(weights), spark.sparkContext.broadcast(counts)  # 4 and 8 * 2 ** BITS bytes
    scratch = [signed, members]
    central = members.groupBy("key").agg(F.sum("n").alias("all"))
    order_of = F.struct("all", F.xxhash64("key").alias("h"), "key", "weight")
    leaders = members.join(central, "key").groupBy("bucket").agg(F.max(order_of).alias("x")).select("bucket", F.col("x.key").alias("leader"), F.col("x.weight").alias("heavy"))
    members = written(members.drop("n").join(leaders, "bucket"), "members")
    scratch.append(members)
    # a pair's similarity is at most the lesser weight by the greater
    alike = F.least("weight", "heavy") >= (2 * similar - 1) * F.greatest("weight", "heavy") * (1 - 1e-6)
    star = members.where((F.col("key") != F.col("leader")) & alike).select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()

    # only texts that share a bucket are ever read again; what they are joined with is written before, so that its size is known
    shared = written(members.select("key").distinct(), "shared")
    known = written(keyed.join(shared, "key", "left_semi").dropDuplicates(["key"]), "texts")
    scratch.extend((shared, known))

    def judged(pairs: DataFrame, least: float) -> DataFrame:
        """The pairs ``a, b`` of at least that similarity; an ``a`` may have many partners."""
        pairs = written(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))), "pairs")
        heads = written(pairs.select("a", "salt").distinct(), "heads")
        scratch.extend((pairs, heads))
        ones = known.select(F.col("key").alias("a"), F.col("text").alias("x")).join(heads, "a")
        full = known.select(F.col("key").alias("b"), F.col("text").alias("y")).join(pairs, "b").join(ones, ["a", "salt"])
        return written(full.select("a", "b", "x", "y").mapInArrow(_verified(table, words, least), "a string, b string, similarity double"), "verified")

    near = judged(star, 2 * similar - 1)
    first = near.where(F.col("similarity") >= similar)
    parts = connected(first)
    rooted = parts.withColumnRenamed("node", "key")
    told = members.join(near.select(F.col("a").alias("leader"), F.col("b").alias("key"), "similarity"), ["leader", "key"], "left").join(rooted, "key", "left").withColumn("root", F.coalesce("root", "key"))
    told = told.join(parts.select(F.col("node").alias("leader"), F.col("root").alias("lead")), "leader", "left").withColumn("lead", F.coalesce("lead", "leader"))
    led = F.col("key") == F.col("leader")
    told = written(told.select("bucket", "key", "root", "lead", led.alias("leads"), "similarity"), "placed")
    outside = F.col("root") != F.col("lead")

    # components of a bucket often touch: those outside are compared with drawn members that are most alike
    sizes = told.groupBy("bucket").agg(F.count("*").alias("n"), F.max(outside).alias("torn")).where("torn")
    drawn = F.pmod(F.xxhash64("bucket", "key"), F.col("n")) < DRAWN
    some = told.join(sizes, "bucket").select("bucket", "key", "root", outside.alias("out"), drawn.alias("drawn")).where("out or drawn")
    some = some.join(signed.select("key", "samples"), "key")
    shown = some.where("drawn").groupBy("bucket").agg(F.collect_list(F.struct("key", "root", "samples")).alias("drawn"))  # about DRAWN
    alike = lambda d: F.aggregate(F.zip_with("samples", d["samples"], lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    other = F.filter("drawn", lambda d: d["root"] != F.col("root"))
    met = some.where("out").drop("drawn").join(shown, "bucket").select("key", F.explode(F.slice(F.sort_array(F.transform(other, lambda d: F.struct(alike(d).alias("n"), d["key"].alias("key"))), asc=False), 1, MET)).alias("d"))
    met = met.where(F.col("d.n") >= bands * rows * similar * 0.8).select(F.greatest("key", "d.key").alias("a"), F.least("key", "d.key").alias("b")).distinct()
    touching = judged(met, similar)
    where = told.select("key", "root").distinct()
    between = touching.join(where.select(F.col("key").alias("a"), F.col("root").alias("x")), "a").join(where.select(F.col("key").alias("b"), F.col("root").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    moved = connected(between)
    told = told.join(moved.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")
    told = written(told.join(moved.select(F.col("node").alias("lead"), F.col("root").alias("new")), "lead", "left").withColumn("lead", F.coalesce("new", "lead")).drop("new"), "placed")

    torn = told.where(outside).groupBy("bucket").agg(F.max("similarity").alias("nearest"))
    direct = F.coalesce(F.col("similarity") >= similar, F.lit(False))
    # a member linked to the leader is near another only if that one is at 2 * similar - 1 to the leader
    asked = told.join(torn, "bucket").where(~F.col("leads") & (~direct | F.col("nearest").isNotNull())).groupBy("key", "root").agg((~F.min(direct)).alias("apart"))
    asked = written(asked.withColumn("id", F.xxhash64("key")), "remaining")
    asked = written(known.join(asked, "key"), "remaining")
    rare = lambda asks: asked.select("id", F.xxhash64("root").alias("root"), "apart", "text").mapInArrow(_prefixes(table, order, words, similar, asks), _PREFIX)
    found, asking = rare(False), rare(True).select("token", "class", "side", *(F.col(c).alias(f"{c}_b") for c in ("id", "root", "w", "left")))
    lighter = (F.col("w") < F.col("w_b")) | ((F.col("w") == F.col("w_b")) & (F.col("id") < F.col("id_b")))
    enough = F.least("left", "left_b") >= similar / (1 + similar) * (F.col("w") + F.col("w_b")) * (1 - 1e-9)
    pairs = found.join(asking, ["token", "class", "side"]).where((F.col("root") != F.col("root_b")) & lighter & enough).select("id", "id_b").distinct()
    pairs = pairs.join(asked.select("id", F.col("key").alias("a")), "id").join(asked.select(F.col("id").alias("id_b"), F.col("key").alias("b")), "id_b").select("a", "b")
    second = judged(pairs, similar)
    for done in (*scratch, told, asked):
        released(spark, done)
    more = touching.unionByName(second)
    if more.isEmpty():
        return first, parts
    every = first.unionByName(more)
    return every, connected(every)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, class_id, n_class, n_links``, a row for each row of ``docs``.

    A class holds equal texts and texts linked to each other, directly or through others; its id is
    the least document id in it. ``n_links`` counts the different texts that the row's text was compared
    with and linked to; texts that others connect already are not compared. Texts of fewer than five words are one shingle; texts without words have no links; null
    texts are empty. Null ids get a class (of id null if all its ids are); empty tables give no rows.
    """
    found, parts = links(docs, text_col, **options)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("doc_id", text_key().alias("key"))
    degree = found.select(F.col("a").alias("key")).unionByName(found.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("n_links"))
    about = parts.withColumnRenamed("node", "key").join(degree, "key", "left")
    rows = written(rows.join(about, "key", "left").select("doc_id", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    classes = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_class"))
    return rows.join(classes, "root").select("doc_id", "class_id", "n_class", "n_links")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that of the least id (null ids last), one of it if rows repeat.

    All columns are kept, whatever their names.
    """
    _, parts = links(docs, text_col, **options)
    key, other, own, times = fresh(docs, "key", "other", "id", "times")
    whole = docs.withColumn(key, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    ids = whole.select(F.col(key).alias("key"), F.col(id_col).alias("id")).groupBy("key", "id").agg(F.count("*").alias("n"))
    rooted = ids.join(parts.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")).alias("x"))
    kept = written(best.select(F.col("x.id").alias(own), F.col("x.key").alias(other), F.col("x.n").alias(times)), "kept")
    joined = whole.join(kept, (F.col(key) == F.col(other)) & F.col(id_col).eqNullSafe(F.col(own)))
    once = joined.where(F.col(times) > 1).dropDuplicates([key, own])
    return joined.where(F.col(times) == 1).unionByName(once).drop(key, other, own, times)
