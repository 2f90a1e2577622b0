"""Byte-level BPE over a corpus by a global shuffle of distinct words.

Rows are packed into blocks. A block keeps, for every text, the positions as numbers of the block's
distinct pre-tokens; the distinct pre-tokens alone leave the block, dealt by a hash of the word, so
that a word meets its other occurrences in one task and is encoded there once. The ids return to the
block, where the texts are put together by position. What is shuffled are dictionaries, one row for a
block and a share of the words, so a word in every text costs one entry a block and no more.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import bucketed, lean, partitions, trim

#: Characters that a block holds (a single longer text is a block of its own).
BLOCK_CHARS = 4_000_000
#: Distinct words that a task remembers before it starts anew.
REMEMBERED = 300_000
#: Shares of the words, at most.
SHARES = 4096

BLOCKS = "block string, ids array<bigint>, ends binary, slots binary, share binary, words array<binary>"
CODES = "block string, share int, counts binary, codes binary"


def ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its id in each line. Its length is fixed by the vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Characters below U+0250 for which ``re``'s classes and the Unicode properties differ.
_ODD = re.compile("[^\x00-\x1b -\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞]")


def splitter(pattern: str):
    """A function that lists a text's pre-tokens.

    The general pattern needs ``regex``; texts of common characters take an equal pattern of ``re``.
    """
    import public_tokenizers
    import regex

    slow = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return slow
    fast = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
    odd = _ODD.search
    return lambda text: slow(text) if odd(text) else fast(text)


def _packed(a: np.ndarray) -> bytes:
    """Little-endian bytes in planes, compressed."""
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _unpacked(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _blocks(pattern: str, shares: int, block_chars: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task, n = splitter(pattern), TaskContext.get().partitionId(), 0
        ids: list = []
        ends: list[int] = []
        seq: list[np.ndarray] = []
        known: dict[str, int] = {}
        chars = 0

        def block() -> pa.RecordBatch:
            slots = np.concatenate(seq) if seq else np.zeros(0, np.uint32)
            order = np.argsort(-np.bincount(slots, minlength=len(known)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(known), np.uint32)
            rank[order] = np.arange(len(known), dtype=np.uint32)
            words = list(known)
            words = [words[i].encode() for i in order]
            share = np.fromiter((zlib.crc32(w) % shares for w in words), np.uint16, len(words))
            lists: list[list[bytes]] = [[] for _ in range(shares)]
            for w, s in zip(words, share.tolist()):
                lists[s].append(w)
            packer = zstandard.ZstdCompressor(3)
            packed = [packer.compress(np.array([len(w) for w in x], np.uint32).tobytes() + b"".join(x)) if x else None for x in lists]
            counted = [None if p is None else len(x).to_bytes(4, "little") + p for x, p in zip(lists, packed)]
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{n}"]), pa.array([ids], pa.list_(pa.int64())), pa.array([_packed(np.array(ends, np.uint64))]), pa.array([_packed(rank[slots])]), pa.array([_packed(share)]), pa.array([counted], pa.list_(pa.binary()))],
                names=["block", "ids", "ends", "slots", "share", "words"],
            )

        for batch in batches:
            for key, text in ((k, t) for i in range(0, batch.num_rows, 512) for k, t in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns))):
                if chars and chars + len(text) > block_chars:
                    yield block()
                    n, ids, ends, seq, known, chars = n + 1, [], [], [], {}, 0
                found = split(text)
                put = known.setdefault
                seq.append(np.fromiter((put(w, len(known)) for w in found), np.uint32, len(found)))
                ids.append(key)
                ends.append(len(found))
                chars += len(text) + 1
        if ids:
            yield block()

    return run


def _encoded(vocabulary):
    """Each word once: its ids. A word is a single piece, so the pattern here takes all of it."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        piece = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary.value, special_tokens={}).encode_ordinary
        known: dict[bytes, list[int]] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for block, share, packed in zip(*(c.to_pylist() for c in batch.columns)):
                k, raw = int.from_bytes(packed[:4], "little"), unpack.decompress(packed[4:])
                at = np.cumsum(np.frombuffer(raw, np.uint32, k)).tolist()
                body, start, counts, flat = raw[4 * k :], 0, [], []
                for end in at:
                    w = body[start:end]
                    start = end
                    if (code := known.get(w)) is None:
                        code = known[w] = piece(w.decode())
                    counts.append(len(code))
                    flat += code
                if len(known) > REMEMBERED:
                    known = {}
                for x, v in zip(out, (block, share, _packed(np.array(counts, np.uint32)), _packed(np.array(flat, np.uint32)))):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["block", "share", "counts", "codes"])

    return run


def _dictionary(share: np.ndarray, codes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of a block: the first place of each slot's ids (and one more), and the ids."""
    order = np.argsort(share, kind="stable")  # the slots of a share, in the order in which they were sent
    rows = sorted(zip(codes["share"].to_pylist(), codes["counts"].to_pylist(), codes["codes"].to_pylist()))
    counts = np.concatenate([np.zeros(0, np.uint32), *(_unpacked(c, np.uint32) for _, c, _ in rows)]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *(_unpacked(c, np.uint32) for _, _, c in rows)])
    if len(counts) != len(share):
        raise ValueError(f"{len(share)} words went out and {len(counts)} came back")
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    size = np.empty(len(share), np.int64)
    size[order] = counts
    start = np.empty(len(share), np.int64)
    start[order] = first
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    where = np.repeat(start - at[:-1], size) + np.arange(at[-1])
    return at, flat[where]


def _texts(blocks: pa.Table, codes: pa.Table) -> Iterator[tuple[int | None, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a block's texts: the id, the slots by position, and the dictionary."""
    for row in blocks.to_pylist():
        at, flat = _dictionary(_unpacked(row["share"], np.uint16), codes)
        slots = _unpacked(row["slots"], np.uint32)
        start = 0
        for key, size in zip(row["ids"], _unpacked(row["ends"], np.uint64).tolist()):
            yield key, slots[start : start + size], at, flat
            start += size


def _ids(slots: np.ndarray, at: np.ndarray, flat: np.ndarray) -> np.ndarray:
    size = at[slots + 1] - at[slots]
    ends = np.cumsum(size)
    return flat[np.repeat(at[slots] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]



def _reassembled(_key, blocks: pa.Table, codes: pa.Table) -> pa.Table:
    rows = [(k, x := _ids(*r)) for k, *r in _texts(blocks, codes)]
    ends = np.array([0, *accumulate(len(x) for _, x in rows)], np.int32)
    values = np.concatenate([np.zeros(0, np.int32), *(x for _, x in rows)]).astype(np.int32)
    return pa.table({"doc_id": pa.array([k for k, _ in rows], pa.int64()), "n_tokens": pa.array(np.diff(ends).astype(np.int64)), "token_ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(values))})


def token_bytes(vocabulary: dict[bytes, int]) -> list[bytes]:
    """The token-byte table, by id; its size is the vocabulary's."""
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = token
    return out


def _digests(vocabulary):
    def run(_key, blocks: pa.Table, codes: pa.Table) -> pa.Table:
        table = token_bytes(vocabulary.value)
        decimal = [b" %d" % i for i in range(len(table))]
        out: list[list] = [[], [], [], []]
        said: list[bytes] | None = None
        for key, slots, at, flat in _texts(blocks, codes):
            if said is None:  # the decimal ids of each slot, put down once
                spelt = list(map(decimal.__getitem__, flat.tolist()))
                ends = at.tolist()
                said = [b"".join(spelt[a:b]) for a, b in zip(ends, ends[1:])]
                spelt = []
            joined = b"".join(map(said.__getitem__, slots.tolist()))[1:]
            ids = _ids(slots, at, flat)
            decoded = b"".join(map(table.__getitem__, ids.tolist()))  # the join with the token-byte table
            for x, v in zip(out, (key, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest())):
                x.append(v)
        said = None
        trim()
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_tokens": pa.array(out[1], pa.int64()), "ids_sha256": pa.array(out[2], pa.string()), "decoded_sha256": pa.array(out[3], pa.string())})

    return run


def _encode(docs: DataFrame, path: str, finish, schema: str, id_col: str, text_col: str, pattern: str | None, block_chars: int) -> DataFrame:
    import public_tokenizers

    spark = docs.sparkSession
    shares = max(1, min(SHARES, partitions(spark)))
    vocabulary = spark.sparkContext.broadcast(ranks(path))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = bucketed(rows.mapInArrow(_blocks(pattern or public_tokenizers.PATTERN, shares, block_chars), BLOCKS), "bpe", "block", partitions(spark))
    words = blocks.select("block", F.posexplode("words").alias("share", "packed")).where("packed is not null")
    codes = words.repartition(shares, "share").mapInArrow(_encoded(vocabulary), CODES)
    return blocks.drop("words").groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(finish(vocabulary), schema)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_tokens, token_ids``: a row for each row of ``docs``.

    ``path`` is a rank file of a public tokenizer. Null texts are empty and give no ids; null and
    repeated ids pass through; an empty table gives an empty table; other columns are left aside.
    """
    return _encode(docs, path, lambda _: _reassembled, "doc_id bigint, n_tokens bigint, token_ids array<int>", id_col, text_col, pattern, block_chars)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``doc_id, decoded`` (binary): the bytes of each row's ids, by the token-byte table.

    Null lists decode to no bytes. An id outside the vocabulary raises an error.
    """
    vocabulary = encoded.sparkSession.sparkContext.broadcast(ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte = token_bytes(vocabulary.value).__getitem__
        for batch in batches:
            lists = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(map(byte, x or ())) for x in lists], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col)).mapInArrow(run, "doc_id bigint, decoded binary")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Encode, decode the ids, and return the digests of both: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The same cases as ``bpe_encode``: a null text is empty, has 0 tokens and the digests of nothing.
    """
    return _encode(docs, path, _digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col, None, block_chars)
