"""Data sources in Python for formats that no line or separator frames: FASTQ and BAM, and their writers.

``register(spark)`` makes ``fastq`` and ``bam`` known to ``spark.read`` and ``df.write``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from helixframe.functions import dna
from helixframe.sources.files import listed, opened, ranges, uncompressed


class _Range(InputPartition):
    def __init__(self, uri: str, start: int, end: int):
        self.uri, self.start, self.end = uri, start, end


class FastqSource(DataSource):
    """``name, seq, qual, file, at``: ``at`` orders the records of a file. Plain files are read in byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "name string, seq string, qual string, file string, at bigint"

    def reader(self, schema) -> DataSourceReader:
        return _FastqReader(self.options)


class _FastqReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [_Range(*r) for r in ranges(self.options["path"], int(self.options.get("rangebytes", 32 << 20)))]

    def read(self, partition: _Range) -> Iterator[tuple]:
        gz = partition.uri.endswith((".gz", ".bgz"))
        with uncompressed(partition.uri) as file:
            at = 0 if gz else _first_record(file, partition.start)
            if not gz:
                file.seek(at)
            while gz or at < partition.end:
                four = [file.readline() for _ in range(4)]
                if not four[0].strip():
                    if not any(four):
                        return
                    raise ValueError(f"{partition.uri}: an empty line at byte {at}")
                name, seq, plus, qual = (x.rstrip(b"\r\n").decode() for x in four)
                if name[:1] != "@" or plus[:1] != "+" or len(seq) != len(qual):
                    raise ValueError(f"{partition.uri}: no record at byte {at}")
                yield name[1:], seq.upper(), qual, partition.uri, at
                at += sum(map(len, four))


def _first_record(file, start: int) -> int:
    """The place of the first record that starts at or behind ``start``: a line with @ whose third line has + and whose second and fourth are of one length."""
    if start == 0:
        return 0
    file.seek(start - 1)
    at = start - 1 + len(file.readline())
    window: list[tuple[int, bytes]] = []
    while True:
        line = file.readline()
        window.append((at, line.rstrip(b"\r\n")))
        at += len(line)
        if not line:
            return at
        if len(window) >= 4:
            a, b, c, d = (x[1] for x in window[-4:])
            if a[:1] == b"@" and c[:1] == b"+" and len(b) == len(d) and b[:1] not in (b"@", b"+"):
                return window[-4][0]


def fastq(spark: SparkSession, path: str, pbat: bool = False) -> DataFrame:
    """Single reads with ``rseq``, the reverse complement; with ``pbat`` the two change places."""
    rows = spark.read.format("fastq").load(path).withColumn("name", dna.read_name(F.col("name")))
    other = dna.reverse_complement(F.col("seq"))
    return rows.withColumn("rseq", F.col("seq") if pbat else other).withColumn("seq", other if pbat else F.col("seq"))


def fastq_pairs(spark: SparkSession, path1: str, path2: str, pbat: bool = False) -> DataFrame:
    """Mates joined by their ordinal: ``name, seq1, qual1, seq2, qual2``; the second mate is complemented. With ``pbat`` the files change places.

    Ordinals count records by file and place; each file's records are numbered by one window, which
    only places and names pass. Files of unequal length raise an error when they are joined.
    """
    from pyspark.sql import Window

    one, two = (path2, path1) if pbat else (path1, path2)
    sides = []
    for i, path in ((1, one), (2, two)):
        rows = spark.read.format("fastq").load(path)
        order = rows.select("file", "at").withColumn("__n", F.row_number().over(Window.orderBy("file", "at")))
        sides.append(rows.join(order, ["file", "at"]).select("__n", F.col("name").alias(f"name{i}"), F.col("seq").alias(f"seq{i}"), F.col("qual").alias(f"qual{i}")))
    both = sides[0].join(sides[1], "__n", "full")
    bad = F.col("name1").isNull() | F.col("name2").isNull()
    name = F.when(bad, F.raise_error(F.lit("the files hold different numbers of reads"))).otherwise(dna.mate_name(F.col("name1"), F.col("name2")))
    return both.select(name.alias("name"), "seq1", "qual1", dna.reverse_complement(F.col("seq2")).alias("seq2"), F.reverse("qual2").alias("qual2"))


#: Fixed values of the binary alignment format.
_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
_EMPTY_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_SCALARS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def blocks(data: bytes) -> Iterator[bytes]:
    """Data as gzip members that tell their own size, with the empty one at the end."""
    for i in range(0, len(data), 0xFF00):
        part = data[i : i + 0xFF00]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        yield struct.pack("<4BIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    yield _EMPTY_BLOCK


class _Stream:
    """The decompressed bytes of a file of members."""

    def __init__(self, file):
        self.file, self.buffer, self.packed = file, b"", b""

    def read(self, n: int) -> bytes:
        while len(self.buffer) < n:
            unpack = zlib.decompressobj(31)
            out = []
            while not unpack.eof:
                if not self.packed:
                    self.packed = self.file.read(1 << 20)
                    if not self.packed:
                        break
                out.append(unpack.decompress(self.packed))
                self.packed = unpack.unused_data if unpack.eof else b""
            if not out:
                break
            self.buffer += b"".join(out)
        out_, self.buffer = self.buffer[:n], self.buffer[n:]
        return out_


def _tags(raw: bytes) -> dict[str, tuple[str, str]]:
    out, i = {}, 0
    while i < len(raw):
        name, kind = raw[i : i + 2].decode(), chr(raw[i + 2])
        i += 3
        if kind == "A":
            out[name], i = ("A", chr(raw[i])), i + 1
        elif kind in _SCALARS:
            v = struct.unpack_from(_SCALARS[kind], raw, i)[0]
            out[name], i = (("f", f"{v:g}") if kind == "f" else ("i", str(v))), i + struct.calcsize(_SCALARS[kind])
        elif kind in "ZH":
            end = raw.index(0, i)
            out[name], i = (kind, raw[i:end].decode()), end + 1
        else:
            sub, n = chr(raw[i]), struct.unpack_from("<i", raw, i + 1)[0]
            step = struct.calcsize(_SCALARS[sub])
            values = [struct.unpack_from(_SCALARS[sub], raw, i + 5 + step * j)[0] for j in range(n)]
            out[name], i = ("B", ",".join([sub, *(f"{v:g}" if sub == "f" else str(v) for v in values)])), i + 5 + step * n
    return out


def _packed_tags(tags) -> bytes:
    out = []
    for name, field in sorted((tags or {}).items()):
        kind, value = field["type"], field["value"]
        if kind == "A":
            out.append(name.encode() + b"A" + value.encode()[:1])
        elif kind == "i":
            out.append(name.encode() + b"i" + struct.pack("<i", int(value)))
        elif kind == "f":
            out.append(name.encode() + b"f" + struct.pack("<f", float(value)))
        elif kind in "ZH":
            out.append(name.encode() + kind.encode() + value.encode() + b"\0")
        else:
            sub, *values = value.split(",")
            out.append(name.encode() + b"B" + sub.encode() + struct.pack("<i", len(values)) + b"".join(struct.pack(_SCALARS[sub], float(v) if sub == "f" else int(v)) for v in values))
    return b"".join(out)


SAM = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,struct<type:string,value:string>>"


def decoded(stream) -> Iterator[tuple]:
    """The records of a binary alignment stream."""
    if stream.read(4) != b"BAM\1":
        raise ValueError("no binary alignment file")
    stream.read(struct.unpack("<i", stream.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        names.append(stream.read(struct.unpack("<i", stream.read(4))[0])[:-1].decode())
        stream.read(4)
    while size := stream.read(4):
        raw = stream.read(struct.unpack("<i", size)[0])
        ref, pos, l_name, mapq, _, n_ops, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
        at = 32 + l_name
        ops = struct.unpack_from(f"<{n_ops}I", raw, at)
        at += 4 * n_ops
        packed = raw[at : at + (l_seq + 1) // 2]
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
        at += len(packed)
        qual = raw[at : at + l_seq]
        fields = {k: {"type": t, "value": v} for k, (t, v) in _tags(raw[at + l_seq :]).items()}
        here = names[ref] if ref >= 0 else "*"
        there = "*" if next_ref < 0 else "=" if next_ref == ref else names[next_ref]
        yield raw[32 : 31 + l_name].decode(), flag, here, pos, mapq, "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*", there, next_pos, tlen, seq or "*", "*" if not l_seq or qual[0] == 255 else "".join(chr(q + 33) for q in qual), fields


def _bin(beg: int, end: int) -> int:
    """The number of the smallest bin of the binning scheme that holds a range."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == end >> shift:
            return first + (beg >> shift)
    return 0


def encoded(row, refs: dict[str, int]) -> bytes:
    """A record in binary."""
    import re

    name = row["qname"].encode() + b"\0"
    ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"])]
    seq = "" if row["seq"] == "*" else row["seq"]
    span = sum(n for n, o in ops if o in "MDN=X") or 1
    code = [_BASES.find(c) if c in _BASES else 15 for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(code[i] << 4 | code[i + 1] for i in range(0, len(code), 2))
    qual = b"\xff" * len(seq) if row["qual"] == "*" else bytes(ord(c) - 33 for c in row["qual"])
    ref = refs.get(row["rname"], -1)
    there = ref if row["rnext"] == "=" else refs.get(row["rnext"], -1)
    body = struct.pack("<iiBBHHHiiii", ref, row["pos"], len(name), row["mapq"], _bin(max(row["pos"], 0), max(row["pos"], 0) + span), len(ops), row["flag"], len(seq), there, row["pnext"], row["tlen"]) + name + b"".join(struct.pack("<I", n << 4 | _OPS.index(o)) for n, o in ops) + packed + qual + _packed_tags(row["tags"])
    return struct.pack("<i", len(body)) + body


def header(contigs: list[tuple[str, int]], text: str) -> bytes:
    refs = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in contigs)
    return b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs)) + refs


class BamSource(DataSource):
    """Binary alignment files, one task for each. Writing takes ``contigs`` as ``name:length`` joined by commas and makes one file a partition."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SAM

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BamWriter(self.options)


class _BamReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [_Range(uri, 0, n) for uri, n in listed(self.options["path"])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with opened(partition.uri) as file:
            yield from decoded(_Stream(file))


class _BamWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.contigs = [(n, int(length)) for n, length in (c.rsplit(":", 1) for c in options["contigs"].split(",") if c)]

    def write(self, iterator) -> WriterCommitMessage:
        import os
        import uuid

        from helixframe.sources.writers import sam_header

        refs = {n: i for i, (n, _) in enumerate(self.contigs)}
        data = header(self.contigs, sam_header(self.contigs)) + b"".join(encoded(r, refs) for r in iterator)
        os.makedirs(self.path, exist_ok=True)
        name = f"{self.path}/_part-{uuid.uuid4().hex}.bam"
        with open(name, "wb") as file:
            file.writelines(blocks(data))
        return _Written(name)

    def commit(self, messages) -> None:
        import os

        for m in messages:
            if m:
                os.rename(m.name, m.name.replace("/_part-", "/part-"))

    def abort(self, messages) -> None:
        import contextlib
        import os

        for m in messages:
            if m:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(m.name)


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


def register(spark: SparkSession) -> None:
    for source in (FastqSource, BamSource):
        spark.dataSource.register(source)
