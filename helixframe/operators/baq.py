"""Base alignment quality: how likely each base is aligned where its record says.

A banded pair hidden Markov model aligns the read inside the reference around it, its ends free; the
posterior of the recorded place of each base caps the base's quality.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import cigar as cigar_functions

#: Fixed values of the model: gap opening and extension, band, emission of a wrong base and of an inserted base.
OPEN, EXTEND, BAND, WRONG, INSERTED = 0.001, 0.1, 7, 1 / 3, 0.25
MATCH, INSERT = 0, 1


def posteriors(ref: np.ndarray, read: np.ndarray, quals: np.ndarray, band: int, gap_open: float = OPEN, gap_extend: float = EXTEND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each base of the read: the likeliest place in ``ref``, whether as match or insertion, and the quality of that."""
    n, width = len(read), len(ref)
    band = max(min(band, max(n, width)), abs(width - n))
    stop = 1 / (2 * n + 2)
    go = 1 - stop
    to_m = np.array([(1 - 2 * gap_open) * go, (1 - gap_extend) * go, 1 - gap_extend])  # from match, insertion, deletion
    to_i = np.array([gap_open * go, gap_extend * go])
    to_d = (gap_open * go, gap_extend)
    wrong = 10 ** (-quals / 10)
    same = (read[:, None] == ref[None, :])
    unclear = (read[:, None] > 3) | (ref[None, :] > 3)
    emit = np.where(unclear, 1.0, np.where(same, 1 - wrong[:, None], wrong[:, None] * WRONG))
    place = np.arange(width)
    inside = np.abs(place[None, :] - np.arange(n)[:, None]) <= band

    def deletions(start: np.ndarray, backward: bool = False) -> np.ndarray:
        """Sums of ``start`` carried on from place to place with the extension's probability."""
        out, carry = np.zeros(width), 0.0
        for k in range(width - 1, -1, -1) if backward else range(width):
            carry = start[k] + to_d[1] * carry
            out[k] = carry
        return out

    shifted = lambda x: np.concatenate([[0.0], x[:-1]])
    ahead = lambda x: np.concatenate([x[1:], [0.0]])
    f = np.zeros((n, 3, width))
    scale = np.zeros(n)
    f[0, 0] = emit[0] * (1 - gap_open) / width * inside[0]
    f[0, 1] = INSERTED * gap_open / width * inside[0]
    scale[0] = f[0].sum()
    f[0] /= scale[0]
    for i in range(1, n):
        m, ins, gone = f[i - 1]
        f[i, 0] = emit[i] * shifted(to_m[0] * m + to_m[1] * ins + to_m[2] * gone) * inside[i]
        f[i, 1] = INSERTED * (to_i[0] * m + to_i[1] * ins) * inside[i]
        f[i, 2] = deletions(to_d[0] * shifted(f[i, 0]) * inside[i]) * inside[i]
        scale[i] = f[i].sum()
        f[i] /= scale[i]
    b = np.zeros((n, 2, width))
    b[n - 1] = stop
    after = b[n - 1] * inside[n - 1]
    for i in range(n - 2, -1, -1):
        onward = ahead(emit[i + 1] * after[0])  # a match of the next base one place on
        held = INSERTED * after[1]
        gone = deletions(to_m[2] * onward * inside[i], backward=True)
        b[i, 0] = to_m[0] * onward + to_i[0] * held + to_d[0] * ahead(gone)
        b[i, 1] = to_m[1] * onward + to_i[1] * held
        b[i] *= inside[i]
        after = b[i] = b[i] / b[i].max()
    post = f[:, :2] * b
    flat = post.reshape(n, -1)
    best = flat.argmax(axis=1)
    share = flat[np.arange(n), best] / flat.sum(axis=1)
    quality = np.minimum(np.floor(-4.343 * np.log(np.maximum(1 - share, 1e-300)) + 0.499), 99)
    return best % width, best // width, np.where(share >= 1, 99, quality).astype(int)


_CODE = {c: i for i, c in enumerate("ACGT")}


def _codes(text: str) -> np.ndarray:
    return np.array([_CODE.get(c, 4) for c in text.upper()], int)


def capped(seq: str, quals: np.ndarray, cigar: str, pos: int, contig: str, extend: bool = False) -> np.ndarray | None:
    """Base alignment qualities of a record, None if it has a skip or no match.

    Plain ones are at most the base's quality; extended ones are lifted to the lesser of the best on
    either side within a block of matches.
    """
    ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    if any(o == "N" for _, o in ops) or not any(o in "M=X" for _, o in ops):
        return None
    x, y, blocks = pos, 0, []
    for n, o in ops:
        if o in "M=X":
            blocks.append((x, y, min(n, len(seq) - y)))
        x += n * (o in "MD=X")
        y += n * (o in "MIS=X")
    (x0, y0, _), (x1, y1, n1) = blocks[0], blocks[-1]
    drift = abs((x1 + n1 - x0) - (y1 + n1 - y0))
    band = BAND if drift <= BAND else drift + 3
    first = max(0, x0 - y0 - band // 2)
    last = min(len(contig), x1 + n1 + len(seq) - (y1 + n1) + band // 2)
    spare = last - first - len(seq) - band
    if spare > 0:
        first, last = first + spare // 2, last - spare // 2
    place, kind, quality = posteriors(_codes(contig[first:last]), _codes(seq), quals, band)
    out = np.array(quals) if not extend else np.zeros(len(seq), int)
    for x, y, n in blocks:
        here = np.arange(y, y + n)
        right = (kind[here] == MATCH) & (place[here] == x - first + np.arange(n))
        own = np.where(right, quality[here], 0)
        if extend:
            own = np.minimum(np.maximum.accumulate(own), np.maximum.accumulate(own[::-1])[::-1])
        out[here] = own if extend else np.minimum(np.array(quals)[here], own)
    return np.minimum(out, quals)


def realigned(records: DataFrame, contigs: DataFrame, extend: bool = False) -> DataFrame:
    """Records with ``qual`` capped by alignment and ``bq``, what that took from each base (offset 64), null where nothing was done."""

    @F.pandas_udf("qual string, bq string")
    def run(flag: pd.Series, seq: pd.Series, qual: pd.Series, cigar: pd.Series, pos: pd.Series, contig: pd.Series) -> pd.DataFrame:
        out = []
        for f, s, q, c, p, r in zip(flag, seq, qual, cigar, pos, contig):
            quals = None if q in (None, "*", "") or f & 4 or r is None else np.array([ord(x) - 33 for x in q])
            new = None if quals is None else capped(s, quals, c, p, r, extend)
            out.append((q, None) if new is None else ("".join(chr(x + 33) for x in new), "".join(chr(64 + a - b) for a, b in zip(quals, new))))
        return pd.DataFrame(out, columns=["qual", "bq"])

    names = contigs.select(F.col("name").alias("__name"), F.col("seq").alias("__contig"))
    # only the reference around a record goes to Python: as much beside it as it covers itself, which is more than any band
    room = F.coalesce(cigar_functions.reference_length(F.col("cigar")), F.lit(0)) + F.length("seq") + 200
    from_ = F.greatest(F.col("pos") - room, F.lit(0))
    here = F.substring("__contig", (from_ + 1).cast("int"), (F.col("pos") - from_ + 2 * room).cast("int"))
    both = records.join(names, records["rname"] == names["__name"], "left").withColumn("__from", from_).withColumn("__new", run("flag", "seq", "qual", "cigar", F.col("pos") - F.col("__from"), here)).drop("__from")
    return both.withColumn("qual", F.col("__new.qual")).withColumn("bq", F.col("__new.bq")).drop("__new", "__name", "__contig")


def restored(qual, bq):
    """The qualities before they were capped, as a column."""
    pairs = F.zip_with(F.filter(F.split(qual, ""), lambda c: c != ""), F.filter(F.split(bq, ""), lambda c: c != ""), lambda q, d: F.chr(F.ascii(q) + F.ascii(d) - 64))
    return F.when(bq.isNull(), qual).otherwise(F.array_join(pairs, ""))


def mapping_cap(seq: str, quals: list[int], cigar: str, pos: int, contig: str, threshold: int = 40) -> int:
    """The mapping quality that mismatches allow, -1 if they say too much against the place.

    Mismatches of quality 13 and more count with at most 33 each, against the ways to place as many
    among the compared and covered bases; clipped bases add a fifth of their quality.
    """
    x, y, compared, wrong, q, clipped = pos, 0, 0, 0, 0, 0
    for n, op in ((int(a), b) for a, b in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            for i in range(min(n, len(contig) - x)):
                a, b, quality = seq[y + i], contig[x + i].upper(), quals[y + i]
                if a in "ACGT" and b in "ACGT" and quality >= 13:
                    compared += 1
                    wrong, q = wrong + (a != b), q + (min(quality, 33) if a != b else 0)
            if x + n > len(contig):
                break
            compared += n
        elif op == "S":
            clipped += sum(quals[y : y + n])
        elif op == "H":
            clipped += 13 * n
        x += n * (op in "MDN=X")
        y += n * (op in "MIS=X")
    ways = wrong * math.log(compared) - math.lgamma(wrong + 1) if wrong else 0.0
    against = q - 4.343 * ways + clipped / 5
    if against > threshold:
        return -1
    return int(math.sqrt((threshold - max(against, 0)) / threshold) * threshold + 0.499)
