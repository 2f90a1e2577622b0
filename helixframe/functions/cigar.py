"""CIGAR strings, flags and optional fields as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations that consume the query and the reference.
QUERY, REFERENCE = "MIS=X", "MDN=X"
#: Names of the flag bits in order.
FLAGS = ("PAIRED", "PROPER_PAIR", "UNMAP", "MUNMAP", "REVERSE", "MREVERSE", "READ1", "READ2", "SECONDARY", "QCFAIL", "DUP", "SUPPLEMENTARY")
UNUSABLE = 0x4 | 0x100 | 0x200 | 0x400


def operations(cigar: Column) -> Column:
    """``array<struct<n, op>>``; empty for ``*``."""
    pairs = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=XB])"), F.lit(1))
    return F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, "^[0-9]+", 0).cast("int").alias("n"), F.substring(x, -1, 1).alias("op")))


def _length(cigar: Column, kinds: str) -> Column:
    return F.aggregate(operations(cigar), F.lit(0), lambda s, x: s + F.when(F.instr(F.lit(kinds), x["op"]) > 0, x["n"]).otherwise(0))


def query_length(cigar: Column) -> Column:
    return _length(cigar, QUERY)


def reference_length(cigar: Column) -> Column:
    return _length(cigar, REFERENCE)


def end_position(flag: Column, pos: Column, cigar: Column) -> Column:
    """Exclusive end; one past the start for unmapped records and those that cover no reference."""
    n = reference_length(cigar)
    return pos + F.when((flag.bitwiseAND(0x4) != 0) | (n == 0), 1).otherwise(n)


def projected(seq: Column, cigar: Column, gap: str = "N") -> Column:
    """A read on the reference axis: insertions and clips drop out, deletions and skips read as ``gap``."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        op, n = x["op"], x["n"]
        eats = F.instr(F.lit(QUERY), op) > 0
        here = F.when(op.isin("M", "=", "X"), F.substring(seq, s["at"], n)).when(op.isin("D", "N"), F.repeat(F.lit(gap), n)).otherwise("")
        return F.struct((s["at"] + F.when(eats, n).otherwise(0)).alias("at"), F.concat(s["out"], here).alias("out"))

    return F.aggregate(operations(cigar), start, step)["out"]


def columns(pos: Column, cigar: Column, seq: Column) -> Column:
    """What a read shows at each reference place that it covers.

    ``array<struct<pos, qpos, base, is_del, is_refskip, indel, is_head, is_tail>>``: in deletions and
    skips ``qpos`` is that of the next base; ``indel`` is the length of an insertion (positive) or
    deletion (negative) right behind the place.
    """
    ops = operations(cigar)
    shape = "struct<at:int,q:int,out:array<struct<pos:int,qpos:int,is_del:boolean,is_refskip:boolean,last:boolean>>>"
    start = F.struct(pos.cast("int").alias("at"), F.lit(0).alias("q"), F.array().cast("array<struct<pos:int,qpos:int,is_del:boolean,is_refskip:boolean,last:boolean>>").alias("out")).cast(shape)

    def step(s: Column, x: Column) -> Column:
        op, n = x["op"], x["n"]
        match, gone = op.isin("M", "=", "X"), op.isin("D", "N")
        made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((s["at"] + i).cast("int").alias("pos"), (s["q"] + F.when(match, i).otherwise(0)).cast("int").alias("qpos"), (gone).alias("is_del"), (op == "N").alias("is_refskip"), (i == n - 1).alias("last")))
        here = F.when((match | gone) & (n > 0), made).otherwise(F.array().cast("array<struct<pos:int,qpos:int,is_del:boolean,is_refskip:boolean,last:boolean>>"))
        return F.struct((s["at"] + F.when(match | gone, n).otherwise(0)).cast("int").alias("at"), (s["q"] + F.when(F.instr(F.lit(QUERY), op) > 0, n).otherwise(0)).cast("int").alias("q"), F.concat(s["out"], here).alias("out")).cast(shape)

    cover = F.aggregate(ops, start, step)["out"]
    first, last = pos, pos + reference_length(cigar) - 1
    # by the place of its last base, what stands behind an operation
    behind = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ops) - 1, F.lit(1))), lambda i: F.struct(F.aggregate(F.slice(ops, F.lit(1), i), F.lit(0), lambda s, x: s + F.when(F.instr(F.lit(REFERENCE), x["op"]) > 0, x["n"]).otherwise(0)).alias("covered"), F.get(ops, i).alias("next"), F.element_at(ops, i)["op"].alias("op")))
    marks = F.filter(behind, lambda b: F.instr(F.lit(REFERENCE), b["op"]) > 0)

    def shown(c: Column) -> Column:
        mark = F.filter(marks, lambda m: m["covered"] == c["pos"] - pos + 1)
        after = F.get(mark, F.lit(0))["next"]
        indel = F.when(c["last"] & (after["op"] == "I"), after["n"]).when(c["last"] & (after["op"] == "D"), -after["n"]).otherwise(0)
        return F.struct(c["pos"].alias("pos"), c["qpos"].alias("qpos"), F.when(~c["is_del"], F.substring(seq, c["qpos"] + 1, F.lit(1))).alias("base"), c["is_del"].alias("is_del"), c["is_refskip"].alias("is_refskip"), indel.alias("indel"), (c["pos"] == first).alias("is_head"), (c["pos"] == last).alias("is_tail"))

    return F.transform(cover, shown)


def inserted(seq: Column, qpos: Column, indel: Column) -> Column:
    """The bases inserted behind a column; empty without an insertion."""
    return F.when(indel > 0, F.substring(seq, qpos + 2, indel)).otherwise("")


def has(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(mask) != 0


def usable(flag: Column) -> Column:
    """Mapped, primary, not failed and not a duplicate."""
    return ~has(flag, UNUSABLE)


def flag_names(flag: Column) -> Column:
    """The names of the bits set, comma-joined."""
    names = [F.when(has(flag, 1 << i), n) for i, n in enumerate(FLAGS)]
    return F.concat_ws(",", *names)


def flag_value(names: Column) -> Column:
    """The flag of a comma-joined list of names, or of a decimal, octal or hexadecimal number; null if a name is unknown."""
    parts = F.split(F.upper(names), ",")
    known = F.create_map(*(F.lit(x) for i, n in enumerate(FLAGS) for x in (n, 1 << i)))
    by_name = F.aggregate(parts, F.lit(0), lambda s, n: s.bitwiseOR(F.try_element_at(known, n)))
    number = F.when(names.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(names, 3, 16), 16, 10)).when(names.rlike("^0[0-7]+$"), F.conv(names, 8, 10)).otherwise(names)
    return F.when(names.rlike("^[0-9]"), number.cast("int")).otherwise(by_name)


def tags(fields: Column) -> Column:
    """A map of optional fields ``TAG:TYPE:VALUE`` to ``struct<type, value>``."""
    good = F.filter(fields, lambda f: f.rlike("^[A-Za-z][A-Za-z0-9]:[AifZHB]:"))
    entries = F.transform(good, lambda f: F.struct(F.substring(f, 1, 2).alias("k"), F.struct(F.substring(f, 4, 1).alias("type"), F.substring(f, F.lit(6), F.length(f)).alias("value")).alias("v")))
    return F.map_from_entries(entries)


def tag(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def tag_int(field: Column) -> Column:
    return F.when(field["type"] == "i", field["value"].try_cast("bigint"))


def tag_float(field: Column) -> Column:
    return F.when(field["type"].isin("f", "i"), field["value"].try_cast("double"))


def tag_char(field: Column) -> Column:
    return F.when(field["type"] == "A", F.substring(field["value"], 1, 1))


def tag_string(field: Column) -> Column:
    return F.when(field["type"].isin("Z", "H"), field["value"])


def tag_array(field: Column) -> Column:
    """The numbers of an array field; integers keep their values as doubles."""
    return F.when(field["type"] == "B", F.transform(F.slice(F.split(field["value"], ","), 2, 1 << 30), lambda x: x.try_cast("double")))


def without_tag(fields: Column, name: str) -> Column:
    return F.map_filter(fields, lambda k, _: k != name)


def with_tag(fields: Column, name: str, kind: str, value: Column) -> Column:
    """The fields with one set: replaced, or added at the end."""
    new = F.create_map(F.lit(name), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value")))
    return F.map_concat(without_tag(fields, name), new)


def tag_text(fields: Column) -> Column:
    """The fields as text again, tab-joined, in the order of their names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"])), "\t")
