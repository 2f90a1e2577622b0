"""Benchmark decontamination by canonical templates, in DataFrame functions only.

Numbers, units and names become typed placeholders. Windows of canonical words are joined by hash with
those of the benchmark; the windows of a text that lie on one item in one alignment are put together,
and the values in their slots must map one to one, so that a question with other numbers or names is
found and chance matches of placeholders are not. Items with windows of more values than words are
looked up by their original words too; those that have no other window also hold if the whole item lies
in one alignment and has a literal word.

Texts are made canonical by a few passes of regular expressions over the whole string; values are read
in a second pass, and only of texts that match a window with slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import computed, fresh, written

#: Words of a window, the share of an item's windows that makes a text contaminated, and the fewest words of an item.
WINDOW, SHARE, FEWEST = 8, 0.8, 4
#: Benchmark windows that are broadcast at most; more are joined by a shuffle.
BROADCAST = 1_000_000

# Units that count as such behind a number.
UNITS = "mm cm m km inch inches foot feet ft yard yards mile miles g kg mg lb lbs pound pounds ounce ounces oz ton tons s sec second seconds minute minutes hour hours day days week weeks month months year years ml l liter liters litre litres gallon gallons degree degrees celsius fahrenheit kelvin dollar dollars cent cents euro euros percent mph kmh watt watts kw volt volts joule joules newton newtons".split()
#: Placeholders: characters for private use.
NUMBER, UNIT, NAME = "", "", ""

# the classes come first and the look behind after them, so that most places fail at once
_NUMBER = r"[0-9](?<![\p{L}\p{N}._-][0-9])[0-9]*(?:[.,:/][0-9]+)*"
_NAME = r"\p{Lu}(?<=[^\s.!?:]\s\p{Lu})\p{L}*"
_UNIT = rf"((?i:{'|'.join(sorted(UNITS, key=len, reverse=True))}))(?!\p{{L}})"
_VALUE = r"[0-9]+(?:[.,:/][0-9]+)*"


def _clean(text: Column) -> Column:
    """The text without private-use characters, and without the one capital whose small form is no single letter."""
    return F.translate(text, NUMBER + UNIT + NAME + "İ", "   I")


def _marked(text: Column, kept: bool) -> Column:
    """The text with placeholders instead of its values, or before them if these are ``kept``; both have the same words."""
    own, value = ("$0", _VALUE) if kept else ("", "")
    marked = F.regexp_replace(F.regexp_replace(_clean(text), _NUMBER, NUMBER + own), _NAME, NAME + own)
    units = F.regexp_replace(marked, rf"({NUMBER}{value}\s+){_UNIT}", f"$1{UNIT}$2" if kept else f"$1{UNIT}")
    return F.when(F.contains(marked, F.lit(NUMBER)), units).otherwise(marked)


def canonical(text: Column) -> Column:
    """The canonical words of a text; private-use characters of the text itself are blanks."""
    return F.array_remove(F.split(F.lower(_marked(text, False)), rf"[^\p{{L}}\p{{N}}{NUMBER}-{NAME}]+"), "")


def original(text: Column) -> Column:
    """The words of a text as they are, in lower case."""
    return F.array_remove(F.split(F.lower(_clean(text)), r"[^\p{L}\p{N}]+"), "")


def values(text: Column) -> Column:
    """For each canonical word its value (placeholder and original, lower case), null if it is literal."""
    words = F.regexp_extract_all(F.lower(_marked(text, True)), F.lit(rf"(?:{NUMBER}{_VALUE}|[\p{{L}}\p{{N}}{UNIT}{NAME}])+"), F.lit(0))
    return F.transform(words, lambda w: F.when(F.substring(w, 1, 1).isin(NUMBER, UNIT, NAME), w))


def _windows(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``at, h`` of each window of ``tokens``."""
    parts = computed(rows, hashes=F.transform("tokens", lambda t: F.xxhash64(t))).drop("tokens")
    each = F.transform(F.sequence(F.lit(1), F.size("hashes") - size + 1), lambda i: F.xxhash64(F.slice("hashes", i, size), F.lit(size)))
    return parts.where(F.size("hashes") >= size).select(*keys, F.posexplode(each).alias("at", "h"))


def _literal(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: ~F.substring(t, 1, 1).isin(NUMBER, UNIT, NAME)))


def benchmark_windows(benchmark: DataFrame, window: int, fewest: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``item_id, item_at, h, slots, size, light, whole, of`` of windows with a literal word, and the items.

    An item shorter than a window is one window. The first window also counts with its first word as
    a name, which a capital makes of it behind other text. Windows with at least half their words
    literal are ``light``; others count only for items that have no light one (``whole``).
    """
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item_id is not null")
    items = computed(items.groupBy("item_id").agg(F.min("text").alias("text")), tokens=canonical(F.col("text")))
    items = written(items.where(F.size("tokens") >= fewest).withColumn("size", F.least(F.size("tokens"), F.lit(window))), "items")
    capital = F.col("text").rlike(r"^[^\p{L}\p{N}]*\p{Lu}")
    named = items.where(capital).withColumn("tokens", F.concat(F.array(F.lit(NAME)), F.slice("tokens", F.lit(2), F.col("size") - 1)))
    parts = []
    for size in range(fewest, window + 1):
        for form in (items, named):
            own = form.where(F.col("size") == size).select("item_id", "tokens")
            slots = F.transform(F.sequence(F.lit(1), F.size("tokens") - size + 1), _slots(size))
            less = F.lit(int(form is named))  # the first word is literal in truth
            parts.append(_windows(own.withColumn("slots", slots), ["item_id", "slots"], size).select("item_id", F.col("at").alias("item_at"), "h", F.element_at("slots", F.col("at") + 1).alias("slots"), F.lit(size).alias("size")).withColumn("bare", F.col("slots") - F.when(F.col("item_at") == 0, less).otherwise(0) == size))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = written(every.withColumn("light", 2 * F.col("slots") <= F.col("size")), "windows")
    own = every.groupBy("item_id").agg(F.min("light").alias("all_light"), (~F.max("light")).alias("whole"))
    kept = every.join(own, "item_id").where(F.col("light") | (F.col("whole") & ~F.col("bare")))
    of = kept.groupBy("item_id").agg(F.countDistinct("item_at").alias("of"))
    heavy = own.where("not all_light").select("item_id", F.lit(True).alias("heavy"))
    items = items.join(heavy, "item_id", "left").select("item_id", "text", "size", _literal(F.col("tokens")).alias("literals"), F.coalesce("heavy", F.lit(False)).alias("heavy"))
    return kept.join(of, "item_id").drop("all_light", "light", "bare"), items


def _slots(size: int):
    """The slots of the window of ``size`` that begins at a place; a function of one argument, as a second one would be the index."""
    return lambda i: F.lit(size) - _literal(F.slice("tokens", i, size))


def original_windows(items: DataFrame, window: int) -> DataFrame:
    """``item_id, item_at, h, slots, size, whole, of``: windows of the original words of items with many values."""
    rows = computed(items.where("heavy").select("item_id", "text"), tokens=original(F.col("text"))).drop("text")
    rows = rows.withColumn("size", F.least(F.size("tokens"), F.lit(window)))
    parts = [_windows(rows.where(F.col("size") == size).select("item_id", "tokens"), ["item_id"], size).select("item_id", F.col("at").alias("item_at"), "h", F.lit(0).alias("slots"), F.lit(size).alias("size"), F.lit(False).alias("whole")) for size in range(1, window + 1)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.join(every.groupBy("item_id").agg(F.countDistinct("item_at").alias("of")), "item_id")


def _signs(text: Column) -> Column:
    """The text with placeholders and signs, without blanks."""
    return F.regexp_replace(F.lower(_marked(text, False)), r"\s+", "")


def _consistent(aligned: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """Alignments whose slots map one to one, with their number and whether a value differs."""
    texts = rows.join(aligned.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    both = aligned.join(computed(texts, there=values(F.col("text"))).select("text_hash", "there", _signs(F.col("text")).alias("signs_there")), "text_hash").join(computed(items, here=values(F.col("text"))).select("item_id", "here", "size", "literals", F.regexp_replace(_signs(F.col("text")), rf"^\p{{L}}+|[^\p{{L}}\p{{N}}{NUMBER}-{NAME}]+$", "").alias("signs")), "item_id")
    first = F.lower(F.regexp_extract(_clean(F.col("text")), r"\p{L}+", 0))
    both = both.join(items.select("item_id", F.concat(F.lit(NAME), first).alias("first")), "item_id")

    def pair(i: Column) -> Column:
        covered = F.col("whole") | F.exists("ats", lambda a: (a <= i) & (i < a + F.col("size")))
        mine, theirs = F.get("here", i), F.get("there", i + F.col("shift"))
        mine = F.when((i == 0) & mine.isNull() & theirs.startswith(NAME), F.col("first")).otherwise(mine)
        return F.when(covered & (mine.isNotNull() | theirs.isNotNull()), F.struct(mine.alias("i"), theirs.alias("d")))

    pairs = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(0), F.size("here") - 1), pair), lambda p: p.isNotNull()))
    judged = computed(both, slots=pairs)
    one = F.size(F.array_distinct(F.transform("slots", lambda p: p["i"])))
    two = F.size(F.array_distinct(F.transform("slots", lambda p: p["d"])))
    kind = lambda x: F.substring(x, 1, 1)
    begins = F.get("here", F.lit(0)).isNotNull() | F.coalesce(F.get("there", F.col("shift")) == F.col("first"), F.lit(True))
    said = (F.col("literals") > 1) | F.contains("signs_there", "signs")
    alike = ~F.col("whole") | (F.forall("slots", lambda p: kind(p["i"]).eqNullSafe(kind(p["d"]))) & begins & said)
    return judged.where((one == F.size("slots")) & (two == F.size("slots")) & alike).select("doc_id", "text_hash", "item_id", "shift", "of", "ats", F.size("slots").alias("n_slots"), F.exists("slots", lambda p: ~p["i"].eqNullSafe(p["d"])).alias("changed"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, fewest: int = FEWEST, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """``doc_id, text_hash, item_id, n_windows, of, n_slots, changed``: the benchmark items that texts hold.

    A text holds an item if consistent alignments cover ``share`` of its windows; ``changed`` tells
    that slots hold other values than the item's. Of items without a window that is half literal
    other values are found only if the whole item lies in one alignment (with the same signs if it has a
    single literal word), and none of those without any literal word: these hold by their original words. Null texts and items of fewer than ``fewest`` words
    hold and give nothing; repeated rows count once; null ids pass through; of repeated item ids the
    least text counts; empty tables give no rows.
    """
    known, items = benchmark_windows(benchmark, window, fewest)
    items = written(items, "items")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))

    def aligned(known: DataFrame, words) -> DataFrame:
        known = written(known, "benchmark")
        lengths = [r["size"] for r in known.select("size").distinct().orderBy("size").collect()]  # at most one for each window size
        few = known.count() <= broadcast
        rows = computed(texts, tokens=words(F.col("text"))).drop("text")
        found = None
        for size in lengths or [window]:
            own = known.where(F.col("size") == size).drop("size")
            part = _windows(rows, ["doc_id", "text_hash"], size).join(F.broadcast(own) if few else own, "h")
            found = part if found is None else found.unionByName(part)
        return found.groupBy("doc_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.max("of").alias("of"), F.collect_set("item_at").alias("ats"), F.max("slots").alias("most"), F.max("whole").alias("whole"))

    sets = written(aligned(known, canonical), "alignments")
    plain = sets.where("most = 0").drop("most", "whole").withColumn("n_slots", F.lit(0)).withColumn("changed", F.lit(False))
    slotted = sets.where("most > 0").drop("most")
    if not slotted.isEmpty():
        plain = plain.unionByName(_consistent(slotted, texts.drop("doc_id"), items))
    held = _held(plain, share)
    if not items.where("heavy").isEmpty():
        same = aligned(original_windows(items, window), original).drop("most", "whole").withColumn("n_slots", F.lit(0)).withColumn("changed", F.lit(False))
        same = _held(same, share)
        held = held.unionByName(same.join(held, ["doc_id", "text_hash", "item_id"], "left_anti"))
    return held


def _held(aligned: DataFrame, share: float) -> DataFrame:
    """The items of which alignments cover ``share`` of the windows."""
    held = aligned.groupBy("doc_id", "text_hash", "item_id").agg(F.max("of").alias("of"), F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).cast("bigint").alias("n_windows"), F.max("n_slots").alias("n_slots"), F.max("changed").alias("changed"))
    return held.where(F.col("n_windows") >= share * F.col("of")).select("doc_id", "text_hash", "item_id", "n_windows", "of", "n_slots", "changed")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; columns, whatever their names, and other rows as they were."""
    (mark,) = fresh(docs, "hash")
    held = matches(docs, benchmark, **options).select(F.col("text_hash").alias(mark)).distinct()
    return docs.withColumn(mark, F.xxhash64(options.get("text_col", "text"))).join(held, mark, "left_anti").drop(mark)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``matches`` without the hash of the text."""
    return matches(docs, benchmark, **options).drop("text_hash")
