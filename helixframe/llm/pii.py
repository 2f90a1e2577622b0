"""Personal data replaced by keyed surrogates.

Detected entities (email, phone, IP address, card and social-security numbers, names after a title or
that begin with a common given name) get surrogates of the same type and format from a keyed permutation of the characters of each
alphabet; names come from lists by gender and script. All surrogates of the corpus are checked
against each other and against the real entities, and drawn again until they are distinct; equal
entities have equal surrogates everywhere, names part by part. A name found behind a title is replaced
wherever the text repeats it; the gender of a given name is that of its titles in the whole corpus.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import fresh, trim, written

#: The session's setting that holds the key, in hexadecimal.
KEY = "helixframe.pii.key"
#: Rounds of drawing again, after which an entity that still collides is an error.
ROUNDS = 20

DOMAIN = re.compile(r"@[\w-]+(?:\.[\w-]+)+")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![\w]|\.[0-9])")
_BEFORE, _BEHIND = r"(?<![\w.+-])", r"(?![\w]|[.,-][0-9])"
NUMBER = re.compile(
    _BEFORE
    + r"(?:(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})"
    + r"|(?P<card>[0-9]{13,19}|[0-9]{4}(?P<s>[ -])[0-9]{4}(?P=s)[0-9]{4}(?:(?P=s)[0-9]{1,4}){0,2}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"
    + r"|(?P<phone>(?:\+1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}(?:[ .-][0-9]{2,4}){2,4}))"
    + _BEHIND
)

# Titles by gender, and names to draw from by script and gender.
TITLES = {"f": "Mrs Ms Miss Mme Mlle Madame Frau Sra Srta Señora Doña Госпожа Κυρία", "m": "Mr Sir Monsieur Herr Señor Sr Don Господин Κύριος", "n": "Dr Prof"}
GIVEN = {
    "latin": {"f": "Alma Bella Clara Dora Elena Flora Greta Helga Irma Julia Karla Lena Mara Nora Olga Petra Rosa Sara Tessa Vera", "m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Nils Oskar Paul Ralf Simon Theo Victor"},
    "cyrillic": {"f": "Анна Вера Дарья Елена Зоя Ирина Лидия Мария Нина Ольга", "m": "Антон Борис Виктор Глеб Егор Иван Лев Максим Олег Павел"},
    "greek": {"f": "Άννα Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα", "m": "Ανδρέας Βασίλης Γιώργος Δημήτρης Κώστας Λευτέρης Μάριος Νίκος Πέτρος Στέλιος"},
}
FAMILY = {
    "latin": "Adler Bishop Carver Drake Ellis Foster Gardner Hale Ibsen Jarvis Keller Lambert Mercer Nolan Osborn Parker Quinn Rhodes Sutton Turner Vance Weaver York Zeller",
    "cyrillic": "Андреев Белов Волков Громов Демин Ершов Жуков Зимин Ильин Котов Лебедев Марков Носов Орлов Павлов Рыбин",
    "greek": "Αλεξίου Βλάχου Γεωργίου Δημητρίου Ευαγγέλου Ζήση Θεοδώρου Ιωάννου Κωστή Λάμπρου Μακρή Νικολάου",
}
ENDINGS = {"latin": "man son berg well ford more lin sen", "cyrillic": "ский енко ов ин", "greek": "ίδης άκης όπουλος ίου"}
_TITLE = {t: g for g, text in TITLES.items() for t in text.split()}
_NAME = r"[^\W\d_a-zа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)?"
PERSON = re.compile(rf"\b({'|'.join(sorted(_TITLE, key=len, reverse=True))})\b\.? ({_NAME})(?: ({_NAME}))?")

# Given names by which a person is known without a title, where another capitalised word follows.
COMMON = {
    "f": "Alice Amanda Amy Anna Barbara Betty Carol Carolyn Catherine Christine Cynthia Deborah Donna Dorothy Elizabeth Emily Emma Hannah Heather Helen Isabella Jane Janet Jennifer Jessica Joan Julia Karen Kathleen Katherine Laura Linda Lisa Lucia Margaret Maria Marie Martha Mary Melissa Michelle Nancy Nicole Olivia Pamela Patricia Rachel Rebecca Ruth Samantha Sandra Sarah Sharon Shirley Sofia Sophie Stephanie Susan Teresa Virginia",
    "m": "Aaron Adam Alexander Andrew Anthony Antonio Benjamin Brian Carlos Charles Christopher Daniel David Dennis Donald Douglas Edward Eric Frank Gary George Gregory Hans Henry Jack Jacob James Jason Jeffrey Jerry John Jonathan Jose Joseph Joshua Juan Justin Keith Kenneth Kevin Larry Lukas Luis Matthew Michael Miguel Nathan Nicholas Patrick Paul Peter Philip Pierre Raymond Richard Robert Roger Ronald Ryan Samuel Scott Stephen Steven Thomas Timothy Walter William",
}
_KNOWN = {n: g for g, text in COMMON.items() for n in text.split()}
FULL = re.compile(rf"\b({_NAME})\b (?=({_NAME}))")
WORDS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)?")

#: Alphabets within which characters are exchanged; letters and digits of other scripts stay within their kind and page of 256.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
_WHERE = {c: (text, i) for text in ALPHABETS for i, c in enumerate(text)}


@functools.lru_cache(maxsize=4096)
def _page(page: int, category: str) -> str:
    return "".join(c for c in map(chr, range(page << 8, (page + 1) << 8)) if unicodedata.category(c) == category and c.lower() == c)


def _place(c: str) -> tuple[str, int] | None:
    """The alphabet of a character and its place there; None for characters that stay as they are."""
    if (found := _WHERE.get(c)) or c.isascii():
        return found
    category = unicodedata.category(c)
    if category[0] != "L" and category != "Nd" or (i := _page(ord(c) >> 8, category).find(c)) < 0:
        return None
    return _page(ord(c) >> 8, category), i


def _drawn(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x00".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permuted(key: bytes, kind: str, text: str, attempt: int = 0) -> str:
    """A keyed permutation of the strings of this format: characters of an alphabet stay in it, others stay as they are.

    An unbalanced Feistel network over the mixed-radix numbers of the even and odd places.
    """
    known = [_place(c) for c in text]
    places = [i for i, at in enumerate(known) if at]
    form = "".join(at[0][0] if at else c for c, at in zip(text, known))
    halves = []
    for half in (places[::2], places[1::2]):
        value, radix = 0, 1
        for i in half:
            alphabet, n = known[i]
            value, radix = value * len(alphabet) + n, radix * len(alphabet)
        halves.append([half, value, radix])
    for r in range(8):
        to, of = halves[r % 2], halves[1 - r % 2]
        to[1] = (to[1] + _drawn(key, kind, form, attempt, r, of[1])) % to[2]
    out = list(text)
    for half, value, _ in halves:
        for i in reversed(half):
            alphabet = known[i][0]
            value, n = divmod(value, len(alphabet))
            out[i] = alphabet[n]
    return "".join(out)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _script(word: str) -> str:
    return next(("cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῾" else "latin" for c in word if c.isalpha()), "latin")


def _picked(key: bytes, kind: str, value: str, names: list[str], endings: list[str], attempt: int) -> str:
    """A drawn name of the list; each second attempt hangs one more drawn ending on it, so that few rounds make room for any number."""
    at, name = divmod(_drawn(key, kind, value, attempt), len(names))
    out = names[name]
    for _ in range(attempt // 2):
        at, e = divmod(at, len(endings))
        out += endings[e]
    return out


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of an entity in canonical form (lower case, digits only where the type is a number)."""
    if kind == "card":
        tail = value[-1]
        body = permuted(key, kind, value[:-1], attempt)
        if luhn(value):
            return next(body + c for c in "0123456789" if luhn(body + c))
        return body + permuted(key, "card end", tail, attempt + _drawn(key, body) % 97)
    if kind == "phone" and len(value) >= 10 and value[-7:-4] == "555" and attempt < ROUNDS // 2:  # numbers kept for fiction stay such
        moved = permuted(key, kind, value[-10:-7] + value[-4:], attempt)
        return value[:-10] + moved[:3] + "555" + moved[3:]
    if kind == "phone" and len(value) > 10 and attempt < ROUNDS // 2:
        return value[:-10] + permuted(key, kind, value[-10:], attempt)
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        for r in range(8):
            i = r % 4
            octets[i] = (octets[i] + _drawn(key, kind, attempt, r, *octets[:i], *octets[i + 1 :])) % 256
        return ".".join(map(str, octets))
    if kind == "email":
        local, _, domain = value.partition("@")
        host, dot, rest = domain.partition(".")
        reserved = domain.endswith(("example.com", "example.org", "example.net"))
        moved = permuted(key, kind, local, attempt)
        more = 0 if attempt < 2 and moved != local else 1 + attempt // 2  # short and unchanging names grow until they differ
        moved += "".join(ALPHABETS[1][_drawn(key, "more", value, attempt, i) % 26] for i in range(more))
        return moved + "@" + (permuted(key, "host", host) if reserved and rest.startswith("example.") else host if reserved else permuted(key, "host", host)) + dot + rest
    if kind.startswith("given"):
        _, gender, script = kind.split("-")
        names = (GIVEN[script]["f"] + " " + GIVEN[script]["m"] if gender == "n" else GIVEN[script][gender]).split()
        return _picked(key, kind, value, [x.lower() for x in names], ENDINGS[script].split(), attempt)
    if kind.startswith("family"):
        script = kind.split("-")[1]
        return _picked(key, kind, value, [x.lower() for x in FAMILY[script].split()], ENDINGS[script].split(), attempt)
    return permuted(key, kind, value, attempt)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of addresses: found by their domain, and from there to the left, so that the time stays linear."""
    done = 0
    for m in DOMAIN.finditer(text):
        a = m.start()
        while a > done and ((c := text[a - 1]).isalnum() or c in "_.+%-"):
            a -= 1
        if a < m.start():
            yield a, m.end()
            done = m.end()


def _words(text: str) -> Iterator[tuple[int, int, str]]:
    """Words that begin with a capital: whole, and the parts of joined ones."""
    for m in WORDS.finditer(text):
        if not (m[0][0].isupper() or any(c.isupper() for c in m[0])):
            continue
        yield *m.span(), m[0]
        cut = next((i for i, c in enumerate(m[0]) if c in "-'’"), 0)
        if cut:
            yield m.start(), m.start() + cut, m[0][:cut]
            yield m.start() + cut + 1, m.end(), m[0][cut + 1 :]


def _repeated(text: str, people: dict[str, dict[str, str]], found: set[int]) -> Iterator[tuple[int, int, str, str]]:
    """Other places of names that the text has behind titles; one that is both is a given name where a family name follows."""
    family, given = people["family"], people["given"]
    places = [(a, b, w.lower()) for a, b, w in _words(text) if w[0].isupper() and (w.lower() in family or w.lower() in given)]
    for i, (a, b, name) in enumerate(places):
        follows = i + 1 < len(places) and text[b : places[i + 1][0]] == " " and places[i + 1][2] in family
        kind = given.get(name) if name in given and (follows or name not in family) else family.get(name)
        if kind and a not in found:
            yield a, b, kind, name


def _group(kind: str) -> str:
    """The kind without a gender: within it entities and surrogates are told apart."""
    return re.sub("^given-[fmn]-", "given-", kind)


def detected(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, type and canonical form of the entities, in order and without overlap."""
    out: list[tuple[int, int, str, str]] = []
    if "@" in text:
        out += [(a, b, "email", text[a:b].lower()) for a, b in _emails(text)]
    for m in IP.finditer(text):
        out.append((*m.span(), "ip", ".".join(str(int(x)) for x in m[0].split("."))))
    for m in NUMBER.finditer(text):
        kind = "ssn" if m["ssn"] else "card" if m["card"] else "phone"
        out.append((*m.span(), kind, _digits(m[0])))
    people: dict[str, dict[str, str]] = {"family": {}, "given": {}}
    for m in PERSON.finditer(text):
        gender = _TITLE[m[1]]
        for part, g in (("given", 2), ("family", 3)) if m[3] else (("family", 2),):
            a, b = m.span(g)
            b -= 2 * text[a:b].endswith(("'s", "’s"))
            name = text[a:b].lower()
            kind = f"given-{gender}-{_script(name)}" if part == "given" else f"family-{_script(name)}"
            out.append((a, b, kind, name))
            people[part].setdefault(name, kind)
    for m in FULL.finditer(text):
        if (gender := _KNOWN.get(m[1])) and m[2] not in _TITLE:
            for part, g in (("given", 1), ("family", 2)):
                a, b = m.span(g)
                b -= 2 * text[a:b].endswith(("'s", "’s"))
                name = text[a:b].lower()
                kind = people[part].setdefault(name, f"given-{gender}-{_script(name)}" if part == "given" else f"family-{_script(name)}")
                if a not in {x[0] for x in out[-4:]}:
                    out.append((a, b, kind, name))
    if any(people.values()):
        out += _repeated(text, people, {x[0] for x in out})
    out.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str, str]] = []
    for x in out:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def rendered(found: str, kind: str, new: str) -> str:
    """The surrogate in the format of the place: its separators, its capitals."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(new)
        return "".join(next(digits, "") if "0" <= c <= "9" else c for c in found)
    if kind == "email":
        if len(new) == len(found):
            return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for n, c in zip(new, found))
        return new
    if kind.startswith(("given", "family")):
        return new.upper() if found.isupper() and len(found) > 1 else new[:1].upper() + new[1:]
    return new


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for kind, value in dict.fromkeys((k, v) for _, _, k, v in detected(text)):
                for x, v in zip(out, (key, kind, value)):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], names=["key", "kind", "value"])


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's setting holds; a session without one draws a key and keeps it there."""
    if not (text := spark.conf.get(KEY, None)):
        text = secrets.token_hex(32)
        spark.conf.set(KEY, text)
    return bytes.fromhex(text)


def surrogates(entities: DataFrame, key: bytes | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``kind, value, new`` for distinct (kind, value): no ``new`` of a kind, genders apart, occurs twice or is a real value of it."""
    from pyspark.sql.functions import pandas_udf

    key = key or session_key(entities.sparkSession)
    group = F.regexp_replace("kind", "^given-[fmn]-", "given-")

    @pandas_udf("string")
    def drawn(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, a) for k, v, a in zip(kind, value, attempt)], index=kind.index, dtype=object)

    real = written(entities.select("kind", "value").distinct(), "entities")
    done, open_ = None, real.withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        tried = open_.withColumn("new", drawn("kind", "value", "attempt"))
        if done is not None:
            tried = tried.withColumn("settled", F.lit(False)).unionByName(done.withColumn("settled", F.lit(True)))
        else:
            tried = tried.withColumn("settled", F.lit(False))
        tried = tried.withColumn("of", group)
        holder = tried.groupBy("of", "new").agg(F.min(F.struct((~F.col("settled")).alias("late"), "value")).alias("holder"))
        taken = real.select(group.alias("of"), F.col("value").alias("new"), F.lit(True).alias("real")).distinct()
        judged = written(tried.join(holder, ["of", "new"]).join(taken, ["of", "new"], "left").withColumn("good", F.col("settled") | (F.col("real").isNull() & (F.col("holder.value") == F.col("value")) & (F.col("new") != F.col("value")))).select("kind", "value", "attempt", "new", "good"), "surrogates")
        done = judged.where("good").drop("good")
        open_ = judged.where("not good").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return done.drop("attempt")
    raise ValueError(f"surrogates still collide after {rounds} rounds")


def replaced(docs: DataFrame, text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """``docs`` with its text's entities replaced, and ``n_replaced``; every other column as it was, whatever its name.

    Null texts stay null with 0 replacements; empty tables stay empty; a column of the name
    ``n_replaced`` is replaced. Equal entities get equal surrogates in all texts, and under equal keys
    in all tables; without a ``key`` the session's holds.
    """
    column = F.col(text_col)
    key = key or session_key(docs.sparkSession)
    mark, news, put_to = fresh(docs, "key", "new", "put")
    # whatever the patterns find holds an at sign, two digits, a title, or a known name before a capital
    known = rf"\b(?=\p{{Lu}}\p{{L}}+ \p{{Lu}})(?:{'|'.join(_KNOWN)}) "
    maybe = F.coalesce(column.contains("@") | column.rlike("[0-9][0-9.() -]*[0-9]") | column.rlike(rf"\b(?:{'|'.join(_TITLE)})\b\.? ") | column.rlike(known), F.lit(False))
    rest = docs.where(~maybe).withColumn("n_replaced", F.lit(0))
    keyed = docs.where(maybe).withColumn(mark, F.sha2(column.cast("binary"), 256))
    entities = written(keyed.select(mark, text_col).mapInArrow(_found, "key string, kind string, value string").distinct(), "found")
    group = F.regexp_replace("kind", "^given-[fmn]-", "given-")
    gender = F.regexp_extract("kind", "^given-([fm])-", 1)
    kinds = entities.select("kind", "value").distinct().groupBy(group.alias("of"), "value").agg(F.collect_set(F.nullif(gender, F.lit(""))).alias("genders"))
    one = F.when(F.size("genders") == 1, F.get("genders", F.lit(0))).otherwise("n")
    resolved = kinds.select(F.when(F.col("of").startswith("given-"), F.concat(F.lit("given-"), one, F.substring("of", 6, 100))).otherwise(F.col("of")).alias("kind"), "value")
    new = surrogates(resolved, key).select(group.alias("of"), "value", "new")
    said = entities.select("key", group.alias("of"), "value").distinct()
    maps = said.join(new, ["of", "value"]).groupBy("key").agg(F.collect_list(F.struct("of", "value", "new")).alias(news)).withColumnRenamed("key", mark)
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("text string, n int")
    def put(text: pd.Series, new: pd.Series) -> pd.DataFrame:
        out = []
        for t, pairs in zip(text, new):
            if pairs is None:
                out.append((t, 0))
                continue
            known = {(p["of"], p["value"]): p["new"] for p in pairs}
            parts, at, n = [], 0, 0
            for a, b, kind, value in detected(t):
                parts += [t[at:a], rendered(t[a:b], kind, known[_group(kind), value])]
                at, n = b, n + 1
            out.append(("".join([*parts, t[at:]]), n))
        trim()
        return pd.DataFrame(out, columns=["text", "n"])

    both = keyed.join(maps, mark, "left").withColumn(put_to, put(text_col, news))
    both = both.withColumn(text_col, F.col(f"{put_to}.text")).withColumn("n_replaced", F.col(f"{put_to}.n")).drop(put_to, news, mark)
    return both.unionByName(rest)
