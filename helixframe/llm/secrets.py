"""Secrets by patterns and by a linear-chain conditional random field.

The base patterns always hold. The field tags every token as outside, begin or inside of a secret, from
its shape, how unlike the corpus's words it is, the words beside it and features of the file, and is
decoded by Viterbi. It is trained here on windows of a bounded sample of texts: what the base patterns
find is a secret; statements with credentials of many drawn shapes, with and without an announcing
word, are put into other windows, as are look-alikes that are none; what looks like a credential and no
pattern knows stays out of training. Announcing words and known beginnings are hidden now and then, so
that neither is needed.

Tokens that are outside on any best path are told by their scores alone, for all texts of a batch at
once; Viterbi runs over the stretches between them, with the same result as over the whole text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field as made

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import lean

#: Texts that the field is trained on (as many again that hold an announcing word), windows of each, tokens of a window, rounds, penalty.
SAMPLE, WINDOWS, LENGTH, ROUNDS, PENALTY = 250, 4, 32, 120, 1e-3
#: Words of the sample that count as common, at most, and tokens that a task remembers.
COMMON, REMEMBERED = 20_000, 300_000
KINDS = ("assign", "access", "hex")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Tokens and the blanks between them: every character of a text is in one piece.
PIECE = re.compile(r"[A-Za-z0-9+/_.\-]+|[^\sA-Za-z0-9+/_.\-]+|\s+")
# Words that announce a credential, and beginnings that credentials have.
CUES = frozenset("password passwd pwd pass passphrase secret client_secret token access_token auth_token apikey api_key api-key key auth authorization bearer credential credentials private access login".split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "sk_", "sk-", "pk_", "rk_", "xox", "eyJ", "AIza", "glpat-", "npm_", "ya29.", "SG.")
CATEGORIES = ("cue", "sign", "quote", "at", "word", "other", "edge")
_EDGE = CATEGORIES.index("edge")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """Start, kind's place, end, and the start of the value, of each base match."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def pieces(text: str) -> list[tuple[int, int]]:
    """Start and end of each token."""
    return [m.span() for m in PIECE.finditer(text) if not m[0].isspace()]


def category(token: str) -> str:
    """What a token is to its neighbours."""
    return "cue" if token.lower().strip("._-") in CUES else "sign" if token[0] in "=:" else "quote" if token[0] in "\"'`" else "at" if token[0] == "@" else "word" if token[0].isalpha() else "other"


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CLASS = str.maketrans({chr(c): "l" if chr(c).islower() else "u" if chr(c).isupper() else "d" if chr(c).isdigit() else "p" for c in range(128)})
_HEXADECIMAL, _DOTTED, _PATH, _RUN = re.compile("[0-9a-f]+"), re.compile(r"[0-9.:/-]+"), re.compile(r"[a-z0-9_-]+(?:\.[a-z0-9_-]+)+|[^/]+/.*[^/]"), re.compile("d+")


@dataclass
class Look:
    """What the sample's words are like: common ones, and how unlikely a character is behind another, of which one is a letter."""

    common: frozenset[str] = frozenset()
    unlikely: dict[tuple[str, str], float] = made(default_factory=dict)

    @classmethod
    def of(cls, texts: list[str]) -> Look:
        words = Counter(w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower()))
        counts: Counter = Counter()
        for w in words:
            counts.update(zip(f" {w}", f"{w} "))
        signs = " " + _LETTERS
        total = {a: sum(counts[a, b] + 1 for b in signs) for a in signs}
        often = [w for w, n in words.most_common(COMMON) if n > 1]
        return cls(frozenset(often), {(a, b): -math.log((counts[a, b] + 1) / total[a]) for a in signs for b in signs if a + b != "  "})

    def shape(self, token: str) -> list[str]:
        """The names of a token's own features. Characters beyond ASCII are of no class of their own."""
        n = len(token)
        said = token.translate(_CLASS)
        digits = said.count("d")
        low = token.lower()
        out = [f"len{min(7, n.bit_length())}", "has" + "".join(k for k in "dulp" if k in said)]
        if low.strip("._-") in self.common:
            out.append("common")
        if digits == n:
            out.append(f"number{min(20, n)}")
        elif n >= 6:
            out.append(f"digits{4 * digits // n}")
            out.append(f"signs{len(set(token)).bit_length()}of{min(7, n.bit_length())}")
            plain = "".join(c if "a" <= c <= "z" else " " for c in low) if digits or "p" in said else low
            if pairs := [v for p in zip(f" {plain}", f"{plain} ") if (v := self.unlikely.get(p))]:
                out.append(f"odd{min(12, int(2 * sum(pairs) / len(pairs)))}")
            out.append(f"turns{min(3, said.count('lu'))}")
            out.append(f"mixed{min(3, len(_RUN.findall(said)))}")
            if _HEXADECIMAL.fullmatch(token):
                out.append("hexadecimal")
            if _DOTTED.fullmatch(token):
                out.append("dotted")
            if _PATH.fullmatch(token):
                out.append("path")
            if token.startswith(PREFIXES):
                out.append("prefix")
            if token.isupper():
                out.append("capitals")
        return out


def features(look: Look, text: str, tokens: list[tuple[int, int]], file: list[str]) -> list[list[str]]:
    """The names of each token's features."""
    said = [text[a:b] for a, b in tokens]
    kinds = [category(t) for t in said]
    out = []
    for i, token in enumerate(said):
        names = ["any", *look.shape(token), *file]
        names += [f"{d}:{kinds[i + d] if 0 <= i + d < len(kinds) else 'edge'}" for d in (-3, -2, -1, 1)]
        if i and tokens[i - 1][1] == tokens[i][0]:
            names.append("joined")
        if len(token) >= 8 and i > 1 and "cue" in kinds[max(0, i - 3) : i] and "sign" in kinds[max(0, i - 3) : i]:
            names.append("announced")
        out.append(names)
    return out


def file_features(text: str) -> list[str]:
    """What the text as a whole looks like."""
    signs = text.count("=") + text.count("{") + text.count(";")
    return [f"signs{min(3, (1000 * signs // max(1, len(text))).bit_length())}", "table" if text.count("|") * 50 > len(text) else "prose"]


class Field:
    """Weights of features by tag (outside, begin, inside) and of the steps between tags."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, step: np.ndarray, look: Look | None = None):
        self.names, self.unary, self.step, self.look = names, unary, step, look or Look()

    def weight(self, *names: str) -> np.ndarray:
        return self.unary[[i for n in names if (i := self.names.get(n)) is not None]].sum(axis=0) if len(self.names) else np.zeros(3)

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        return np.array([self.weight(*names) for names in rows]).reshape(-1, 3)

    def tags(self, rows: list[list[str]]) -> list[int]:
        """The best tags by Viterbi; inside never comes first or after outside."""
        return self.best(self.scores(rows))

    def best(self, scores: np.ndarray, first: bool = True, last: bool = True) -> list[int]:
        """The best tags under these scores; unless it is the text's ``first`` or ``last``, an outside token stands before or behind."""
        step = self.step.tolist()
        scores = scores.tolist()
        best, back = [scores[0][0], scores[0][1], -math.inf], []
        if not first:
            best = [best[0] + step[0][0], best[1] + step[0][1], -math.inf]
        for s in scores[1:]:
            came, new = [], []
            for t in range(3):
                v, f = max((best[f] + step[f][t], -f) for f in range(3))
                new.append(v + s[t])
                came.append(-f)
            best = new
            back.append(came)
        if not last:
            best = [v + step[t][0] for t, v in enumerate(best)]
        t = max(range(3), key=lambda x: (best[x], -x))
        out = [t]
        for came in reversed(back):
            t = came[t]
            out.append(t)
        return out[::-1]

    def open(self, s: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which tokens may be other than outside on a best path; ``first`` and ``last`` tell the ends of texts.

        Begin is ruled out where outside in its place, with begin for an inside token behind it, is
        better between any neighbours; inside likewise, and where no tag but outside is left before.
        """
        w = self.step
        behind = np.vstack([s[1:], np.zeros((1, 3))])
        shift = behind[:, 2] - behind[:, 1] + max(0.0, (w[2] - w[1]).max())
        out = []
        for tag, before in ((1, (0, 1, 2)), (2, (1, 2))):
            came = max([w[f, tag] - w[f, 0] for f in before] + [0.0] * (tag == 1))
            ends = max(0.0, *(w[tag, t] - w[0, t] for t in (0, 1)))
            goes = np.where(last, ends, np.maximum(ends, w[tag, 2] - w[0, 1] + shift))
            out.append(s[:, tag] - s[:, 0] + came + goes >= -1e-9)
        begin, inside = out
        may = begin | (inside & ~first)
        # within a run of such tokens, all from the first that may begin
        run = np.cumsum(~may | first)
        begun = np.cumsum(begin)
        at = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, int)
        base = (begun - begin)[at]
        return may & (begun - np.repeat(base, np.diff(np.append(at, len(run)))) > 0)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def trained(data: list[tuple[list[list[str]], list[int]]], look: Look | None = None, rounds: int = ROUNDS, penalty: float = PENALTY) -> Field:
    """Maximum likelihood by Adam over all segments at once, with forward and backward sums."""
    names = {n: i for i, n in enumerate(sorted({n for rows, _ in data for names in rows for n in names}))}
    allowed = np.zeros((3, 3))
    allowed[0, 2] = -1e4
    if not data:
        return Field(names, np.zeros((0, 3)), allowed, look or Look())
    b, length = len(data), max(len(t) for _, t in data)
    x = np.zeros((b, length, len(names)), np.float32)
    tags, mask = np.zeros((b, length), int), np.zeros((b, length), bool)
    for i, (rows, own) in enumerate(data):
        tags[i, : len(own)], mask[i, : len(own)] = own, True
        for j, row in enumerate(rows):
            x[i, j, [names[n] for n in row]] = 1
    flat = x[mask]
    gold = np.eye(3)[tags] * mask[..., None]
    both = (mask[:, 1:] & mask[:, :-1])[..., None, None]
    gold_steps = (gold[:, :-1, :, None] * gold[:, 1:, None, :] * both).sum(axis=(0, 1))
    unary, step = np.zeros((len(names), 3)), np.zeros((3, 3))
    moments = [[np.zeros_like(unary), np.zeros_like(unary)], [np.zeros_like(step), np.zeros_like(step)]]
    first = np.array([0, 0, -1e4])
    for r in range(1, rounds + 1):
        s = np.zeros((b, length, 3))
        s[mask] = flat @ unary
        w = step + allowed
        ahead, back = np.zeros((b, length, 3)), np.zeros((b, length, 3))
        ahead[:, 0] = s[:, 0] + first
        for t in range(1, length):
            ahead[:, t] = np.where(mask[:, t, None], s[:, t] + _log_sum(ahead[:, t - 1, :, None] + w, 1), ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            back[:, t] = np.where(mask[:, t + 1, None], _log_sum(w + (s[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
        total = _log_sum(ahead[:, -1], 1)
        p = np.exp(ahead + back - total[:, None, None]) * mask[..., None]
        steps = np.exp(ahead[:, :-1, :, None] + w + (s + back)[:, 1:, None, :] - total[:, None, None, None]) * both
        grads = [(flat.T @ (gold - p)[mask]) / b - penalty * unary, (gold_steps - steps.sum(axis=(0, 1))) / b - penalty * step]
        for value, grad, (m, v) in zip((unary, step), grads, moments):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            value += 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return Field(names, unary, step + allowed, look or Look())


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


class Drawn:
    """Statements that hold a credential, and some that hold none, with the words of the sample."""

    def __init__(self, rnd: random.Random, words: list[str]):
        self.rnd, self.words = rnd, words or ["word", "other", "several", "things"]

    def letters(self, n: int, alphabet: str = _ALNUM) -> str:
        return "".join(self.rnd.choices(alphabet, k=n))

    def value(self) -> str:
        rnd, n = self.rnd, self.rnd.randrange(10, 41)
        word = lambda: rnd.choice(self.words)
        return rnd.choice((
            lambda: self.letters(n),
            lambda: self.letters(n, _ALNUM[:52]),
            lambda: self.letters(n, _ALNUM[26:]),
            lambda: self.letters(n, _ALNUM[26:52]),
            lambda: self.letters(n, "0123456789abcdef"),
            lambda: self.letters(n, _ALNUM + "+/"),
            lambda: self.letters(n, _ALNUM + "_-"),
            lambda: "".join(word().capitalize() for _ in range(rnd.randrange(2, 5))) + self.letters(8, _ALNUM[:52])[: rnd.randrange(0, 3)],
            lambda: (word() + str(rnd.randrange(10))) * 2 + self.letters(2),
            lambda: word() + rnd.choice("_-.") + word() + str(rnd.randrange(10, 10000)),
            lambda: self.letters(6) + rnd.choice("!@#$%&*") + self.letters(6),
            lambda: "-".join(self.letters(k, "0123456789abcdef") for k in (8, 4, 4, 4, 12)),
        ))()

    def known(self) -> str:
        """A credential of a known form."""
        rnd, n = self.rnd, self.rnd.randrange(20, 41)
        return rnd.choice((
            lambda: rnd.choice(("ghp_", "gho_", "ghs_", "npm_")) + self.letters(36),
            lambda: rnd.choice(("sk_live_", "rk_live_", "sk_test_", "pk_live_")) + self.letters(24),
            lambda: "sk-" + self.letters(n),
            lambda: f"xox{rnd.choice('bpa')}-{rnd.randrange(10**10, 10**12)}-{self.letters(24)}",
            lambda: "AIza" + self.letters(35, _ALNUM + "_-"),
            lambda: "glpat-" + self.letters(20),
            lambda: f"eyJ{self.letters(n)}.eyJ{self.letters(n)}.{self.letters(n, _ALNUM + '_-')}",
            lambda: "ASIA" + self.letters(16, _ALNUM[:26] + "0123456789"),
            lambda: "github_pat_" + self.letters(n, _ALNUM + "_"),
        ))()

    def secret(self) -> tuple[str, str]:
        """What announces a credential, and the credential with what closes it."""
        rnd, case = self.rnd, self.rnd.choice((str, str, str.capitalize, str.upper))
        kind, quote = rnd.random(), rnd.choice(("", "", "", "\"", "'"))
        if kind < 0.45:
            cue = rnd.choice(("password", "pwd", "passwd", "pass", "passphrase", "secret", "client_secret", "token", "access_token", "auth_token", "key", "api key", "private key", "credential", "credentials", "login"))
            return case(cue) + rnd.choice((" = ", "=", ": ", ":", " := ", " => ", " is ")) + quote, self.value() + quote
        if kind < 0.6:
            return case(rnd.choice(("authorization: bearer ", "bearer ", "authorization: token "))) + quote, rnd.choice((self.value, self.known))() + quote
        if kind < 0.9:
            return rnd.choice(("", "use ", "with ", "key ", "export X=", "token ", self.rnd.choice(self.words) + " ")) + quote, self.known() + quote
        return rnd.choice(("use ", "with ", "")) + quote, self.letters(rnd.randrange(24, 41)) + quote

    def none(self) -> str:
        """What looks a little like a credential and is none."""
        rnd, word = self.rnd, lambda: self.rnd.choice(self.words)
        return rnd.choice((
            lambda: f"the {rnd.choice(('password', 'secret', 'token', 'key', 'credentials', 'access', 'bearer'))} {rnd.choice(('of', 'is', 'must', 'was', 'for'))} {word()} {word()}",
            lambda: f"{rnd.choice(('pwd', 'pass', 'key', 'credentials', 'login', 'auth', 'access', 'private'))}{rnd.choice((': ', ' = ', '='))}{word()} {word()}",
            lambda: f"{word()}: {word()} = {word()}",
            lambda: f"https://www.{word()}.com/{word()}/{word()}-{rnd.randrange(10**6)}.html",
            lambda: f"{word()}.{word()}@{word()}.org",
            lambda: f"{rnd.randrange(1900, 2100)}-{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 29):02d} {rnd.randrange(24)}:{rnd.randrange(60):02d}",
            lambda: f"+{rnd.randrange(1, 99)} ({rnd.randrange(100, 999)}) {rnd.randrange(100, 999)}-{rnd.randrange(1000, 9999)}",
            lambda: f"{rnd.randrange(10**15, 10**16)}",
            lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)),
            lambda: f"v{rnd.randrange(10)}.{rnd.randrange(20)}.{rnd.randrange(30)}",
            lambda: f"{word()}_{word()}_{word()}",
            lambda: f"/usr/{word()}/{word()}.{rnd.choice(('py', 'txt', 'cfg'))}",
            lambda: f"{word().upper()}_{word().upper()} = {rnd.randrange(1000)}",
            lambda: f"{word()}{word()}{word()}",
            lambda: f"{word().capitalize()}{word().capitalize()}",
            lambda: f"order {self.letters(2, _ALNUM[:26])}-{rnd.randrange(10**4, 10**8)}",
        ))()


def _suspicious(look: Look, token: str) -> bool:
    """Whether a token that no pattern knows may yet be a credential."""
    return len(token) >= 16 and (token.startswith(PREFIXES) or (any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and "path" not in look.shape(token)))


def _tagged(tokens: list[tuple[int, int]], values: list[tuple[int, int]]) -> list[int]:
    tags, last = [], None
    for a, b in tokens:
        inside = next((i for i, (v, end) in enumerate(values) if a < end and b > v), None)
        tags.append(0 if inside is None else 2 if tags and inside == last else 1)
        last = inside
    return tags


def examples(look: Look, texts: list[str], seed: int = 1) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Windows with features and tags: as they are, with a drawn credential, with a drawn look-alike."""
    rnd = random.Random(seed)
    words = sorted(w for w in look.common if w.isalpha() and 3 <= len(w) <= 12)[:5000]
    drawn = Drawn(rnd, words)
    for text in texts:
        places = pieces(text)
        if not places:
            places = [(0, 0)]
        base = base_spans(text)
        around = [next((i for i, (_, e) in enumerate(places) if e > v), 0) for _, _, _, v in base[:WINDOWS]]
        for at in [*around, *(rnd.randrange(len(places)) for _ in range(WINDOWS))]:
            first = max(0, at - rnd.randrange(LENGTH // 2))
            lo, hi = places[first][0], places[min(len(places), first + LENGTH) - 1][1]
            said, values = text[lo:hi], [(v - lo, e - lo) for _, _, e, v in base if v < hi and e > lo]
            form = rnd.random()
            if form < 0.75 and not values:
                cut = rnd.choice([m.start() for m in re.finditer(r"\s", said)] or [len(said)])
                if form < 0.45:
                    cue, value = drawn.secret()
                    said, start = f"{said[:cut]} {cue}{value}{said[cut:]}", cut + 1 + len(cue)
                    values = [(start, start + len(value.rstrip("\"'")))]
                else:
                    said = f"{said[:cut]} {drawn.none()} {said[cut:]}"
            tokens = pieces(said)
            tags = _tagged(tokens, values)
            if not tokens or any(not t and _suspicious(look, said[a:b]) for t, (a, b) in zip(tags, tokens)):
                continue
            rows = features(look, said, tokens, file_features(text))
            if rnd.random() < 0.25:
                hidden = rnd.choice(("cue", "prefix"))
                rows = [[n for n in r if not (n == "prefix" if hidden == "prefix" else n == "announced" or n.endswith(":cue"))] for r in rows] if any(tags) else rows
            yield rows[: 2 * LENGTH], tags[: 2 * LENGTH]


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field:
    """Train on at most ``sample`` different texts and as many with an announcing word, in the order of a hash of the text."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null").withColumn("h", F.xxhash64("text"))
    told = F.lower("text").rlike("password|passwd|secret|token|api_?key|akia|[0-9a-f]{32}")
    drawn = texts.select("h").distinct().orderBy("h").limit(sample).unionByName(texts.where(told).select("h").distinct().orderBy("h").limit(sample)).distinct()
    rows = texts.join(F.broadcast(drawn), "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()  # both have the sample's bound
    own = [r["text"] for r in rows]
    look = Look.of(own)
    return trained(list(examples(look, own)), look)


class _Known(dict):
    """Numbers of distinct pieces, and those that are new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        i = self[piece] = len(self)
        self.new.append(piece)
        return i


class Tagger:
    """The field's spans of many texts at once."""

    def __init__(self, field: Field):
        self.field = field
        self.beside = {d: np.array([field.weight(f"{d}:{c}") for c in CATEGORIES]) for d in (-3, -2, -1, 1)}
        self.any, self.joined, self.announced = (field.weight(n) for n in ("any", "joined", "announced"))
        self._reset()

    def _reset(self) -> None:
        self.known, self.weights = _Known(), {}
        self.own, self.kind, self.size = np.zeros((0, 3)), np.zeros(0, np.int8), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """The scores and categories of new pieces; blanks have category -1."""
        new, self.known.new = self.known.new, []
        need = len(self.known)
        if need > len(self.size):
            more = max(need, 2 * len(self.size)) - len(self.size)
            self.own, self.kind, self.size = np.vstack([self.own, np.zeros((more, 3))]), np.append(self.kind, np.zeros(more, np.int8)), np.append(self.size, np.zeros(more, np.int64))
        for i, piece in enumerate(new, need - len(new)):
            self.size[i] = len(piece)
            if piece.isspace():
                self.kind[i] = -1
            else:
                self.kind[i] = CATEGORIES.index(category(piece))
                shape = tuple(self.field.look.shape(piece))
                if (own := self.weights.get(shape)) is None:
                    own = self.weights[shape] = self.field.weight(*shape)
                self.own[i] = own

    def _file(self, text: str) -> np.ndarray:
        names = tuple(file_features(text))
        if names not in self.weights:
            self.weights[names] = self.field.weight(*names)
        return self.weights[names]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens: scores, starts, ends; and how many each text has."""
        if len(self.known) > REMEMBERED:
            self._reset()
        get, ids, n = self.known.__getitem__, [], []
        for t in texts:
            found = PIECE.findall(t)
            n.append(len(found))
            ids.append(np.fromiter(map(get, found), np.int64, len(found)))
        self._learn()
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(texts)), n)
        end = np.cumsum(self.size[flat])
        begin = end - self.size[flat]
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        offset = np.append(begin, 0)[np.minimum(first, len(begin))]
        solid = self.kind[flat] >= 0
        flat, text, begin, end = flat[solid], text[solid], begin[solid], end[solid]
        kind, many = self.kind[flat], np.bincount(text, minlength=len(texts))
        s = self.own[flat] + self.any + np.array([self._file(t) for t in texts]).reshape(-1, 3)[text]
        low = (np.cumsum(many) - many)[text]
        high = np.cumsum(many)[text]
        at, cue, sign = np.arange(len(flat)), np.zeros(len(flat), bool), np.zeros(len(flat), bool)
        for d, table in self.beside.items():
            there = at + d
            near = np.where((there >= low) & (there < high), kind[np.clip(there, 0, max(0, len(flat) - 1))], _EDGE) if len(flat) else kind
            s += table[near]
            if d < 0:
                cue |= near == 0
                sign |= near == 1
        s += self.joined * (np.append(False, begin[1:] == end[:-1])[: len(flat)] & (at > low))[:, None]
        s += self.announced * ((self.size[flat] >= 8) & cue & sign & (at > low + 1))[:, None]
        return s, begin - offset[text], end - offset[text], many

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """The spans of each text."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(self.field.names):
            return out
        s, begin, end, many = self.scores(texts)
        text = np.repeat(np.arange(len(texts)), many)
        first, last = np.zeros(len(s), bool), np.zeros(len(s), bool)
        starts = (np.cumsum(many) - many)[many > 0]
        first[starts] = True
        last[np.cumsum(many)[many > 0] - 1] = True
        may = self.field.open(s, first, last)
        cut = np.flatnonzero(may & (first | ~np.append(False, may[:-1])[: len(may)]))
        for a in cut.tolist():
            b = a + 1
            while b < len(may) and may[b] and not first[b]:
                b += 1
            spans = out[text[a]]
            begun = False
            for i, t in enumerate(self.field.best(s[a:b], bool(first[a]), bool(last[b - 1])), a):
                if t == 1:
                    spans.append((int(begin[i]), int(end[i])))
                elif t == 2 and begun:
                    spans[-1] = (spans[-1][0], int(end[i]))
                begun = t > 0
        return out


def field_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int, int]]]) -> Iterator[list[tuple[int, int]]]:
    """Spans that the field adds to each text: none that overlaps a base span."""
    for spans, own in zip(tagger(texts), base):
        yield [(a, b) for a, b in spans if not any(a < end and b > start for start, _, end, _ in own)]


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
#: Texts and characters of a portion (a longer text alone).
TEXTS, CHARS = 512, 400_000


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the counts of base matches, a digest of their spans, and all spans.

    Spans are ``kind:start:end`` in code points by start, then kind, the field's as ``crf``. Null texts
    are empty; a text without a match has empty spans; null and repeated ids pass through. Of tags that
    score alike the field takes outside before begin before inside.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)

        def portion(ids: list, texts: list[str]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            found = [base_spans(t) for t in texts]
            for base, added in zip(found, field_spans(tagger, texts, found)):
                spans = [(a, k, f"{KINDS[k]}:{a}:{b}") for a, k, b, _ in base]
                more = [(a, len(KINDS), f"crf:{a}:{b}") for a, b in added]
                counts = [sum(k == i for _, k, _ in spans) for i in range(3)]
                digest = hashlib.sha256(",".join(x[2] for x in spans).encode()).hexdigest()
                for x, v in zip(out, (*counts, digest, ",".join(x[2] for x in sorted(spans + more)))):
                    x.append(v)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.string()) for x in out[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                ids, texts, chars = [], [], 0
                for key, text in zip(*(c.to_pylist() for c in batch.slice(at, TEXTS).columns)):
                    text = text or ""
                    if texts and chars + len(text) > CHARS:
                        yield portion(ids, texts)
                        ids, texts, chars = [], [], 0
                    ids.append(key)
                    texts.append(text)
                    chars += len(text)
                if texts:
                    yield portion(ids, texts)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col)).mapInArrow(run, SCHEMA)
