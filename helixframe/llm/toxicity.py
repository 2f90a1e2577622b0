"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps tokens to classes: insults and threats with weights, targets, negation and
reported speech. The other transducers read the classes of a clause: they weaken what is negated or
reported, strengthen what is aimed at someone, and let a threat pass only with its target. Composed,
they are one machine, run clause by clause; a text's score is a logistic function of its matched
clauses: how many entries they hold, how often for the text's length, and their weights.

Insults are partly given and partly learned: words and word beginnings that labelled toxic texts
hold far more often than others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import trim, written

#: Labelled rows to learn from, learned entries, and the lengths of word beginnings.
SAMPLE, ENTRIES, STEMS = 20_000, 5_000, (4, 5, 6, 7)
#: Least texts with an entry, and least log-odds of it.
SUPPORT, ODDS = 3, 1.5

# Word lists in English, French, German and Spanish.
INSULTS = "idiot moron stupid scum trash loser clown pathetic worthless disgusting idiote imbécile connard ordure dummkopf abschaum trottel estúpido imbécil escoria"
THREATS = "kill hurt destroy stab shoot tuer frapper töten umbringen matar destruir"
TARGETS = "you your yours he she they him her them toi vous tu ton votre du dich dein euch sie usted ustedes ti vosotros"
NEGATION = "not never isn't aren't wasn't don't didn't cannot pas jamais nicht niemals kein keine nunca tampoco"
REPORTED = "said says wrote quoted claimed called reported dit écrit sagte schrieb dijo escribió"
#: Weight of an entry that is only given, and what a class's weight counts.
GIVEN = 3.0
FACTORS = {"I": 1.0, "J": 1.25, "i": 0.6, "X": 1.0}

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")


class Transducer:
    """Deterministic: (state, symbol) to (output, state); an unlisted symbol passes through unchanged and keeps the state."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[str, int]]):
        self.arcs = arcs

    def step(self, state: int, symbol: str) -> tuple[str, int]:
        return self.arcs.get((state, symbol), (symbol, state))


def composed(machines: list[Transducer], symbols: str) -> dict[tuple[tuple[int, ...], str], tuple[str, tuple[int, ...]]]:
    """The machines one behind another as one table over the states that can be reached."""
    start = (0,) * len(machines)
    table: dict = {}
    todo = [start]
    while todo:
        states = todo.pop()
        for symbol in symbols:
            if (states, symbol) in table:
                continue
            out, after = symbol, []
            for m, s in zip(machines, states):
                out, s = m.step(s, out)
                after.append(s)
            table[states, symbol] = (out, tuple(after))
            todo.append(tuple(after))
    return table


#: Symbols: I insult, T threat, Y target, N negation, R reported speech, o any other token. Weak insults are i, aimed ones J, threats that count X.
NEGATED = Transducer({(s, "N"): ("N", 3) for s in range(4)} | {(s, x): (x, s - 1) for s in (1, 2, 3) for x in "oYR"} | {(s, x): ("i" if x == "I" else "o", s - 1) for s in (1, 2, 3) for x in "IT"})
QUOTED = Transducer({(0, "R"): ("R", 1), (1, "I"): ("i", 1), (1, "T"): ("o", 1)})
AIMED = Transducer({(0, "Y"): ("Y", 1), (1, "I"): ("J", 1)})
THREATENED = Transducer({(0, "T"): ("o", 1), (1, "Y"): ("X", 0), (1, "T"): ("o", 1)})
MACHINE = composed([NEGATED, QUOTED, THREATENED, AIMED], "ITYNRo")
_START = (0, 0, 0, 0)
#: Behind a colon only reported speech goes on.
_RESUMED = {s: (0, s[1], 0, 0) for s, _ in MACHINE}


def folded(text: str) -> str:
    """Lower case, with one kind of apostrophe."""
    return text.lower().replace("’", "'")


@dataclass
class Grammar:
    """The lexicon: class and weight by word, insults by beginning; and how matches make a score."""

    words: dict[str, tuple[str, float]] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: For one, the weights of different entries, the logarithms of matches and of matches in 100 words, and the heaviest clause.
    effects: tuple[float, ...] = (-2.0, 1.0, 0.0, 0.0, 0.0)

    def symbol(self, token: str) -> tuple[str, float]:
        if (found := self.words.get(token)) and found[0] != "I":
            return found
        best = max((w for k in STEMS if len(token) > k and (w := self.stems.get(token[:k]))), default=0.0)
        if found and found[1] >= best:
            return found
        return ("I", best) if best else ("o", 0.0)

    def score(self, measures: tuple[float, ...]) -> float:
        total = sum(a * b for a, b in zip(self.effects, (1.0, *measures)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def lexicon(prior: float, learned: dict[str, float]) -> Grammar:
    """The given lists and the learned entries (a beginning is written with a final ``*``)."""
    words: dict[str, tuple[str, float]] = {}
    for kind, text in (("Y", TARGETS), ("R", REPORTED), ("N", NEGATION), ("T", THREATS), ("I", INSULTS)):
        words |= {w: (kind, GIVEN if kind in "IT" else 0.0) for w in text.split()}
    stems = {}
    for entry, w in learned.items():
        if entry.endswith("*"):
            stems[entry[:-1]] = w
        elif words.get(entry, "I")[0] == "I":
            words[entry] = ("I", w)
    return Grammar(words, stems, (prior, 1.0, 0.0, 0.0, 0.0))


def clauses(grammar: Grammar, text: str) -> Iterator[tuple[int, int, list[tuple[str, float, float]], int]]:
    """Clauses of a lower-case text: start, end, matches (entry, weight, what its class counts) and words."""
    state, start, found, words, end = _START, 0, [], 0, 0
    for m in TOKEN.finditer(text):
        token, end = m[0], m.end()
        if token in _ENDS:
            yield start, end, found, words
            state = _RESUMED[state] if token == ":" else _START  # what is reported often stands behind a colon
            start, found, words = end, [], 0
            continue
        words += 1
        symbol, w = grammar.symbol(token)
        out, state = MACHINE[state, symbol]
        if out in FACTORS:
            found.append((token, w or GIVEN, FACTORS[out]))
    yield start, end, found, words


def measures(grammar: Grammar, text: str) -> tuple[float, float, float, float]:
    """Weight of the different entries, logarithms of the matches and of those in 100 words, weight of the heaviest clause."""
    best: dict[str, float] = {}
    n = words = 0.0
    top = 0.0
    for _, _, found, size in clauses(grammar, folded(text)):
        words += size
        n += sum(f for _, _, f in found)
        top = max(top, sum(w * f for _, w, f in found))
        for token, w, f in found:
            best[token] = max(best.get(token, 0.0), w * f)
    return sum(best.values()), math.log1p(n), math.log1p(100 * n / max(words, 1)), top


def scored(grammar: Grammar, text: str) -> float:
    return grammar.score(measures(grammar, text))


def calibrated(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Effects of a logistic model by Newton's method, penalised but for the first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [penalty] * (x.shape[1] - 1)) + 1e-6 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, beta))


def _features(text: str) -> set[str]:
    words = {m for m in TOKEN.findall(folded(text)) if len(m) > 1}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch: in how many toxic and other texts an entry occurs; the empty entry counts the texts."""
    for batch in batches:
        bad: Counter = Counter()
        good: Counter = Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (bad if toxic else good).update(_features(text) | {""})
        entries = list(bad.keys() | good.keys())
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array([bad[e] for e in entries], pa.int64()), pa.array([good[e] for e in entries], pa.int64())], names=["entry", "bad", "good"])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, entries: int = ENTRIES) -> Grammar:
    """Learn from at most ``sample`` labelled rows whose id is not held out, in the order of a hash of the id.

    Equal texts count once, toxic if any of them is; of repeated labels the greatest holds. An entry must stand out by a likelihood ratio that no chance entry among
    as many would reach. Without labels only the given words are left.
    """
    ids = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(ids), "doc_id")  # the sample has a bound
    once = texts.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.max(F.struct("toxic", "text")).alias("x")).select("x.text", F.col("x.toxic").cast("int").alias("toxic"))
    counts = written(once.mapInArrow(_counted, "entry string, bad bigint, good bigint").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "lexicon")
    bad, good, kinds = counts.agg(F.max(F.when(F.col("entry") == "", F.col("bad"))), F.max(F.when(F.col("entry") == "", F.col("good"))), F.count("*")).first()
    bad, good = bad or 0, good or 0
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    share = (F.col("bad") + F.col("good")) / max(1, bad + good)
    ratio = 2 * (F.col("bad") * F.log(F.col("bad") / (bad * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (good * share))).otherwise(0.0))
    strong = counts.where(f"entry <> '' and bad >= {SUPPORT}").withColumn("odds", odds).withColumn("ratio", ratio).where((F.col("odds") >= ODDS) & (F.col("ratio") >= 2 * math.log(max(kinds, 2))))
    picked = strong.orderBy(F.desc("ratio"), "entry").limit(entries).collect()
    grammar = lexicon(math.log((bad + 0.5) / (good + 0.5)) if bad + good else -2.0, {r["entry"]: r["odds"] for r in picked})
    if not (bad and good):
        return grammar

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(grammar, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    seen = sorted((r["x"], r["toxic"]) for r in once.mapInArrow(measured, "x array<double>, toxic int").collect())  # the sample's bound
    grammar.effects = calibrated(np.array([x for x, _ in seen]), np.array([float(t) for _, t in seen]))
    return grammar


def _scores(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in [w for w, (kind, _) in grammar.words.items() if kind in "IT"] + list(grammar.stems):
            automaton.add_word(w, len(w))
        automaton.make_automaton()
        base = grammar.score((0.0, 0.0, 0.0, 0.0))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                low, score = folded(text or ""), base
                for end, n in automaton.iter(low):  # any entry that begins a word: else no clause can match
                    if end == n - 1 or not low[end - n].isalnum():
                        score = scored(grammar, low)
                        break
                out.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["row", "score"])

    return run


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1). Null and empty texts have the prior's score; every column is kept.

    A column of the name ``score`` is replaced.
    """
    from pyspark.sql.functions import pandas_udf

    inner = _scores(grammar)

    @pandas_udf("double")
    def of(text):  # noqa: ANN001
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.nulls(len(text)), pa.array(text, pa.string())], names=["row", "text"])
        out = pd.Series(next(inner([batch])).column(1).to_numpy(), index=text.index)
        trim()
        return out

    return docs.withColumn("score", of(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
