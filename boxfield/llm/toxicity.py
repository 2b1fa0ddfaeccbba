"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses at sentence marks and line ends.  Each word of a
clause reads as one or more classes: insult (at its learned weight), threat,
target, negation, report, other.  Six transducers are compiled and composed once
(machines.py); weights are costs in the tropical semiring, and the lightest path
through the clause is its analysis:

* reported speech marks insults and threats a few words after a report word;
* negation marks those a few words after a negation;
* target reads an insult as aimed where a target stands near, before or behind it;
* threat reads a threat word as a threat where a target stands near;
* insult and the last machine weigh what was read: an insult its own weight, more
  if aimed, a threat a fixed weight, a threat word without target nothing, and
  marked ones so much less.  Any insult or threat word may also read as an
  ordinary word at no cost, so a clause never weighs less than nothing.

The weight of a clause is what its analysis gains; a text has the weight of its
heaviest clause and the sum over all, and its score is a logistic curve over both.

Insult words and stems are learned from at most ``ROWS`` labelled documents
outside the held-out part, chosen by a hash of the id: all terms that toxic
documents have far more often than others.  Scoring covers whole texts.

A null or empty text has no clauses.  Without labelled documents of both kinds
no term is learned and the fixed threat words alone count.  Repeated rows keep a
row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_remainder, quoted, text_bytes, with_text_columns
from .learning import labelled_sample, logistic, sigmoid
from .machines import Machine, compiled, compose, shortest, trimmed

ROWS = 12_000
STEM = range(3, 8)
LEAST_DOCS, LEAST_SHARE, LEAST_Z = 4, 0.6, 6.0

# Fixed word classes of the grammar.
TARGETS = frozenset("you your youre u he she they them him her his their hers theirs people everyone anyone".split())
THREATS = frozenset("kill hurt beat destroy shoot stab burn crush smash murder attack punch strangle hang".split())
NEGATIONS = frozenset("not never no nor without isnt arent wasnt dont doesnt didnt cannot nobody".split())
REPORTS = frozenset("said says say called calls call wrote writes reported claimed quoted quote according accused".split())
FIXED = ((TARGETS, "g"), (THREATS, "t"), (NEGATIONS, "n"), (REPORTS, "r"))
NEAR_TARGET, NEAR_THREAT, NEAR_NEGATION, NEAR_REPORT = 4, 5, 3, 6
REACH = 6
#: Log odds that a reading adds or takes.
TARGETED, THREAT_WEIGHT, NEGATED, REPORTED = 1.0, 5.0, 5.0, 5.0
#: Classes: other, insult, threat, target, negation, report; marks: r reported, n negated, * aimed.
CLASSES = ("o", "i", "t", "g", "n", "r")

CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def scope(trigger: str, mark: str, reach: int) -> Machine:
    """Marks insults and threats up to ``reach`` words after the trigger; a state is how many words are left."""

    def step(left: int, x: str):
        out = x + mark if left and x[0] in "it" else x
        return [(out, 0.0, reach if x == trigger else max(0, left - 1))]

    symbols = [*CLASSES, "ir", "tr"] if mark != "r" else CLASSES
    return compiled(0, step, symbols, lambda _: 0.0)


def aimed(kind: str, reach: int, symbols: list[str]) -> Machine:
    """Reads a word of the kind as aimed if a target stands within ``reach`` words before or behind it.

    A state is how many words the last target still reaches, and within how many
    a promised target must come; a promise that is not kept has no path.
    """

    def step(state: tuple[int, int], x: str):
        behind, ahead = state
        if x == "g":
            return [(x, 0.0, (reach, 0))]
        if ahead == 1:
            return []
        after = (max(0, behind - 1), max(0, ahead - 1))
        out = [(x, 0.0, after)]
        if x[0] == kind and behind:
            out.append((x + "*", 0.0, after))
        elif x[0] == kind:
            out.append((x + "*", 0.0, (after[0], after[1] or reach)))
        return out

    return compiled((0, 0), step, symbols, lambda s: math.inf if s[1] else 0.0)


def weigher(symbols: list[str]) -> Machine:
    """Weighs what was read and writes its kind; a threat word that is not aimed is an ordinary word."""

    def step(state: int, x: str):
        marks = (NEGATED if "n" in x[1:] else 0.0) + (REPORTED if "r" in x[1:] else 0.0)
        if x[0] == "i":
            return [("targeted insult" if "*" in x else "insult", marks - (TARGETED if "*" in x else 0.0), 0)]
        if x[0] == "t" and "*" in x:
            return [("threat", marks - THREAT_WEIGHT, 0)]
        return [(None, 0.0, 0)]

    return compiled(0, step, symbols, lambda _: 0.0)


def parts() -> list[Machine]:
    """The machines in the order in which they are composed."""
    marked = [*CLASSES, *(k + m for k in "it" for m in ("r", "n", "rn"))]
    insults = [*marked, *(x + "*" for x in marked if x[0] == "i")]
    every = [*insults, *(x + "*" for x in marked if x[0] == "t")]
    return [scope("r", "r", NEAR_REPORT), scope("n", "n", NEAR_NEGATION), aimed("i", NEAR_TARGET, marked), aimed("t", NEAR_THREAT, insults), weigher(every)]


@cache
def grammar_machine() -> Machine:
    """All machines composed; once for each process."""
    out, *rest = parts()
    for m in rest:
        out = trimmed(compose(out, m))
    return out


@dataclass
class Grammar:
    """exact: weights of words; stems: weights of beginnings; curve: logistic weights of (best, sum, constant)."""

    exact: dict[str, float]
    stems: dict[str, float]
    curve: np.ndarray

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}
        self.lengths = sorted({len(s) for s in self.stems})

    def insult(self, word: str) -> float:
        """Weight of a word as an insult: its own or its heaviest stem's."""
        weight = self.known.get(word)
        if weight is None:
            if len(self.known) > 500_000:
                self.known.clear()
            weight = max([self.exact.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in self.lengths if len(word) > k)])
            self.known[word] = weight
        return weight

    def readings(self, word: str) -> list[tuple[str, float]]:
        """Classes of a word with their costs: the insult transducer's arcs for it."""
        fixed = next((c for words_, c in FIXED if word in words_), "o")
        out = [(fixed, 0.0)] if fixed != "t" else [("t", 0.0), ("o", 0.0)]
        if (weight := self.insult(word)) > 0:
            out.append(("i", -weight))
        return out

    def clause(self, tokens: list[str]) -> tuple[float, list[str]]:
        """(weight, kinds of what matched) of the lightest path through one clause.

        Words farther than ``REACH`` from any insult or threat word change nothing, so
        the path is sought in the stretches around these.
        """
        at = [i for i, w in enumerate(tokens) if w in THREATS or self.insult(w) > 0]
        weight, kinds, machine = 0.0, [], grammar_machine()
        k = 0
        while k < len(at):
            first = k
            while k + 1 < len(at) and at[k + 1] - at[k] <= 2 * REACH:
                k += 1
            cost, found = shortest(machine, [self.readings(w) for w in tokens[max(0, at[first] - REACH) : at[k] + REACH + 1]])
            weight -= cost
            kinds += found
            k += 1
        return weight, kinds

    def features(self, text: bytes | None) -> tuple[float, float]:
        """(weight of the heaviest clause, sum over clauses) of a text."""
        if not text:
            return 0.0, 0.0
        best = total = 0.0
        for clause in CLAUSE.split(text.decode("utf-8", "replace")):
            weight, _ = self.clause(words(clause))
            best, total = max(best, weight), total + weight
        return best, total

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        found = np.array([self.features(t) for t in texts], float).reshape(-1, 2)
        return sigmoid(np.c_[shaped(found), np.ones(len(found))] @ self.curve)


def shaped(found: np.ndarray) -> np.ndarray:
    return np.c_[found[:, 0], np.log1p(found[:, 1])]


def terms_of(text: bytes) -> set[str]:
    """Words ("=word") and proper beginnings ("~beginning") of a text."""
    own = set(words(text.decode("utf-8", "replace")))
    return {"=" + w for w in own} | {"~" + w[:k] for w in own for k in STEM if len(w) > k}


def counted(sample: DataFrame) -> DataFrame:
    """(term, n): documents of the sample that have each term, in parts that are still to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in text_bytes(b.column("text")):
                counts.update(terms_of(t))
                if len(counts) > 500_000:
                    yield flushed(counts)
        yield flushed(counts)

    def flushed(counts):
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
        counts.clear()
        return out

    return sample.mapInArrow(run, "term string, n bigint")


def learned(sample: DataFrame, n_clean: int, n_toxic: int, scratch: Scratch) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) that tell toxic documents, with their log odds ratios.

    All terms are tested where they are counted; only those that pass reach the driver.
    """
    sums = F.sum("n")
    toxic = scratch.write(counted(sample.where("label = 1")).groupBy("term").agg(sums.alias("toxic")).where(F.col("toxic") >= LEAST_DOCS))
    clean = counted(sample.where("label = 0")).join(toxic.select("term"), "term", "left_semi").groupBy("term").agg(sums.alias("clean"))
    both = toxic.join(clean, "term", "left").select("term", "toxic", F.coalesce("clean", F.lit(0)).alias("clean"))
    expected = (F.col("clean") + F.col("toxic")) * (n_toxic / (n_clean + n_toxic))
    passed = both.where((F.col("toxic") >= LEAST_SHARE * (F.col("clean") + F.col("toxic"))) & (F.col("toxic") - expected >= LEAST_Z * F.sqrt(expected)))
    odds = {r.term: math.log((r.toxic + 0.5) / (n_toxic + 1)) - math.log((r.clean + 0.5) / (n_clean + 1)) for r in passed.collect()}
    return {t[1:]: w for t, w in odds.items() if t[0] == "="}, {t[1:]: w for t, w in odds.items() if t[0] == "~"}


def fitted(docs: DataFrame, labels: DataFrame, *, label="toxic", mod=5, held_out=0, rows=ROWS, **columns) -> Grammar:
    """Learns insult terms and the curve from a bounded sample of labelled documents."""
    scratch = Scratch(docs.sparkSession)
    sample = scratch.write(labelled_sample(docs, labels, label, mod, held_out, rows, **columns))
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    exact, stems = {}, {}
    if n_clean and n_toxic:
        exact, stems = learned(sample, n_clean, n_toxic, scratch)
    grammar = Grammar(exact, stems, np.zeros(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([grammar.features(t) for t in text_bytes(b.column("text"))], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), b.column("label")], names=["best", "total", "label"])

    found = sample.mapInArrow(run, "best double, total double, label int").toPandas().sort_values(["best", "total", "label"], ignore_index=True)
    x, y = found[["best", "total"]].to_numpy(float), found["label"].to_numpy(float)
    if len(y) and y.min() == y.max():  # one class only: the fixed threat words count for something
        grammar.curve = np.array([1.0, 0.0, -THREAT_WEIGHT / 2])
    elif len(y):
        grammar.curve = logistic(shaped(x), y)
    else:
        grammar.curve = np.array([1.0, 0.0, -THREAT_WEIGHT / 2])
    return grammar


def scored(docs: DataFrame, grammar: Grammar, *, text="text", keep: list[str], name="score") -> DataFrame:
    """``keep`` columns and the score of each whole text."""

    def make():
        return lambda batch: {name: grammar.scores(batch)}

    return with_text_columns(docs, text, make, f"`{name}` double", keep)


def matched_clauses(docs: DataFrame, grammar: Grammar, *, text="text", keep: list[str]) -> DataFrame:
    """``keep`` columns and clauses array<struct<clause, kinds, weight>> with a match."""

    def make():
        def work(batch):
            out = []
            for t in batch:
                rows = []
                for clause in CLAUSE.split(t.decode("utf-8", "replace") if t else ""):
                    weight, kinds = grammar.clause(words(clause))
                    if kinds:
                        rows.append({"clause": clause.strip(), "kinds": kinds, "weight": weight})
                out.append(rows)
            return {"clauses": out}

        return work

    return with_text_columns(docs, text, make, "clauses array<struct<clause:string,kinds:array<string>,weight:double>>", keep)


def digest(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """The columns of the op9 contract."""
    out = scored(docs, fitted(docs, labels, doc_id=doc_id, text=text), text=text, keep=[doc_id])
    return out.select(quoted(doc_id), (crc_remainder(F.col(quoted(doc_id)), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Documents with a score below one half, with their own columns."""
    grammar = fitted(docs, labels, **columns)
    out = scored(docs, grammar, text=columns.get("text", "text"), keep=list(docs.columns), name="__score")
    return out.where(F.col("__score") < 0.5).drop("__score")
