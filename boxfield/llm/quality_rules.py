"""Quality rules as a short-circuit cascade.

A rule is a test on features of one text; a feature is computed when a rule
first asks for it and then kept for the text.  On a bounded sample each rule's
cost and rejection rate are estimated, and the rules run by falling rejection
per cost.  A text leaves the cascade at the first rule that rejects it.  The
order changes what is computed, never which texts are kept.

Null counts as a text without words.  Repeated rows keep a row each.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, quoted, text_bytes, with_text_columns

SYMBOLS = b"#*$%&|<>"
KEPT_BYTES = bytes(b for b in range(256) if b not in SYMBOLS)
CONTINUED = bytes(range(0x80, 0xC0))
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
#: About so many texts, chosen by a hash over all rows, are used to estimate costs and rejection rates.
SAMPLE = 512
SEED = 42


def repeated_mask(words: list[bytes], window: int = WINDOW) -> np.ndarray | None:
    """Marks the words inside windows of ``window`` words that occur twice or more, first occurrences included; None if there are none."""
    n = len(words) - window + 1
    if n < 2:
        return None
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return None
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    # Exact codes of ever longer runs: code of a pair of codes, renumbered from 0.
    code, length = ids, 1
    while length < window:
        step = min(length, window - length)
        pair = code[: len(code) - step] * (int(code.max()) + 1) + code[step:]
        _, code = np.unique(pair, return_inverse=True)
        length += step
    at = np.flatnonzero(np.bincount(code)[code] > 1)
    if not len(at):
        return None
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return np.cumsum(marks[:-1]) > 0


def repeated_positions(words: list[bytes], window: int = WINDOW) -> int:
    mask = repeated_mask(words, window)
    return 0 if mask is None else int(mask.sum())


class Features:
    """Lazily computed features of one text."""

    def __init__(self, data: bytes | None) -> None:
        self.data = data or b""

    def __getattr__(self, name: str):
        value = FEATURES[name](self)
        self.__dict__[name] = value
        return value


def _dup_lines(f: Features) -> int:
    lines = [x for x in f.data.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


FEATURES: dict[str, Callable[[Features], object]] = {
    "words": lambda f: f.data.split(),
    "n_words": lambda f: len(f.words),
    "word_chars": lambda f: len(f.data.translate(None, CONTINUED + SPACES)),
    "n_symbols": lambda f: len(f.data.translate(None, KEPT_BYTES)),
    "n_lines": lambda f: sum(1 for x in f.data.split(b"\n") if x.strip(SPACES)),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": lambda f: repeated_positions(f.words),
    "n_distinct": lambda f: len(set(f.words)),
    "n_upper": lambda f: sum(f.data.count(bytes([b])) for b in range(0x41, 0x5B)),
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


#: A text is rejected for any of these.
RULES = (
    Rule("few_words", lambda f: f.n_words < 10),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("duplicate_lines", lambda f: 100 * f.n_dup_lines > 70 * f.n_lines),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 20 * f.n_words),
    Rule("upper_case", lambda f: 2 * f.n_upper > f.word_chars),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimates(texts: list[bytes | None], rules=RULES) -> list[Estimate]:
    """Cost and rejection rate of each rule alone; its features are computed anew."""
    out = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(bool(rule.rejects(Features(t))) for t in texts)
        out.append(Estimate(rule.name, (time.perf_counter() - began) / max(1, len(texts)), (rejected + 0.5) / (len(texts) + 1)))
    return out


def ordered(rules, found: list[Estimate]) -> list[Rule]:
    rank = {e.name: e.rank for e in found}
    return sorted(rules, key=lambda r: -rank[r.name])


def sampled(docs: DataFrame, text: str, rows: int) -> list[bytes | None]:
    """At most ``rows`` texts, those of the smallest hashes over the whole table: they only set the order of the rules.

    Hashes are taken where the texts are and the smallest of each task compared, so that no text is shuffled.
    """
    t = column(docs, text).cast("string")
    found = docs.select(t.alias("t"), F.xxhash64(t, F.lit(SEED)).alias("h")).orderBy("h").limit(rows).select("t").toArrow()
    return text_bytes(found.column("t").combine_chunks()) if found.num_rows else []


def cascade(docs: DataFrame, *, text="text", keep: list[str], rules=RULES, sample: int = SAMPLE, report: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, ``report`` features (bigint), rejected_by (first rejecting rule or null) and kept."""
    order = ordered(rules, estimates(sampled(docs, text, sample), rules))
    names = [r.name for r in order]

    def make():
        def work(batch):
            by, cols = [], {c: [] for c in report}
            for t in batch:
                f = Features(t)
                by.append(next((r.name for r in order if r.rejects(f)), None))
                for c in report:
                    cols[c].append(getattr(f, c))
            return {**cols, "rejected_by": by}

        return work

    assert len(set(names)) == len(names)
    out = with_text_columns(docs, text, make, "".join(f"{c} bigint, " for c in report) + "rejected_by string", keep)
    return out.withColumn("kept", F.col("rejected_by").isNull())


def digest(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """The columns of the op7 contract; here all base features are asked for, whatever rejects first."""
    found = cascade(docs, text=text, keep=[doc_id], report=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select(quoted(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")
