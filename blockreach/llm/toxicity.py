"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded: lower case, accents and homoglyphs of other scripts to Latin letters, digits and signs
that stand for letters to those letters. The lexicon holds whole words and word beginnings with weights
learned from labelled rows: a cautious bound of the log-odds of toxic against other documents. A word
weighs as its heaviest term; words inside an exception phrase weigh nothing. Exception phrases are given
ones and learned ones: pairs of neighbouring words with a weighing word in them that the labelled rows show
to be ordinary. The sums, normalised by length in two ways, and the heaviest word go through a logistic
curve fitted on the same rows.

Learning takes a bounded sample of the labelled rows (at most ``FIT_ROWS``, by a hash of id and text; rows
equal in both count once); scoring reads whole texts. Without both labels in the sample the lexicon is empty and every text scores 0, or 1 if
all labelled rows are toxic. Null and empty texts are scored like texts without any term. Labels of
ids that occur more than once count as toxic if any of them is. Only the named columns are read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from blockreach.llm.common import map_batches, text_slices, written

FIT_ROWS = 20_000
MIN_TOXIC_DOCUMENTS = 3
MIN_WEIGHT = 1.5
CAUTION = 1.6  # standard errors taken off a log-odds ratio
MIN_ORDINARY_DOCUMENTS = 3
PREFIX_LETTERS = range(4, 10)
THRESHOLD = 0.3
RIDGE = 0.01

# Ordinary phrases around words that are otherwise abusive, after folding.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "circus clown", "sore loser", "pond scum", "soap scum")

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
FOLDED = str.maketrans(HOMOGLYPHS | DIGITS)
SIGN_IN_WORD = regex.compile(r"(?<![@$!|])[@$!|](?=\p{L})")
WORD = regex.compile(r"[\p{L}\p{N}_]+")


def fold(text: str | None) -> list[str]:
    """Folded words of a text."""
    low = (text or "").lower()
    if not low.isascii():
        low = "".join([c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c)])
    if any(s in low for s in SIGNS):
        low = SIGN_IN_WORD.sub(lambda m: SIGNS[m[0]], low)
    return WORD.findall(low.translate(FOLDED))


def terms(words: set[str]) -> set[str]:
    """Candidate terms of a document: whole words (closed by a space) and their beginnings."""
    out = {w + " " for w in words}
    out.update(w[:k] for w in words for k in PREFIX_LETTERS if k < len(w) - 1)
    return out


@dataclass
class ToxicityModel:
    """Lexicon with weights, exception phrases, and the coefficients of the logistic curve."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: list[float]


class Matcher:
    """Aho-Corasick automaton over `` word word ``: terms start at a word, whole words also end there."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...]) -> None:
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.automaton.add_word(" " + term, (weight, len(term)))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (0.0, len(phrase) + 1))
        if len(self.automaton):
            self.automaton.make_automaton()

    def weighing(self, words: list[str]) -> dict[int, float]:
        """Heaviest weight at the places (in the line of words) where weighing, unexcused words start."""
        line, heaviest, excused = f" {' '.join(words)} ", {}, []
        if len(self.automaton):
            for end, (weight, size) in self.automaton.iter(line):
                start = end - size + 1
                if weight:
                    heaviest[start] = max(weight, heaviest.get(start, 0.0))
                else:
                    excused.append((start, end))
        if excused and heaviest:
            reached, spans = 0, iter(sorted(excused) + [(len(line), len(line))])
            left, right = next(spans)
            for start in sorted(heaviest):
                while left <= start:
                    reached = max(reached, right)
                    left, right = next(spans)
                if start < reached:
                    del heaviest[start]
        return heaviest

    def features(self, text: str | None) -> list[float]:
        """Length-normalised sums of the word weights, the heaviest word, and a constant."""
        words = fold(text)
        heaviest, count = self.weighing(words), len(words)
        total = sum(heaviest.values())
        return [math.log1p(total), 10 * total / (count + 10), total / math.sqrt(count + 1), max(heaviest.values(), default=0.0), 1.0]

    def phrases(self, text: str | None) -> set[str]:
        """Pairs of neighbouring words of which one weighs at least."""
        words = fold(text)
        heaviest, start, out = self.weighing(words), 1, set()
        for i, word in enumerate(words):
            if start in heaviest:
                out.update(" ".join(words[a:a + 2]) for a in (i - 1, i) if 0 <= a < len(words) - 1)
            start += len(word) + 1
        return out


def score_of(features: np.ndarray, coefficients: list[float]) -> np.ndarray:
    """Logistic curve."""
    return 1 / (1 + np.exp(-np.clip(features @ np.array(coefficients), -40, 40)))


def sample_labelled(df: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``fit_rows`` rows ``(text, toxic)`` of ``df`` with labels ``(doc_id, toxic)``, chosen by a hash of id and text."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    rows = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"), F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias("hash"))
    # Rows are drawn from those that have a label, so that their number is bounded however often an id occurs.
    candidates = rows.select("doc_id", "hash").distinct().join(known, "doc_id")
    chosen = written(candidates.orderBy(F.xxhash64("doc_id", "hash"), "doc_id").limit(fit_rows), "labelled-draw")
    # At most fit_rows short rows, which every task can hold.
    found = rows.join(F.broadcast(chosen), ["doc_id", "hash"])
    return written(found.groupBy("doc_id", "hash").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "labelled-sample")


def counted(sample: DataFrame, find) -> DataFrame:
    """Toxic (``bad``) and other (``good``) documents of a sample by what ``find()`` finds in their texts."""

    def count():
        names_of = find()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found: tuple[Counter, Counter] = Counter(), Counter()
            for text, y in zip(texts, toxic):
                found[y].update(names_of(text))
            names = list(found[0] | found[1])
            return pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "bad": pa.array([found[1][n] for n in names], pa.int64()), "good": pa.array([found[0][n] for n in names], pa.int64())})

        return step

    return map_batches(sample, "term string, bad bigint, good bigint", count).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def odds(bad: int, good: int) -> tuple[Column, Column]:
    """Log-odds of toxic against other documents for a counted term, and its standard error."""

    def side(n: str, of: int) -> Column:
        return F.log((F.col(n) + 0.5) / (of - F.col(n) + 0.5))

    return side("bad", bad) - side("good", good), F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))


def learn(sample: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicityModel:
    """Learn from a written, bounded table ``(text, toxic)``; its size bounds the lexicon and the phrases."""
    sizes = sample.agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")).first()
    bad, good = sizes["bad"], sizes["good"]
    if not bad or not good:
        return ToxicityModel({}, exceptions, [0.0, 0.0, 0.0, 0.0, 40.0 if bad else -40.0])
    ratio, error = odds(bad, good)
    weighed = counted(sample, lambda: lambda text: terms(set(fold(text)))).where(F.col("bad") >= MIN_TOXIC_DOCUMENTS).withColumn("weight", ratio - CAUTION * error)
    lexicon = {r["term"]: r["weight"] for r in weighed.where(F.col("weight") > MIN_WEIGHT).orderBy(F.desc("weight"), "term").collect()}
    # A pair is ordinary if it is no more often toxic than documents are, with one of each kind added.
    share = (F.col("bad") + 1) / (F.col("bad") + F.col("good") + 2)
    pairs = counted(sample, lambda: Matcher(lexicon, exceptions).phrases).where((F.col("good") >= MIN_ORDINARY_DOCUMENTS) & (share <= bad / (bad + good)))
    exceptions = exceptions + tuple(sorted(r["term"] for r in pairs.select("term").collect()))

    def measure():
        matcher = Matcher(lexicon, exceptions)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"x": pa.array([matcher.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), "toxic": batch.column(1)})

        return step

    # At most about FIT_ROWS rows of five numbers.
    rows = map_batches(sample, "x array<double>, toxic boolean", measure).collect()
    return ToxicityModel(lexicon, exceptions, fit_curve(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)))


def fit_curve(features: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(features.shape[1])
    for _ in range(40):
        p = score_of(features, w.tolist())
        gradient = features.T @ (p - toxic) + RIDGE * w
        hessian = (features * (p * (1 - p))[:, None]).T @ features + RIDGE * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w -= move / max(1.0, np.abs(move).max() / 5)
        if np.abs(move).max() < 1e-6:
            break
    return w.tolist()


def score_documents(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row ``doc_id, score`` and ``predicted`` (1 from ``threshold`` on)."""

    def make():
        matcher = Matcher(model.lexicon, model.exceptions)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, scores = batch.column(1).to_pylist(), []
            for a, b in text_slices(texts):
                scores += score_of(np.array([matcher.features(t) for t in texts[a:b]]), model.coefficients).tolist()
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32())})

        return step

    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    return map_batches(rows, f"doc_id {dict(df.dtypes)[id_col]}, score double, predicted int", make)
