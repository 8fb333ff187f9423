"""Language identification by string kernels with Nyström landmarks.

A text's features are the distinct n-grams (1 to 3 symbols, blended) that occur in it; the kernel of two
texts is the number of n-grams present in both, normalised by the geometric mean of their numbers of
n-grams. Kernel ridge regression, one language against the rest, is solved in the span of landmark texts
(Nyström), and whole texts are scored in batches: presence matrix times landmark presence, normalised,
times the coefficients.

Fitting takes a bounded sample of the labelled rows (``FIT_ROWS`` in all, the same number per language
where there are enough, one at least), chosen by a hash of the text. Whole texts are read, in fitting (by
tasks, which return the letters and then the distinct n-grams of each) as in prediction. The alphabet is
every letter of the sample; letters that do not occur there share one symbol; runs of other characters are
one gap.

Null, empty and letterless texts are ``und`` with score 0, as is every text if nothing could be learned.
Rows without label are never learned from. Repeated rows repeat their result; ties go to the first
language in alphabetical order. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from blockreach.llm.common import map_batches, pass_through_schema, written

FIT_ROWS = 2400
LANDMARKS = 160
RIDGE = 1e-2
GAP, OTHER = 0, 1  # then the learned letters
UNDETERMINED = "und"
# A text is turned away below this score: no language stands out against the rest.
REJECT_BELOW = 0.3
SCORED_TOGETHER = 256
# Up to this many possible n-grams, presence is looked up in one flag each; beyond, in sorted codes.
FLAGS = 1 << 23


@dataclass
class LanguageModel:
    """Alphabet, n-gram dictionary, landmark presence and regression coefficients."""

    letters: str
    grams: np.ndarray  # n-gram codes that occur in a landmark
    landmarks: np.ndarray  # presence of those codes, one column per landmark
    norms: np.ndarray  # square roots of the landmarks' n-gram counts
    coefficients: np.ndarray  # landmarks (and a constant) by languages
    languages: list[str]


def has_letter(text: str | None) -> bool:
    """Whether a text holds any letter of any script."""
    return bool(text) and regex.search(r"\p{L}", text) is not None


class Symbols:
    """Texts as arrays of symbols, and their n-gram codes."""

    def __init__(self, letters: str) -> None:
        self.table = np.full(0x110000, -1, np.int32)
        self.table[[ord(c) for c in letters]] = np.arange(len(letters)) + 2
        # Whether any other code point is a letter is found out when it is first seen.
        self.size = len(letters) + 2
        space = self.size + self.size**2 + self.size**3
        self.present = np.zeros(space, bool) if space <= FLAGS else None

    def of(self, text: str) -> np.ndarray:
        """Symbols of the lower-cased text, with a gap at both ends and gap runs collapsed."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = self.table[points]
        unseen = symbols < 0
        if unseen.any():
            for point in np.unique(points[unseen]):
                self.table[point] = OTHER if chr(point).isalpha() else GAP
            symbols = self.table[points]
        symbols = np.concatenate(([GAP], symbols, [GAP])).astype(np.int64)
        return symbols[np.r_[True, (symbols[1:] != GAP) | (symbols[:-1] != GAP)]]

    def grams(self, text: str) -> np.ndarray:
        """Codes of all n-grams of a text, repeats included."""
        s = self.of(text)
        two = s[:-1] * self.size + s[1:]
        three = two[:-1] * self.size + s[2:]
        return np.concatenate((s, two + self.size, three + (self.size + self.size**2)))

    def presence(self, text: str, dictionary: np.ndarray) -> tuple[np.ndarray, int]:
        """Presence of the dictionary's codes in a text, and the number of its distinct n-grams."""
        codes = self.grams(text)
        if self.present is None:
            distinct = np.unique(codes)
            return held(distinct, dictionary), len(distinct)
        self.present[codes] = True
        out, count = self.present[dictionary], np.count_nonzero(self.present)
        self.present[codes] = False
        return out, count


def held(distinct: np.ndarray, dictionary: np.ndarray) -> np.ndarray:
    """Which codes of the dictionary occur among sorted distinct codes (one at least)."""
    return distinct[np.minimum(np.searchsorted(distinct, dictionary), len(distinct) - 1)] == dictionary


def alphabet(texts: list[str]) -> str:
    """Letters of lower-cased texts in order."""
    return "".join(sorted({c for t in texts for c in set(t.lower()) if c.isalpha()}))


def kernel(model_landmarks: np.ndarray, norms: np.ndarray, presence: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of a batch of texts with the landmarks."""
    return (presence.astype(np.float32) @ model_landmarks) / (np.sqrt(np.maximum(counts, 1))[:, None] * norms)


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel | None:
    """Fit on ``(text, language)`` rows; None if there are none with letters."""
    rows = sorted({(t, lang) for t, lang in rows if has_letter(t)})
    letters = alphabet([t for t, _ in rows])
    symbols = Symbols(letters)
    return fit_grams(letters, [(np.unique(symbols.grams(t)), lang) for t, lang in rows], landmarks, ridge)


def fit_grams(letters: str, rows: list[tuple[np.ndarray, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel | None:
    """Fit on ``(sorted distinct n-gram codes, language)`` rows; None if there are none."""
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(0)
    order = rng.permutation(len(rows))
    # Landmarks are spread evenly over the languages.
    by_language = {lang: [i for i in order if rows[i][1] == lang] for lang in languages}
    each = max(1, landmarks // len(languages))
    chosen = [i for lang in languages for i in by_language[lang][:each]]
    dictionary = np.unique(np.concatenate([rows[i][0] for i in chosen]))
    presence, counts = np.array([held(g, dictionary) for g, _ in rows]), np.array([len(g) for g, _ in rows])
    columns = np.ascontiguousarray(presence[chosen].T.astype(np.float32))
    norms = np.sqrt(counts[chosen]).astype(np.float32)
    between = kernel(columns, norms, presence, counts).astype(np.float64)
    values, vectors = np.linalg.eigh(between[chosen])
    good = values > values[-1] * 1e-8
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.c_[between @ root, np.ones(len(rows))]
    targets = np.array([[1.0 if lang == own else -1.0 for lang in languages] for _, own in rows])
    # Every language weighs the same, however often it occurs in the sample.
    weight = np.array([1.0 / len(by_language[own]) for _, own in rows])
    weight *= len(rows) / weight.sum()
    gram = features.T @ (features * weight[:, None])
    solved = np.linalg.solve(gram + ridge * len(rows) * np.diag([*np.full(root.shape[1], 1.0), 0.0]) / root.shape[1], features.T @ (targets * weight[:, None]))
    return LanguageModel(letters, dictionary, columns, norms, np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32), languages)


def sample_labelled(rows: DataFrame, total: int = FIT_ROWS) -> DataFrame:
    """At most ``total`` of ``rows (text, lang)``, about the same number per language and one at least, chosen by text hash.

    Copies count once, so that a group of them takes one place of its language only.
    """
    hashed = rows.select("text", "lang", F.xxhash64("text").alias("hash"))
    distinct = written(hashed.select("hash", "lang").distinct(), "language-hashes")
    counts = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    each = max(1, total // max(1, counts.count()))
    # Some more than needed are drawn, so that a language all but never comes short; the ranking sees only those.
    draw = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    # One row per language, as in the draw below; drawing before the shuffle keeps a common language small.
    drawn = distinct.join(F.broadcast(counts), "lang").withColumn("draw", draw).where(F.col("draw") * F.col("n") < 2 * each + 30)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "hash"))
    chosen = written(drawn.withColumn("place", place).where(F.col("place") <= each).select("hash", "lang"), "language-draw")
    # One short row per sampled text: FIT_ROWS, or one per language.
    return written(hashed.join(F.broadcast(chosen), ["hash", "lang"]).groupBy("hash", "lang").agg(F.first("text").alias("text")), "language-sample")


def learn(df: DataFrame, learnable: Column, text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fit on the rows where ``learnable`` holds and text and language are known."""
    rows = df.where(learnable & df[text_col].isNotNull() & df[lang_col].isNotNull())
    sample = sample_labelled(rows.select(df[text_col].alias("text"), df[lang_col].cast("string").alias("lang")))

    def find_letters():
        return lambda batch: pa.RecordBatch.from_pydict({"letters": pa.array([alphabet(batch.column(0).to_pylist())])})

    letters = alphabet([r["letters"] for r in map_batches(sample.select("text"), "letters string", find_letters).distinct().collect()])

    def find_grams():
        symbols = Symbols(letters)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            grams = [np.unique(symbols.grams(t)).tobytes() if has_letter(t) else None for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_pydict({"hash": batch.column(0), "lang": batch.column(1), "grams": pa.array(grams, pa.binary())})

        return step

    # The sample's distinct n-grams: a few thousand numbers a text, however long it is.
    found = map_batches(sample.select("hash", "lang", "text"), "hash bigint, lang string, grams binary", find_grams).where("grams IS NOT NULL").collect()
    return fit_grams(letters, [(np.frombuffer(r["grams"], np.int64), r["lang"]) for r in sorted(found, key=lambda r: (r["hash"], r["lang"]))])


def predictor(model: LanguageModel | None):
    """Function from texts to ``(language, score)`` per text."""
    symbols = Symbols(model.letters) if model else None

    def predict(texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if model is None:
            return out
        asked = [i for i, t in enumerate(texts) if has_letter(t)]
        for start in range(0, len(asked), SCORED_TOGETHER):
            part = asked[start:start + SCORED_TOGETHER]
            presence, counts = np.empty((len(part), len(model.grams)), bool), np.empty(len(part), np.int64)
            for row, i in enumerate(part):
                presence[row], counts[row] = symbols.presence(texts[i], model.grams)
            values = kernel(model.landmarks, model.norms, presence, counts) @ model.coefficients[:-1] + model.coefficients[-1]
            best = values.argmax(axis=1)
            scores = np.clip((values[np.arange(len(part)), best] + 1) / 2, 0, 1)
            for row, i in enumerate(part):
                out[i] = (model.languages[best[row]], float(scores[row]))
        return out

    return predict


def identify(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, lang_pred, score``."""

    def make():
        predict = predictor(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = predict(batch.column(1).to_pylist())
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array([p for p, _ in found]), "score": pa.array([s for _, s in found], pa.float64())})

        return step

    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    return map_batches(rows, f"doc_id {dict(df.dtypes)[id_col]}, lang_pred string, score double", make)


def keep_identified(df: DataFrame, model: LanguageModel | None, text_col: str = "text", reject_below: float = REJECT_BELOW) -> DataFrame:
    """Rows whose language is determined with at least the score ``reject_below``, with all their columns."""
    at = df.columns.index(text_col)

    def make():
        predict = predictor(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = predict(batch.column(at).to_pylist())
            return batch.filter(pa.array([p != UNDETERMINED and s >= reject_below for p, s in found]))

        return step

    return map_batches(df, pass_through_schema(df), make)
