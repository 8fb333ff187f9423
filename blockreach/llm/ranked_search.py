"""Ranked lexical search with hashed max-sketches.

A document's terms have integer impacts (a saturating function of their count and the document's length).
They fold into a sketch of ``WIDTH`` coordinates: each coordinate keeps the largest impact of the terms
that hash to it. For a block of queries, the sketches of a batch of documents times the queries' term
weights by coordinate (one matrix product, exact in doubles below 2^53) are upper bounds of all scores.
Each query then scores documents exactly in descending order of their bounds until the next bound is
below its threshold, the score of its last kept document. Tasks keep ``top`` documents per query; a last
step ranks these.

One pass counts documents, terms and the document frequencies of the queries' terms, a second searches;
texts are read whole in both. Queries come in blocks of ``BLOCK_ITEMS`` rows, the documents are never
gathered. Null texts and texts without a term hold no term and are not ranked; equal scores rank by id (a
null id last); repeated documents count and rank each, repeated queries get their rows each; queries
without terms have no rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F

from blockreach.llm.common import text_slices

TOP = 50
WIDTH = 2048
BLOCK_ITEMS = 1000
SLICE_DOCS = 512
RESCORED_AT_ONCE = 64
KNOWN_TERMS = 500_000
DOCUMENTS, TERMS = -1, -2  # codes of the two totals among the frequencies
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def coordinate(term: bytes, width: int) -> int:
    """Place of a term in a sketch."""
    return zlib.crc32(term) % width


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Impact of a term that occurs ``tf`` times in a document of length value ``m``."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def frequencies(df: DataFrame, terms: list[bytes]) -> dict[int, int]:
    """Number of documents with a term, of terms with repeats, and of documents holding each of ``terms``, by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {t: i for i, t in enumerate(terms)}
        wanted, found = set(code), np.zeros(len(terms), np.int64)
        documents = total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = terms_of(text)
                documents += bool(own)
                total += len(own)
                for t in wanted.intersection(own):
                    found[code[t]] += 1
        codes = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[codes, DOCUMENTS, TERMS].astype(np.int32)), pa.array(np.r_[found[codes], documents, total].astype(np.int64))], names=["code", "n"])

    # One row per term of the block of queries.
    return {r["code"]: r["n"] for r in df.mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()}


class Queries:
    """A block of queries: their terms' weights, exact and by sketch coordinate."""

    def __init__(self, term_sets: list[list[bytes]], weights: dict[bytes, int], width: int) -> None:
        self.width, self.code = width, {t: i for i, t in enumerate(weights)}
        self.weight = np.array(list(weights.values()), np.int64)
        self.terms = [np.array([self.code[t] for t in own], np.int64) for own in term_sets]
        places = [coordinate(t, width) for t in weights]
        # Only coordinates that some query looks up are multiplied.
        used = sorted(set(places))
        self.column = np.full(width, -1, np.int64)
        self.column[used] = np.arange(len(used))
        self.lookups = np.zeros((len(used), len(term_sets)))
        for q, own in enumerate(self.terms):
            np.add.at(self.lookups[:, q], self.column[[places[i] for i in own]], self.weight[own])


class Best:
    """The best documents of one query seen by a task."""

    def __init__(self, top: int) -> None:
        self.top, self.rows, self.threshold = top, [], 1

    def add(self, scored: list[tuple[int, object]]) -> None:
        self.rows = sorted([*self.rows, *scored], key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))[:self.top]
        if len(self.rows) == self.top:
            self.threshold = max(1, self.rows[-1][0])


def search_batch(queries: Queries, best: list[Best], known: defaultdict, places: np.ndarray, ids: list, found: list[list[bytes]], n_documents: int, n_terms: int) -> np.ndarray:
    """Search one batch of documents; returns the coordinates of the terms known so far."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((known[t] for own in found for t in own), np.int64, int(sizes.sum()))
    if len(known) > len(places):
        places = np.r_[places, np.fromiter((coordinate(t, queries.width) for t in islice(known, len(places), None)), np.int64)]
    keys, tf = np.unique(np.repeat(np.arange(len(found)), sizes) * len(known) + flat, return_counts=True)
    doc, term = np.divmod(keys, len(known))
    m = np.array([50 + 50 * int(n) * n_documents // n_terms for n in sizes], np.int64)
    impact = impacts(tf, m[doc])
    # Sketches, on the coordinates that are looked up.
    column = queries.column[places[term]]
    held = column >= 0
    sketch = np.zeros(len(found) * len(queries.lookups))
    np.maximum.at(sketch, doc[held] * len(queries.lookups) + column[held], impact[held].astype(float))
    bounds = sketch.reshape(len(found), -1) @ queries.lookups
    # Exact impacts of the queries' own terms.
    codes = np.full(len(known), -1, np.int64)
    for t, i in queries.code.items():
        if t in known:
            codes[known[t]] = i
    own = codes[term]
    held = own >= 0
    exact = np.zeros((len(found), len(queries.code)), np.int64)
    exact[doc[held], own[held]] = impact[held]
    thresholds = np.array([b.threshold for b in best])
    for q in np.flatnonzero((bounds >= thresholds).any(axis=0)):
        terms, kept = queries.terms[q], best[q]
        waiting = np.flatnonzero(bounds[:, q] >= kept.threshold)
        waiting = waiting[np.argsort(-bounds[waiting, q], kind="stable")]
        for start in range(0, len(waiting), RESCORED_AT_ONCE):
            part = waiting[start:start + RESCORED_AT_ONCE]
            if bounds[part[0], q] < kept.threshold:
                break
            scores = exact[np.ix_(part, terms)] @ queries.weight[terms]
            hits = np.flatnonzero(scores >= kept.threshold)
            if len(hits):
                kept.add([(int(scores[i]), ids[part[i]]) for i in hits])
    return places


def search_block(docs: DataFrame, rows: list[Row], top: int, width: int, item_type: str) -> DataFrame | None:
    """Kept documents of all tasks for one block of queries: ``(item, item_id, doc_id, score)``; None if nothing can be found."""
    term_sets = [list(dict.fromkeys(terms_of(r["text"]))) for r in rows]
    terms = list(dict.fromkeys(t for own in term_sets for t in own))
    counted = frequencies(docs.select("text"), terms)
    n_documents, n_terms = counted.get(DOCUMENTS, 0), counted.get(TERMS, 0)
    weights = {t: math.floor(1000 * math.log((2 * n_documents + 2) / (2 * counted[i] + 1))) for i, t in enumerate(terms) if i in counted}
    if not weights:
        return None
    term_sets = [[t for t in own if t in weights] for own in term_sets]
    item_ids = pa.array([r["item_id"] for r in rows])
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, best = Queries(term_sets, weights, width), [Best(top) for _ in term_sets]
        known: defaultdict = defaultdict(count().__next__)
        places, doc_type = np.zeros(0, np.int64), None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            for a, b in text_slices(texts):
                for start in range(a, b, SLICE_DOCS):
                    stop = min(b, start + SLICE_DOCS)
                    found = [terms_of(t) for t in texts[start:stop]]
                    if any(found):
                        places = search_batch(queries, best, known, places, ids[start:stop], found, n_documents, n_terms)
                    if len(known) > KNOWN_TERMS:
                        known, places = defaultdict(count().__next__), np.zeros(0, np.int64)
        kept = [(q, doc, score) for q, b in enumerate(best) for score, doc in b.rows]
        if kept:
            item = pa.array([k[0] for k in kept], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [item, item_ids.take(item), pa.array([k[1] for k in kept], doc_type), pa.array([k[2] for k in kept], pa.int64())], names=["item", "item_id", "doc_id", "score"])

    return docs.mapInArrow(run, f"item int, item_id {item_type}, doc_id {id_type}, score bigint")


def search(
    df: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    width: int = WIDTH, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above zero, best first."""
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    asked = items.select(items[item_id_col].alias("item_id"), items[item_text_col].alias("text"))
    item_type, id_type = asked.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = df.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score bigint")
    waiting = asked.toLocalIterator()
    while block := list(islice(waiting, block_items)):
        found = search_block(docs, block, top, width, item_type)
        if found is not None:
            out = out.unionByName(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))
    return out
