"""Benchmark passages in documents by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive words of the benchmark items. Per pattern length a shift table over
blocks of two words says how far a search may jump (a block that no pattern holds: almost a whole window),
suffix buckets select the patterns that end with the block read, and a direct comparison confirms them.

The items are cut into blocks of bounded size in the shared folder; a task reads each block's tables in
turn for its batch of documents, so memory is bounded for any number of items and documents never shuffle.

Null and empty texts have no words. An item of fewer words than a window is one window; an item without
words matches nothing. An item with a null id counts its hits under an empty id. Repeated items and
repeated windows count once per item. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from blockreach.llm.common import map_batches, open_folder, pass_through_schema, shared_folder

WINDOW_WORDS = 10
BLOCK_BYTES = 16_000_000  # item text whose tables a task holds at once

# Word bytes: digits, letters (lower case) and everything beyond ASCII; all else parts words.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


class Patterns:
    """Search tables for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple, set[str]]) -> None:
        self.length, self.width = length, min(2, length)
        self.default = length - self.width + 1
        self.shift: dict[tuple, int] = {}
        self.suffix: dict[tuple, list[tuple[tuple, set[str]]]] = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.width, length + 1):
                block = words[end - self.width:end]
                self.shift[block] = min(self.shift.get(block, self.default), length - end)
            self.suffix[words[-self.width:]].append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """End position (exclusive) and items of every occurrence."""
        length, width, default, shift, suffix = self.length, self.width, self.default, self.shift.get, self.suffix
        end, count = length, len(words)
        while end <= count:
            block = tuple(words[end - width:end])
            step = shift(block, default)
            if step:
                end += step
                continue
            first = words[end - length]
            for pattern, items in suffix[block]:
                if pattern[0] == first and list(pattern) == words[end - length:end]:
                    yield end, items
            end += 1


def tables_of(items: Iterator[tuple[str, str | None]], window: int) -> list[Patterns]:
    """Search tables by pattern length, over all windows of the items."""
    found: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for at in range(len(words) - length + 1 if words else 0):
            found[length][tuple(words[at:at + length])].add(item)
    return [Patterns(length, patterns) for length, patterns in found.items()]


@dataclass(frozen=True)
class ItemBlocks:
    """Benchmark items in ``count`` blocks of bounded size in the shared folder."""

    folder: str
    count: int
    window: int

    def tables(self, number: int) -> list[Patterns]:
        """Search tables of one block, read on the executor."""
        fs, path = open_folder(self.folder)
        at = f"{path}/block={number}"
        if fs.get_file_info(at).type.name != "Directory":
            return []
        read = pq.read_table(at, filesystem=fs, partitioning=None)
        return tables_of(zip(read.column("item").to_pylist(), read.column("text").to_pylist()), self.window)


def store_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> ItemBlocks:
    """Write the items' texts in blocks of about ``block_bytes``."""
    rows = items.select(F.coalesce(items[id_col].cast("string"), F.lit("")).alias("item"), items[text_col].alias("text")).where(F.length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count, folder = -(-total // block_bytes), shared_folder(items.sparkSession, "benchmark")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, count))))
    dealt.repartition("block").write.partitionBy("block").parquet(folder)
    return ItemBlocks(folder, count, window)


def scanner(blocks: ItemBlocks):
    """Function from texts to ``(n_words, n_hit, items)`` per text; tables of a single block are kept."""
    kept = blocks.tables(0) if blocks.count == 1 else None

    def scan(texts: list[str | None]) -> list[tuple[int, int, set[str]]]:
        counts = [0] * len(texts)
        hits: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for number in range(max(1, blocks.count)):
            tables = kept if kept is not None else blocks.tables(number)
            for i, text in enumerate(texts):
                words = words_of(text)
                counts[i] = len(words)
                for patterns in tables:
                    for end, found in patterns.search(words):
                        hits[i].append((end - patterns.length, end))
                        items[i] |= found
        return [(n, covered(spans), found) for n, spans, found in zip(counts, hits, items)]

    return scan


def covered(spans: list[tuple[int, int]]) -> int:
    """Number of positions inside any of the spans."""
    total = reached = 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reached))
        reached = max(reached, end)
    return total


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the list ``items``."""
    blocks = store_items(items, block_bytes=block_bytes)

    def make():
        scan = scanner(blocks)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = scan(batch.column(1).to_pylist())
            named = [sorted(own) for _, _, own in found]
            return pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_words": pa.array([n for n, _, _ in found], pa.int64()),
                "n_hit": pa.array([n for _, n, _ in found], pa.int64()),
                "n_items": pa.array([len(own) for own in named], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(own).encode()).hexdigest() for own in named]),
                "contaminated": pa.array([n > 0 for _, n, _ in found]),
                "items": pa.array(named, pa.list_(pa.string())),
            })

        return step

    return map_batches(
        df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")),
        f"doc_id {dict(df.dtypes)[id_col]}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>",
        make,
    )


def drop_contaminated(df: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text holds no window of any item, with all their columns."""
    blocks, at = store_items(items), df.columns.index(text_col)

    def make():
        scan = scanner(blocks)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([n == 0 for _, n, _ in scan(batch.column(at).to_pylist())]))

        return step

    return map_batches(df, pass_through_schema(df), make)
