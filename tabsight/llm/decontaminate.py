"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: every task turns runs of whole documents into segments, and a segment is one row that holds,
for each term, the sorted list of the term's positions. Positions count on from document to document with a gap between
them, so that one sorted integer list a term says both where and in which document, and a phrase never reaches from one
document into the next. A test window is looked up in a segment by taking its terms from the rarest list to the longest,
moving each list back by the term's offset and keeping the starts that all lists share; the search ends as soon as none is
left. As no posting ever leaves its segment, neither building nor searching shuffles anything, and a term of every document
costs each segment only its own part of the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabsight.llm.common import raw_texts, staged

#: Words of a test window; a shorter item is one window.
WINDOW = 10
#: All words of a window within this many positions of an occurrence of its first, in any order, are a proximity match.
NEAR = 20
#: Words after which a segment is closed; a longer document is a segment of its own.
SEGMENT_WORDS = 1_500_000
#: Test items searched in one pass over the index; more items take more passes.
ITEMS_A_PASS = 50_000

#: Bytes to word bytes: A-Z become lower case, the other ASCII characters but digits and letters become blanks.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Segment:
    """Documents gathered until they are written as one row of the index."""

    def __init__(self, terms: dict[bytes, int] | None):
        self.fixed, self.terms = terms is not None, terms if terms is not None else {}
        self.doc_ids: list = []
        self.starts: list[int] = []
        self.lengths: list[int] = []
        self.ids: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.end = 0

    def add(self, doc_id, text: bytes) -> None:
        words = words_of(text)
        if self.fixed:
            ids = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int32, len(words))
        else:
            ids = np.fromiter((self.terms.setdefault(w, len(self.terms)) for w in words), np.int32, len(words))
        held = np.flatnonzero(ids >= 0)
        self.doc_ids.append(doc_id)
        self.starts.append(self.end)
        self.lengths.append(len(words))
        self.ids.append(ids[held])
        self.at.append(held + self.end)
        self.end += len(words) + NEAR + WINDOW

    def row(self) -> dict:
        ids, at = np.concatenate(self.ids), np.concatenate(self.at)
        order = np.argsort(ids, kind="stable")
        present, first = np.unique(ids[order], return_index=True)
        names = list(self.terms)
        return {
            "doc_ids": self.doc_ids,
            "starts": self.starts,
            "lengths": self.lengths,
            "terms": [names[i] for i in present],
            "begins": first,
            "positions": at[order],
        }


def build_index(docs: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """One row a segment: its number, doc_ids, starts, lengths, terms, begins (of each term's list) and positions.

    ``vocabulary`` (bounded by the caller) leaves out the words that no question will ask for; None stores every word. Null
    and empty texts are documents without words; columns other than doc_id and text are not read.
    """
    terms = None if vocabulary is None else {w: i for i, w in enumerate(vocabulary)}
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema(
        [
            ("doc_ids", pa.list_(pa.string() if kind == "string" else pa.int64())),
            ("starts", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())),
            ("terms", pa.list_(pa.binary())),
            ("begins", pa.list_(pa.int64())),
            ("positions", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(terms)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for start in range(0, batch.num_rows, 256):
                for doc_id, text in zip(doc_ids[start : start + 256], raw_texts(batch.slice(start, 256))):
                    segment.add(doc_id, text)
                    if segment.end >= SEGMENT_WORDS:
                        yield pa.RecordBatch.from_pylist([segment.row()], schema)
                        segment = Segment(terms)
        if segment.doc_ids:
            yield pa.RecordBatch.from_pylist([segment.row()], schema)

    out = f"doc_ids array<{'string' if kind == 'string' else 'bigint'}>, starts array<bigint>, lengths array<bigint>, "
    out += "terms array<binary>, begins array<bigint>, positions array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(run, out).withColumn("segment", F.monotonically_increasing_id())


def windows_of(items: list[tuple[str, bytes]]) -> dict[tuple[bytes, ...], list[str]]:
    """Every distinct window and the items that hold it."""
    found: dict[tuple[bytes, ...], list[str]] = {}
    for item_id, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
            holders = found.setdefault(tuple(words[i : i + WINDOW]), [])
            if not holders or holders[-1] != item_id:
                holders.append(item_id)
    return found


def meet(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The values of ``starts`` that are in the sorted ``positions``."""
    k = np.searchsorted(positions, starts)
    k[k == len(positions)] = 0
    return starts[positions[k] == starts]


def around(positions: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The ``positions`` within ``NEAR`` of one of the ``centres``."""
    k = np.searchsorted(centres, positions - NEAR)
    return positions[(k < len(centres)) & (centres[np.minimum(k, len(centres) - 1)] <= positions + NEAR)]


def search_segment(row: dict, windows: dict[tuple[bytes, ...], list[str]], near: bool) -> Iterator[tuple]:
    """(doc_id, n_words, hit word positions, items with a window, items with a near window) of each document."""
    positions = np.asarray(row["positions"], np.int64)
    ends = [*row["begins"][1:], len(positions)]
    lists = {bytes(t): positions[a:b] for t, a, b in zip(row["terms"], row["begins"], ends)}
    starts = np.asarray(row["starts"], np.int64)
    hits: dict[int, list[np.ndarray]] = {}
    items: dict[int, set] = {}
    close: dict[int, set] = {}
    for window, holders in windows.items():
        found = [lists.get(w) for w in window]
        if any(x is None for x in found):
            continue
        order = sorted(range(len(window)), key=lambda i: len(found[i]))
        rare = found[order[0]]
        at = rare - order[0]
        for i in order[1:]:
            at = meet(at, found[i] - i)
            if not len(at):
                break
        if len(at):
            for d in np.unique(owner := np.searchsorted(starts, at, "right") - 1):
                hits.setdefault(int(d), []).append((at[owner == d][:, None] + np.arange(len(window))).ravel())
                items.setdefault(int(d), set()).update(holders)
        if near:
            at = around(found[0], rare) if order[0] else rare
            for i in order:
                k = np.searchsorted(found[i], at - NEAR)
                inside = k < len(found[i])
                inside[inside] = found[i][k[inside]] <= at[inside] + NEAR
                at = at[inside]
                if not len(at):
                    break
            for d in np.unique(np.searchsorted(starts, at, "right") - 1):
                close.setdefault(int(d), set()).update(holders)
    for d, (doc_id, start, n) in enumerate(zip(row["doc_ids"], row["starts"], row["lengths"])):
        at = np.unique(np.concatenate(hits[d])) - start if d in hits else np.empty(0, np.int64)
        yield doc_id, n, at, items.get(d, set()), close.get(d, set())


def search(index: DataFrame, items: list[tuple[str, bytes]], doc_type: str = "bigint", near: bool = True) -> DataFrame:
    """One row a document: segment and place in it, n_words, hit (positions of hit words), items and near_items (sorted ids)."""
    windows = windows_of(items)
    kind = pa.string() if doc_type == "string" else pa.int64()
    names = ["segment", "place", "doc_id", "n_words", "hit", "items", "near_items"]
    types = [pa.int64(), pa.int64(), kind, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                rows = enumerate(search_segment(row, windows, near))
                while block := list(islice(rows, 4096)):
                    found = [(row["segment"], place, *r[:3], sorted(r[3]), sorted(r[4])) for place, r in block]
                    columns = [pa.array([r[c] for r in found], t) for c, t in enumerate(types)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"segment bigint, place bigint, doc_id {doc_type}, n_words bigint, hit array<bigint>, "
    schema += "items array<string>, near_items array<string>"
    return index.mapInArrow(run, schema)


def item_passes(items: DataFrame, size: int = ITEMS_A_PASS) -> Iterator[list[tuple[str, bytes]]]:
    """The test items in bounded runs, fetched one partition after the other."""
    block: list[tuple[str, bytes]] = []
    for row in items.selectExpr("cast(item_id as string) AS item_id", "cast(text as binary) AS text").toLocalIterator():
        block.append((row.item_id or "", bytes(row.text or b"")))
        if len(block) >= size:
            yield block
            block = []
    if block:
        yield block


def find_contamination(docs: DataFrame, items: DataFrame, near: bool = True, size: int = ITEMS_A_PASS) -> DataFrame:
    """One row a document: doc_id, n_words, hit, items, near_items.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns, also of the same names as the result's, are not
    read. Null and empty texts have no words and no hits, items without words have no window, equal items all count, an empty
    table of items hits nothing; repeated rows and rows without an id are documents of their own. A test set of up to ``size``
    items, the usual case, is searched in one pass over an index of its own words; a larger one in several passes over an
    index of all words, each pass staged and added up by document.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    passes = item_passes(items, size)
    first, second = next(passes, []), next(passes, None)
    vocabulary = sorted({w for _, text in first for w in words_of(text)}) if second is None else None
    index = staged(build_index(docs, vocabulary), "postings")
    columns = ["doc_id", "n_words", "hit", "items", "near_items"]
    if second is None:
        return search(index, first, doc_type, near).select(columns)
    parts = [staged(search(index, block, doc_type, near), "found") for block in chain([first, second], passes)]
    flat = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = reduce(DataFrame.unionAll, parts).groupBy("segment", "place")
    return merged.agg(*[F.first(c).alias(c) for c in columns[:2]], *[flat(c) for c in columns[2:]]).select(columns)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any word inside a test window; the text decides, whatever the doc_id."""
    key = F.concat(F.hex(F.xxhash64("text")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "text")))
    found = find_contamination(docs.select(key.alias("doc_id"), "text"), items, near=False)
    hit = found.where(F.size("hit") > 0).select(F.col("doc_id").alias("key")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = docs.select(row.alias("row"), key.alias("key")).join(hit, "key", "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what ``find_contamination`` returns."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )

