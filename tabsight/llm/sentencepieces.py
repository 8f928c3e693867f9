"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model crosses from a word into a whitespace marker, so a text falls apart at the markers: a chunk is a run
of markers and the characters up to the next one, merges never reach over its ends, and equal chunks get equal ids. Every
task keeps one table chunk -> ids, segments the chunks that a slice of texts brings for the first time, each once, and joins
ids and surfaces back by position. A table for the whole corpus would need every position of every text shuffled twice; the
task's table needs none, holds ``TABLE_CHUNKS`` entries at most and starts anew when full, which costs time and no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tabsight.llm.common import sha, slices

#: Entries of a task's chunk table before it starts anew.
TABLE_CHUNKS = 700_000
#: A longer chunk is segmented wherever it occurs, so that the table's bytes are bounded as well.
LONG_CHUNK = 128

MARK = "▁"
RUN = re.compile(f"{MARK}+[^{MARK}]*")


def chunks_of(text: str) -> list[str]:
    """The chunks of a text behind the one marker that is put in front of it, each without its first marker."""
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    return [c[1:].replace(MARK, " ") for c in RUN.findall(MARK + text.replace(" ", MARK))]


class ChunkTable:
    """Segments distinct chunks with the library's own processor."""

    def __init__(self, model: bytes, size: int = TABLE_CHUNKS):
        from sentencepiece import SentencePieceProcessor

        self.processor = sp = SentencePieceProcessor(model_proto=model)
        if any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
            raise ValueError("a piece of this model crosses a whitespace marker; its texts cannot be cut into chunks")
        if sp.decode(sp.encode("a  b ")) != "a  b " or sp.encode("a") != sp.encode(" a")[-1:]:
            raise ValueError("only models that keep all white space and put one marker in front are supported")
        self.size = size
        self.ids: dict[str, str] = {}
        #: Surfaces of the chunks that decode to something else than themselves.
        self.shown: dict[str, str] = {}

    def _add(self, chunks: list[str]) -> None:
        ids = self.processor.encode(chunks, num_threads=1)
        if "" in chunks:  # one marker alone
            ids[chunks.index("")] = [self.processor.piece_to_id(MARK)]
        self.ids.update(zip(chunks, [",".join(map(str, x)) for x in ids]))
        self.shown.update((c, s) for c, s in zip(chunks, self.processor.decode(ids, num_threads=1)) if s != c)

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        cut = [chunks_of(t) if t else [] for t in texts]
        known = self.ids
        if fresh := {c for chunks in cut for c in chunks if c not in known}:
            if len(known) + len(fresh) > self.size:
                self.ids, self.shown = {}, {}
                fresh = {c for chunks in cut for c in chunks}
            self._add(list(fresh))
        ids, shown = self.ids, self.shown
        for chunks in cut:
            joined = ",".join([ids[c] for c in chunks])
            yield joined.count(",") + 1 if chunks else 0, joined, " ".join([shown.get(c, c) for c in chunks] if shown else chunks)
        for c in fresh:
            if len(c) > LONG_CHUNK:
                del self.ids[c]
                self.shown.pop(c, None)


def encode_decode(docs: DataFrame, model_path: str, keep_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded text.

    Null and empty texts have no ids. Equal texts get equal results; other columns are not read. An empty table gives an
    empty result. The model file is read once on the driver (half a megabyte) and travels with the task.
    """
    with open(model_path, "rb") as file:
        model = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = None
        for batch in batches:
            chunks = chunks or ChunkTable(model)
            for part in slices(batch):
                rows = list(chunks([x or "" for x in part.column("text").to_pylist()]))
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([n for n, _, _ in rows], pa.int64()),
                    "ids_sha256": pa.array([sha(ids) for _, ids, _ in rows], pa.string()),
                    "decoded_sha256": pa.array([sha(text) for _, _, text in rows], pa.string()),
                }
                if keep_text:
                    columns["ids"] = pa.array([ids for _, ids, _ in rows], pa.string())
                    columns["decoded"] = pa.array([text for _, _, text in rows], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids string, decoded string" * keep_text)
