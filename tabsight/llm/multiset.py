"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs, the pieces between line breaks. Every paragraph has a wide vector, and the
fingerprint of a text is the sum of its paragraphs' vectors, lane by lane modulo a power of two. So the order of paragraphs
does not matter, ``a + "\\n" + b`` has the sum of both fingerprints, and a paragraph is inserted or deleted by adding or
subtracting its vector, without the rest of the text.

A vector has two kinds of lanes:

* ``WIDE`` lanes modulo 2^64, uniform values from the 128-bit hash of the paragraph: different multisets agree in all of them
  with probability 2^-512. They tell equality. (No protection against somebody who constructs collisions.)
* ``SIGNS`` lanes modulo 2^16, for each short piece of the paragraph plus or minus one by a bit of its hash. The scalar
  product of two such sums estimates that of the pieces' counts, so they tell likeness, with a standard error of about
  sqrt(2 / SIGNS), 0.09 at most. Counts beyond 32 767 of one piece wrap around.

The likeness of two fingerprints estimates 2 A.B / (A.A + B.B) of their pieces' counts A and B, cut to 0..1, and is 1 if they
are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import raw_texts, slices, staged

WIDE, SIGNS = 8, 256
#: Bytes of a fingerprint.
BYTES = WIDE * 8 + SIGNS * 2
#: Hashes expanded at once.
BLOCK = 1 << 15
#: Keys whose partial sums a task holds; the second level of a sum by key has so many parts.
HELD_KEYS, PARTS = 4096, 64

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def expanded(digests: list[bytes], words: int) -> np.ndarray:
    """``words`` 64-bit words of each 128-bit digest, by counter."""
    halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    steps = np.arange(1, words + 1, dtype=np.uint64) * _GOLD
    return mixed(mixed(halves[:, :1] + steps) ^ halves[:, 1:])


def pieces(paragraph: bytes) -> list[bytes]:
    """Overlapping pieces of a paragraph, each from one cut to the next but one, about six words. Cuts are the blanks that
    follow a byte divisible by three, so that equal stretches are cut alike wherever they stand; blank pieces do not count."""
    letters = np.frombuffer(paragraph, np.uint8)
    cuts = np.flatnonzero((letters[1:] == 32) & (letters[:-1] % 3 == 0)) + 1
    bounds = [0, *cuts.tolist(), len(paragraph)]
    return [s for a, b in zip(bounds, bounds[2:] or bounds[1:]) if (s := paragraph[a:b]) and not s.isspace()]


def _added(out: np.ndarray, owner: Sequence[int], digests: list[bytes], words: int, bits: bool) -> None:
    """Add to row ``owner`` of ``out`` what each digest expands to; owners ascend."""
    owner = np.asarray(owner, np.int64)
    for start in range(0, len(digests), BLOCK):
        own = owner[start : start + BLOCK]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        values = expanded(digests[start : start + BLOCK], words)
        if bits:
            ones = np.add.reduceat(np.unpackbits(values.view(np.uint8), axis=1), first, axis=0, dtype=np.int32)
            count = np.diff(np.append(first, len(own)))[:, None]
            out[own[first]] += (2 * ones - count).astype(np.int16)
        else:
            out[own[first]] += np.add.reduceat(values, first, axis=0)


class Prints:
    """Fingerprints of many texts: ``wide`` (n, WIDE) and ``signs`` (n, SIGNS), to be added and subtracted."""

    def __init__(self, wide: np.ndarray, signs: np.ndarray):
        self.wide, self.signs = wide, signs

    @classmethod
    def of(cls, groups: list[list[bytes]]) -> Prints:
        """The sums of the vectors of each group of paragraphs."""
        out = cls(np.zeros((len(groups), WIDE), np.uint64), np.zeros((len(groups), SIGNS), np.int16))
        digest = xxhash.xxh3_128_digest
        _added(out.wide, [g for g, ps in enumerate(groups) for _ in ps], [digest(p) for ps in groups for p in ps], WIDE, False)
        parts = [(g, digest(s, 1)) for g, ps in enumerate(groups) for p in ps for s in pieces(p)]
        _added(out.signs, [g for g, _ in parts], [d for _, d in parts], SIGNS // 64, True)
        return out

    @classmethod
    def read(cls, raw: list[bytes]) -> Prints:
        table = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, BYTES)
        cut = WIDE * 8
        return cls(np.ascontiguousarray(table[:, :cut]).view(np.uint64), np.ascontiguousarray(table[:, cut:]).view(np.int16))

    def raw(self) -> list[bytes]:
        return [a.tobytes() + b.tobytes() for a, b in zip(self.wide, self.signs)]

    def __add__(self, other: Prints) -> Prints:
        return Prints(self.wide + other.wide, self.signs + other.signs)

    def __sub__(self, other: Prints) -> Prints:
        return Prints(self.wide - other.wide, self.signs - other.signs)

    def __getitem__(self, rows) -> Prints:
        return Prints(self.wide[rows], self.signs[rows])

    def times(self, counts: np.ndarray) -> Prints:
        return Prints(self.wide * counts.astype(np.uint64)[:, None], self.signs * counts.astype(np.int16)[:, None])

    def likeness(self, other: Prints) -> np.ndarray:
        a, b = self.signs.astype(np.float64), other.signs.astype(np.float64)
        size = (a * a).sum(axis=1) + (b * b).sum(axis=1)
        share = 2 * (a * b).sum(axis=1) / np.maximum(size, 1)
        same = (self.wide == other.wide).all(axis=1) & (self.signs == other.signs).all(axis=1)
        return np.where(same, 1.0, np.clip(share, 0, 1))


def paragraphs(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print binary) of every row of ``docs`` (doc_id, text); null is the empty text, one empty paragraph.

    Repeated rows have a fingerprint each, ids may be null and of any type, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = Prints.of([paragraphs(t) for t in raw_texts(part)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.raw(), pa.binary())], ["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, print binary")


def _sum_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([v.raw()[0] for v in held.values()], pa.binary())], ["key", "print"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("key").type
        if batch.num_rows:
            prints = Prints.read(batch.column("print").to_pylist())
            for i, key in enumerate(batch.column("key").to_pylist()):
                held[key] = held[key] + prints[i : i + 1] if key in held else prints[i : i + 1]
        if len(held) > HELD_KEYS:
            yield out()
            held.clear()
    if held:
        yield out()


def total(prints: DataFrame, key: str) -> DataFrame:
    """(key, print): the sum of the fingerprints of each value of ``key``, which is that of all its paragraphs together.

    Sums are taken inside the tasks first, then by (key, part), then by key, so a key with a third of all rows is only a few
    rows when they meet. Null is a key of its own.
    """
    kind = prints.schema[key].dataType.simpleString()

    def gathered(table: pa.Table) -> pa.Table:
        got = Prints.read(table.column("print").to_pylist())
        sums = Prints(got.wide.sum(axis=0, keepdims=True, dtype=np.uint64), got.signs.sum(axis=0, keepdims=True, dtype=np.int16))
        return table.slice(0, 1).set_column(table.schema.get_field_index("print"), "print", pa.array(sums.raw(), pa.binary()))

    partial = prints.select(F.col(key).alias("key"), "print").mapInArrow(_sum_by_key, f"key {kind}, print binary")
    parted = partial.withColumn("part", F.pmod(F.xxhash64("print"), F.lit(PARTS)))
    halves = parted.groupBy("key", "part").applyInArrow(gathered, f"key {kind}, print binary, part long")
    return halves.drop("part").groupBy("key").applyInArrow(gathered, f"key {kind}, print binary").withColumnRenamed("key", key)


def changed(prints: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, print) after ``edits`` (doc_id, paragraph, times): positive times insert copies of a paragraph, negative
    delete; texts are not read. Edits of a document without a fingerprint start from nothing; null paragraphs are empty,
    null times zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "paragraph"):
                times = np.array([t or 0 for t in part.column("times").to_pylist()], np.int64)
                vectors = Prints.of([paragraphs(p) for p in raw_texts(part, "paragraph")]).times(times)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(vectors.raw(), pa.binary())], ["doc_id", "print"])

    kind = prints.schema["doc_id"].dataType.simpleString()
    deltas = edits.select("doc_id", "paragraph", F.col("times").cast("long").alias("times")).mapInArrow(run, f"doc_id {kind}, print binary")
    return total(prints.select("doc_id", "print").unionAll(deltas), "doc_id")


# --- every document against its edited text and its successor ------------------------------------------------------------------


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_UTF8 = "utf-8", "surrogateescape"
RESULT = "n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double"
#: A row that lacks its successor has no result and its text in ``tail``; a slice's first row has it in ``head`` as well.
EDGES = "slice long, head string, tail string"


def _compared(texts: list[bytes], following: list[bytes]) -> list[pa.Array]:
    """The result columns. The edited text's fingerprint is the old one less the paragraphs that go plus those that come."""
    plain = [t.decode(*_UTF8) for t in texts]
    new = [edited(t, f.decode(*_UTF8)).encode(*_UTF8) for t, f in zip(plain, following)]
    stays = [t[: len(t) - len(t) // 2].count("\n") for t in plain]
    before, after = [paragraphs(t) for t in texts], [paragraphs(t) for t in new]
    kept = Prints.of([p[:n] for p, n in zip(before, stays)])
    gone = Prints.of([p[n:] for p, n in zip(before, stays)])
    come = Prints.of([p[n:] for p, n in zip(after, stays)])
    own = kept + gone
    then = own - gone + come
    # The next text's fingerprint is already there, but for the last row.
    other = Prints.of([paragraphs(following[-1])])
    other = Prints(np.concatenate([own.wide[1:], other.wide]), np.concatenate([own.signs[1:], other.signs]))
    return [
        pa.array(map(len, plain), pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in new]),
        pa.array(own.raw(), pa.binary()),
        pa.array(then.raw(), pa.binary()),
        pa.array(own.likeness(then)),
        pa.array(own.likeness(other)),
    ]


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a slice in order: each is compared with the next; the last waits for the next slice's first."""
    number, names = TaskContext.get().partitionId(), [c.split()[0] for c in f"{RESULT}, {EDGES}".split(", ")]
    head = last = None
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            ids = part.column("doc_id")
            texts = raw_texts(part)
            first = last is None
            if first:
                head = texts[0]
            else:
                ids, texts = pa.concat_arrays([last[0], ids]), [last[1], *texts]
            last = ids.slice(len(ids) - 1), texts[-1]
            if n := len(texts) - 1:
                empty = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays([ids.slice(0, n), *_compared(texts[:-1], texts[1:]), *empty], ["doc_id", *names])
    if last is not None:
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        edge = [pa.array([number], pa.int64()), *[pa.array([x], pa.binary()).cast(pa.string(), safe=False) for x in (head, last[1])]]
        yield pa.RecordBatch.from_arrays([last[0], *none, *edge], ["doc_id", *names])


def compare_with_edits(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, print, edited_print, near_edited, near_next.

    The next document is the one that follows in descending doc_id, nulls last, equal ids by the hash of their text; after
    the last comes the first. One range shuffle brings neighbours together, each slice streams through a task in order, and
    its last row, which waits for the first of the next slice, is finished by a join of one row a slice. Null texts are empty;
    an empty table gives an empty result; a single row follows itself. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = texts.repartitionByRange(partitions, *order) if partitions else texts.repartitionByRange(*order)
    rows = staged(ranged.sortWithinPartitions(*order).mapInArrow(_along, f"doc_id {kind}, {RESULT}, {EDGES}"), "fingerprints")
    names = ["doc_id", *[c.split()[0] for c in RESULT.split(", ")]]

    # One number a slice on the driver: which slice follows which.
    numbers = sorted(r.slice for r in rows.where("slice is not null").select("slice").collect())
    following = dict(zip(numbers, numbers[1:] + numbers[:1]))
    pairs = rows.sparkSession.createDataFrame(list(following.items()), "slice long, following long")
    edges = rows.where("slice is not null")
    heads = edges.select(F.col("slice").alias("following"), "head")
    met = edges.select("doc_id", "slice", "tail").join(pairs, "slice").join(heads, "following").select("doc_id", "tail", "head")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                columns = _compared(raw_texts(one, "tail"), raw_texts(one, "head"))
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), *columns], names)

    return rows.where("slice is null").select(*names).unionAll(met.mapInArrow(finish, f"doc_id {kind}, {RESULT}"))


def shown(print_: str) -> Column:
    return F.lower(F.hex(print_))


def digest(compared: DataFrame) -> DataFrame:
    """The columns of the query."""
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", shown("print").alias("fingerprint"), shown("edited_print").alias("edited_fingerprint"), "near_edited", "near_next"
    )
