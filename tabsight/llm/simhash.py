"""SimHash near-duplicates by anchor points of a covering code.

**Anchors.** The 64 bits fall into nine blocks of seven and one single bit. Each block is covered by the perfect [7,4]
Hamming code (covering radius 1), the single bit by itself, so the anchors are the 2^37 words of the product code, the
covering radius is 9, and every 64-bit word has exactly one nearest anchor, its home, read off block by block from a table.

**Replication.** Two fingerprints link at 2 or fewer differing bits exactly if some word z differs from both in at most one
bit. z has a home anchor, and that anchor lies within the covering radius plus one bit of either fingerprint. So a
fingerprint goes to the homes of the 65 words within one bit of it (about 25 anchors), and every linked pair meets at the
home of its z. Anchors farther out, up to radius plus the whole threshold, could add no pair by this triangle inequality.

**Comparing.** At an anchor that two or more different fingerprints reach, each brings its words z whose home the anchor is.
Fingerprints with a z in common are the linked ones, and a z has at most 65 different fingerprints around it, so no group is
unbounded and no list of all pairs is made: a chain through the 65 links them. Copies count once: everything after the
first step works on distinct fingerprints, so a group of a third of all rows is one row here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tabsight.llm.common import links_to_labels, raw_texts, staged

SHINGLE_WORDS = 3
SEED = 42
LINK_BITS = 2


def shingle_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()  # of bytes: A-Z only, and blanks 0x20 and 0x09 to 0x0D only
    if not words:
        return np.empty(0, np.uint64)
    k = min(SHINGLE_WORDS, len(words))
    grams = zip(*[words[i:] for i in range(k)])
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(g), SEED) for g in grams), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; no hashes give zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[start : start + 65536]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row; null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                fps = np.array([fingerprint(shingle_hashes(t)) for t in raw_texts(part)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _nearest_codewords() -> np.ndarray:
    """The [7,4] Hamming codeword nearest to each 7-bit word: flip the bit that the syndrome names."""
    words = np.arange(128)
    syndrome = np.zeros(128, np.int64)
    for bit in range(7):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    return np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words).astype(np.uint64)


NEAREST = _nearest_codewords()


def homes(words: np.ndarray) -> np.ndarray:
    """The nearest anchor of each 64-bit word."""
    out = words & np.uint64(1 << 63)
    for block in range(9):
        shift = np.uint64(7 * block)
        out |= NEAREST[(words >> shift & np.uint64(127)).astype(np.int64)] << shift
    return out


def near_words(fps: np.ndarray) -> np.ndarray:
    """The 65 words within one bit of each fingerprint, one row a fingerprint."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    return fps[:, None] ^ flips[None, :]


def _reach(with_words: bool):
    """mapInArrow: fingerprints to (anchor, fp), or (anchor, fp, z) with every z at its home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                fps = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                words = near_words(fps)
                anchors = homes(words)
                if with_words:
                    at = part.column("anchor").to_numpy(zero_copy_only=False).view(np.uint64)
                    i, j = np.nonzero(anchors == at[:, None])
                    columns, names = [fps[i], words[i, j]], ["fp", "z"]
                else:
                    anchors = np.sort(anchors, axis=1)
                    new = np.ones(anchors.shape, bool)
                    new[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
                    i, j = np.nonzero(new)
                    columns, names = [fps[i], anchors[i, j]], ["fp", "anchor"]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names)

    return run


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``distinct`` fingerprints (fp) within two bits."""
    reach = staged(distinct.select("fp").mapInArrow(_reach(False), "fp long, anchor long"), "anchors")
    crowded = reach.groupBy("anchor").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("anchor")
    met = reach.join(crowded, "anchor").select("fp", "anchor")
    around = met.mapInArrow(_reach(True), "fp long, z long").groupBy("z").agg(F.sort_array(F.collect_set("fp")).alias("fps"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("fps") - 1), lambda i: F.struct(F.col("fps")[0].alias("a"), F.col("fps")[i].alias("b")))
    links = around.where(F.size("fps") > 1).select(F.inline(pairs)).distinct()
    return links.where(F.bit_count(F.expr("a ^ b")) <= LINK_BITS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs`` (doc_id long, text): doc_id, fp and component_id, the smallest doc_id it is linked to.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows have the same component; rows
    with a null doc_id get the component of their fingerprint (null if it has no other row). Other columns are not read; an
    empty table gives an empty result.
    """
    prints = staged(fingerprints(docs), "fingerprints")
    classes = component_classes(prints)
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def component_classes(prints: DataFrame) -> DataFrame:
    """(fp, label, component_id) of the fingerprints of ``prints`` (doc_id, fp): one label and smallest doc_id a component."""
    owners = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("owner")), "owners")
    labels = links_to_labels(fingerprint_links(owners), "simhash")
    placed = owners.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "owner", "label")
    tops = placed.where("label is not null").groupBy("label").agg(F.min("owner").alias("top"))
    both = placed.join(tops, "label", "left")
    return both.select("fp", F.coalesce("label", "fp").alias("label"), F.when(F.col("label").isNull(), F.col("owner")).otherwise(F.col("top")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component: that with the smallest doc_id, nulls last, then by a hash of id and text.

    Repeated rows are one document, of which one row stays. The hash joins back, so a component of a third of all rows is
    no hot key.
    """
    key = F.struct("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))
    prints = staged(fingerprints(docs.select(key.alias("doc_id"), "text")).select("doc_id.*", "fp"), "fingerprints")
    classes = component_classes(prints.select("doc_id", "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    firsts = prints.groupBy("fp").agg(F.min(order).alias("first"))  # copies are one row from here on
    kept = firsts.join(classes, "fp").groupBy("label").agg(F.min("first").alias("first")).select("first.k1", "first.k2")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), key["k1"].alias("k1"), key["k2"].alias("k2")).join(kept, ["k1", "k2"], "left_semi")
    if not prints.groupBy("k1", "k2").count().where("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(["k1", "k2"])
    return keyed.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
