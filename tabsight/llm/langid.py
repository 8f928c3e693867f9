"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's subwords are its byte 2- to 4-grams (of the text without ASCII digits, signs and case, runs of them as one blank),
hashed into buckets. The model averages the buckets' embeddings and puts a linear softmax on the average; both are trained
together by stochastic gradient descent in numpy on a bounded sample of labelled rows. As the layer above the average is
linear, prediction folds embeddings and layer into one row of class scores a bucket, and a whole text of any length is a sum
over its subwords in blocks. Temperature and rejection threshold are set on part of the sample that the training never saw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import raw_texts

UNKNOWN = "und"
BUCKETS = 1 << 16
WIDTH = 16
GRAMS = (2, 3, 4)
#: Labelled rows of each language that the fit reads, about, whatever their length.
ROWS_A_LANGUAGE = 600
#: More languages than this are taken for an error in the labels.
LANGUAGES = 400
EPOCHS = 6
RATE = 0.5
#: Share of right calibration rows that rejection may lose.
LOSS = 0.01
BLOCK_BYTES = 1 << 20

LETTER = regex.compile(r"\p{L}")
#: A-Z to lower case; other ASCII that is no letter to blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def subwords(text: bytes) -> np.ndarray:
    """Bucket of every subword of (a block of) a text."""
    data = b" ".join((b"", *text.translate(FOLD).split(), b""))
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    found, h = [], (x ^ np.uint32(0x811C9DC5)) * np.uint32(0x01000193)
    for n in range(2, max(GRAMS) + 1):
        if len(x) < n:
            break
        h = (h[:-1] ^ x[n - 1 :]) * np.uint32(0x01000193)  # the hash of n bytes goes on from that of n - 1
        if n in GRAMS:
            found.append((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


@dataclass
class Model:
    languages: list[str]
    #: Class scores of each bucket: embedding times layer, over the temperature.
    scores: np.ndarray
    bias: np.ndarray
    threshold: float

    def predict(self, text: bytes) -> tuple[str, float]:
        total, n = np.zeros(len(self.languages)), 0
        for start in range(0, len(text), BLOCK_BYTES):
            at = subwords(text[start : start + BLOCK_BYTES])
            total += self.scores[at].sum(axis=0, dtype=np.float64)
            n += len(at)
        z = total / max(n, 1) + self.bias
        e = np.exp(z - z.max())
        best = int(z.argmax())
        return self.languages[best], float(e[best] / e.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, bytes]], seed: int = 11) -> Model | None:
    """Train on (language, text) pairs; a tenth of them, by position in the given order, is kept for calibration."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    code = {lang: i for i, lang in enumerate(languages)}
    y = np.array([code[lang] for lang, _ in rows])
    at = [subwords(text) for _, text in rows]
    held = np.arange(len(rows)) % 10 == 9
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    train = np.flatnonzero(~held)
    mean = lambda i: embed[at[i]].mean(axis=0) if len(at[i]) else np.zeros(WIDTH, np.float32)
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for block in np.array_split(draw.permutation(train), max(1, len(train) // 16)):
            h = np.stack([mean(i) for i in block])
            error = _softmax(h @ layer + bias)
            error[np.arange(len(block)), y[block]] -= 1
            back = error @ layer.T
            layer -= rate * (h.T @ error) / len(block) * 8
            bias -= rate * error.mean(axis=0)
            for i, g in zip(block, back):
                if len(at[i]):
                    buckets, n = np.unique(at[i], return_counts=True)
                    embed[buckets] -= (rate * 40 / len(at[i])) * n[:, None] * g
    check = np.flatnonzero(held) if held.any() else train
    z = (np.stack([mean(i) for i in check]) @ layer + bias).astype(np.float64)
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in (0.25, 0.5, 0.75, 1, 1.5, 2, 3, 5)}
    heat = min(loss, key=loss.get)
    p = _softmax(z / heat)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    threshold = float(np.quantile(right, LOSS)) if len(right) else 0.0
    return Model(languages, (embed @ layer / heat).astype(np.float32), bias / heat, threshold)


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def labelled_sample(docs: DataFrame, rows: int = ROWS_A_LANGUAGE) -> list[tuple[str, bytes]]:
    """About ``rows`` learnable rows of each language, picked by a hash of the id: bounded by rows and languages."""
    learnable = docs.where(
        F.col("lang").isNotNull()
        & F.col("text").rlike(r"\p{L}")
        & (fold_of(F.col("doc_id")) != 0)
    )
    counts = learnable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = F.lit(False)
    for r in counts:
        picked = picked | ((F.col("lang") == r["lang"]) & (draw < rows / r["count"]))
    found = learnable.where(picked).select("lang", F.encode("text", "UTF-8").alias("text"), F.xxhash64("doc_id").alias("o"))
    return [(r["lang"], bytes(r["text"])) for r in found.orderBy("o", "lang", "text").limit(2 * rows * len(counts)).collect()]


def identify(docs: DataFrame, rows: int = ROWS_A_LANGUAGE) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, accepted.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if there is nothing to learn from.
    ``accepted`` is false where the calibrated probability is under the rejection threshold. Repeated texts get the same
    prediction; rows with a null doc_id are predicted but never learned from; other columns are not read.
    """
    model = fit(labelled_sample(docs, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = []
                for text in raw_texts(part):
                    known = model is not None and LETTER.search(text.decode("utf-8", "replace"))
                    found.append(model.predict(text) if known else (UNKNOWN, 0.0))
                columns = [part.column("doc_id"), pa.array([lang for lang, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                accepted = [lang != UNKNOWN and s >= model.threshold for lang, s in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
