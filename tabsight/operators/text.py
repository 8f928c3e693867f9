"""TF-IDF and its truncated SVD. Fitted on training rows, applied anywhere.

The long form (document, term, weight) is plain DataFrame work. The dense form, used inside a recipe,
looks terms up in a vocabulary of bounded size and multiplies by the fitted topics, one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsight.functions import text as X
from tabsight.session import pin, spread

# Limits.
MAX_TERMS = 30_000
MIN_DOCUMENTS = 3
TOPICS = 120
_OVERSAMPLE = 10
_POWER_PASSES = 5
_DOCUMENT_BLOCK = 128
#: Tokens whose terms are counted at once.
SLICE_TOKENS = 2_000_000


def documents(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _slices(words: pa.Array, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE_TOKENS`` tokens, cut only at ``starts``."""
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths) - lengths)[starts] // SLICE_TOKENS
    first = starts[np.flatnonzero(np.diff(group, prepend=-1))]
    return zip(first.tolist(), np.append(first[1:], len(words)).tolist())


def _counted(words: pa.Array, owner: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of token lists, and by owner of a list which of them it has (by number) and how often.

    Terms are tokens and bigrams of neighbours. Tokens are numbered once, so that text is made of distinct bigrams only.
    """
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    code, single = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    n = len(single)
    left = np.flatnonzero(row[1:] == row[:-1])
    distinct, at = np.unique(np.concatenate([code, n + code[left] * n + code[left + 1]]), return_inverse=True)
    pairs = distinct[n:] - n
    double = pc.binary_join_element_wise(single.take(pa.array(pairs // max(n, 1))), single.take(pa.array(pairs % max(n, 1))), " ")
    whose = owner[np.concatenate([row, row[left]])]
    found, tf = np.unique(whose * max(len(distinct), 1) + at, return_counts=True)
    return pa.concat_arrays([single, double]), *np.divmod(found, max(len(distinct), 1)), tf


def corpus_counts(df: DataFrame, text: str) -> DataFrame:
    """(term, df, total) without grouping by document: a row's own distinct terms say which documents have a
    term, so only (term, counts) rows are shuffled, after combining on the map side."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            for lo, hi in _slices(words, np.arange(len(words))):
                terms, _, at, tf = _counted(words.slice(lo, hi - lo), np.arange(hi - lo))
                counts = [np.bincount(at, minlength=len(terms)), np.bincount(at, tf, len(terms)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([terms, *map(pa.array, counts)], ["term", "df", "total"])

    counted = spread(df.select(text)).select(X.tokens(F.col(text)).alias("words")).mapInArrow(count, "term string, df long, total long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary(per_term: DataFrame, n_documents: DataFrame, max_terms: int = MAX_TERMS, min_df: int = MIN_DOCUMENTS) -> DataFrame:
    """(term, idf): at most ``max_terms`` terms by corpus frequency. ``n_documents`` is a one-row count."""
    # terms that are frequent enough come first; the rest are used only when no term is
    enough = F.col("df") >= min_df
    kept = per_term.orderBy(enough.desc(), F.col("total").desc(), "term").limit(max_terms)
    best = F.max("df").over(Window.partitionBy(F.lit(1)))  # over at most max_terms rows
    kept = kept.withColumn("_best", best).where(enough | (F.col("_best") < min_df))
    n = F.broadcast(n_documents.select(F.col("n").alias("_n"), F.lit(1).alias("_k")))
    idf = F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1
    return kept.withColumn("_k", F.lit(1)).join(n, "_k").select("term", idf.alias("idf"))


@dataclass
class Tfidf:
    """Fitted vocabulary and weights, long form."""

    key: str
    text: str
    vocab: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, key: str, text: str, max_terms: int = MAX_TERMS, min_df: int = MIN_DOCUMENTS) -> Tfidf:
        n = df.agg(F.count(F.lit(1)).alias("n"))
        return cls(key, text, pin(vocabulary(corpus_counts(df, text), n, max_terms, min_df)))

    def transform(self, df: DataFrame) -> DataFrame:
        """(key, term, weight), unit length per document. Whole texts are placed by key, so only the text itself crosses
        the network, and rows of one key are one document. The vocabulary is bounded, so it is broadcast."""
        spark, key = df.sparkSession, self.key
        vocab = self.vocab.collect()  # bounded by max_terms
        shared = spark.sparkContext.broadcast(([r["term"] for r in vocab], np.array([r["idf"] for r in vocab], dtype=float)))

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, idf = pa.array(shared.value[0], pa.string()), shared.value[1]

            def weights(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
                owner = np.repeat(starts, np.diff(starts, append=rows.num_rows))
                for lo, hi in _slices(rows.column(1), starts):
                    who, cols, vals = _unit(rows.column(1).slice(lo, hi - lo), owner[lo:hi], names, idf)
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(who)), names.take(pa.array(cols)), pa.array(vals)], [key, "term", "weight"])

            rest = None
            for batch in batches:
                rows = batch if rest is None else pa.concat_batches([rest, batch])
                code = rows.column(0).dictionary_encode("encode").indices.to_numpy()
                starts = np.flatnonzero(np.diff(code, prepend=-1))
                # the last key may go on in the next batch
                last = int(starts[-1]) if len(starts) else 0
                rest = rows.slice(last)
                yield from weights(rows.slice(0, last), starts[:-1])
            if rest is not None and rest.num_rows:
                yield from weights(rest, np.zeros(1, np.int64))

        slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = df.select(key, self.text).repartition(slices, F.col(key)).sortWithinPartitions(key)
        kind = df.schema[key].dataType.simpleString()
        return placed.select(key, X.tokens(F.col(self.text)).alias("words")).mapInArrow(weigh, f"`{key}` {kind}, term string, weight double")


def _unit(words: pa.Array, owner: np.ndarray, names: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, term number in the vocabulary and weight, owner by owner; an owner's weights have unit length."""
    terms, who, at, tf = _counted(words, owner)
    cols = pc.index_in(terms, names).fill_null(-1).to_numpy()[at]
    known = cols >= 0
    who, cols, tf = who[known], cols[known], tf[known]
    vals = (1 + np.log(tf)) * idf[cols]
    return who, cols, vals / np.sqrt(np.bincount(who, vals * vals)[who])


def _rows(words: pa.Array, names: pa.Array, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number, term numbers and weights of each token list that has a term of the vocabulary."""
    for lo, hi in _slices(words, np.arange(len(words))):
        who, cols, vals = _unit(words.slice(lo, hi - lo), np.arange(lo, hi), names, idf)
        first = np.flatnonzero(np.diff(who, prepend=-1))
        yield from zip(who[first].tolist(), np.split(cols, first[1:]), np.split(vals, first[1:])) if len(who) else ()


@dataclass
class TextTopics:
    """Dense text features: topics when the vocabulary is wider than the target width, else the terms."""

    words: list[str]
    idf: np.ndarray
    topics: np.ndarray | None
    kind: str

    @property
    def width(self) -> int:
        return len(self.words) if self.topics is None else self.topics.shape[1]

    @classmethod
    def fit(cls, df: DataFrame, text: str, topics: int = TOPICS, max_terms: int = MAX_TERMS, seed: int = 42) -> TextTopics:
        n_docs = df.count()
        vocab = Tfidf.fit(df, "", text, max_terms).vocab.orderBy("term").collect()  # bounded by max_terms
        words = [row["term"] for row in vocab]
        idf = np.array([row["idf"] for row in vocab], dtype=float)
        width = min(topics, n_docs - 1)
        if width < 1 or len(words) <= width:
            return cls(words, idf, None, "term")
        return cls(words, idf, _subspace(df, text, words, idf, width, seed), "topic")

    def transform(self, df: DataFrame, text: str, name: str) -> DataFrame:
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast((self.words, self.idf, self.topics))
        width = self.width

        @F.pandas_udf("array<double>")
        def project(batch: pd.Series) -> pd.Series:
            words, idf, topics = shared.value
            out = list(np.zeros((len(batch), width)))
            for i, cols, vals in _rows(pa.array(batch, pa.list_(pa.string())), pa.array(words, pa.string()), idf):
                if topics is not None:
                    out[i] = vals @ topics[cols]
                else:
                    out[i][cols] = vals
            return pd.Series(out, dtype=object)

        return spread(df).withColumn(name, project(X.tokens(F.col(text))))


def _subspace(df: DataFrame, text: str, words: list[str], idf: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Right singular vectors by randomised subspace iteration (Halko, Martinsson and Tropp, 2011).

    Texts become sparse rows once and are persisted. Each pass multiplies the Gram matrix by a thin block:
    tasks add up their own rows, and the partial blocks, whose size depends on vocabulary and width only, are
    summed by a tree of tasks.
    """
    context = df.sparkSession.sparkContext
    shared = context.broadcast((words, idf))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = pa.array(shared.value[0], pa.string()), shared.value[1]
        for batch in batches:
            rows = list(_rows(batch.column(0), names, weights))
            columns = [pa.array([r[i] for r in rows], pa.list_(t)) for i, t in ((1, pa.int32()), (2, pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["cols", "vals"])

    matrix = spread(df.select(text)).select(X.tokens(F.col(text)).alias("words")).mapInArrow(sparse, "cols array<int>, vals array<double>").persist()
    thin = min(len(words), width + _OVERSAMPLE)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(words), thin)))

    def gram_times(block: np.ndarray) -> np.ndarray:
        block_shared = context.broadcast(block)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b = block_shared.value
            total = np.zeros_like(b)
            for frame in batches:
                for start in range(0, len(frame), _DOCUMENT_BLOCK):
                    _add_gram(total, b, frame["cols"].iloc[start : start + _DOCUMENT_BLOCK], frame["vals"].iloc[start : start + _DOCUMENT_BLOCK])
            yield pd.DataFrame({"block": [total.tobytes()]})

        blocks = matrix.mapInPandas(partial, "block binary").rdd.map(lambda r: np.frombuffer(r["block"]).reshape(block.shape))
        return blocks.treeReduce(lambda x, y: x + y, depth=3)

    for _ in range(_POWER_PASSES):
        q, _ = np.linalg.qr(gram_times(q))
    small = q.T @ gram_times(q)
    matrix.unpersist()
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:width]
    v = q @ vectors[:, order]
    signs = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return v * np.where(signs == 0, 1, signs)


def _add_gram(total: np.ndarray, b: np.ndarray, cols: pd.Series, vals: pd.Series) -> None:
    """total += R'(R b) for a block of sparse rows R, by sorted segment sums."""
    lengths = np.array([len(c) for c in cols])
    if not lengths.size:
        return
    col, val = np.concatenate(list(cols)), np.concatenate(list(vals))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    projected = np.add.reduceat(val[:, None] * b[col], starts, axis=0)
    spread = val[:, None] * np.repeat(projected, lengths, axis=0)
    order = np.argsort(col, kind="stable")
    touched, first = np.unique(col[order], return_index=True)
    total[touched] += np.add.reduceat(spread[order], first, axis=0)
