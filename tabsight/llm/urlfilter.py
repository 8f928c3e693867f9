"""URL filters: longest matching rule, else a logistic regression on hashed character n-grams of host and path.

The model is fitted by mini-batch gradient descent in numpy on a small labelled URL table and travels with the task as one
vector of weights. The labelled table is an argument; ``rule_labels`` makes one of the URLs that a rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Buckets that n-grams are hashed into, for host and path together.
BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
#: Most labelled URLs that a fit reads.
LABELLED_ROWS = 20_000
#: Steps of gradient descent, the rows of each, and its rate, which falls in proportion to the steps that are left.
STEPS = 1_500
STEP_ROWS = 32
RATE = 2.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the query: verdict, host, path.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``urls`` (host, path) with rule and rule_verdict of the longest rule that fits host and path, or null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the last that fits wins
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def features(host: str, path: str) -> np.ndarray:
    """Bucket of every n-gram of both parts, marked by part, each once."""
    found = set()
    for mark, part in (("h", host), ("p", path)):
        data = f"^{part}$"
        for n in GRAMS:
            found.update(mark + data[i : i + n] for i in range(len(data) - n + 1))
    return np.fromiter((crc32(g.encode()) % BUCKETS for g in sorted(found)), np.int64, len(found))


def fit(labelled: list[tuple[str, str, int]], seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on (host, path, 1 to block or 0 to allow)."""
    weights = np.zeros(BUCKETS + 1)
    if not labelled:
        return weights
    rows = [features(h, p) for h, p, _ in labelled]
    target = np.array([y for _, _, y in labelled], float)
    # Both verdicts weigh the same in all, however many rows they have.
    weight = len(target) / (2 * np.maximum(1, np.where(target == 1, (target == 1).sum(), (target == 0).sum())))
    draw = np.random.default_rng(seed)
    for step in range(STEPS):
        block = draw.integers(0, len(rows), STEP_ROWS)
        at = np.concatenate([rows[i] for i in block])
        owner = np.repeat(np.arange(len(block)), [len(rows[i]) for i in block])
        share = 1.0 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(block))))
        score = np.bincount(owner, weights[at], len(block)) * share + weights[-1]
        error = weight[block] * (target[block] - 1 / (1 + np.exp(-np.clip(score, -30, 30)))) / len(block)
        rate = RATE * (1 - step / STEPS)
        np.add.at(weights, at, rate * (error * share)[owner])
        weights[-1] += rate * error.sum()
    return weights


def probability(weights: np.ndarray, host: str, path: str) -> float:
    at = features(host, path)
    score = weights[at].sum() / np.sqrt(len(at)) + weights[-1]
    return float(1 / (1 + np.exp(-np.clip(score, -30, 30))))


def rule_labels(urls: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """A labelled table (host, path, block) of the distinct URLs that a rule decides."""
    decided = match_rules(urls, rules).where("rule is not null")
    return decided.select("host", "path", F.when(F.col("rule_verdict") == "block", 1).otherwise(0).alias("block")).distinct()


def labelled_rows(labelled: DataFrame, limit: int = LABELLED_ROWS) -> list[tuple[str, str, int]]:
    """At most ``limit`` rows, picked by a hash of the URL so that each run takes the same."""
    order = F.xxhash64("host", "path")
    rows = labelled.select("host", "path", "block").orderBy(order, "host", "path", "block").limit(limit).collect()
    return [(r.host, r.path, int(r.block)) for r in rows]


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """One row a row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, block_probability.

    Null URLs and URLs without ``://`` have an empty host and path and are judged by the model like any other; repeated rows
    get the same verdict; an even probability allows. Other columns are not read, an empty table gives an empty result, and
    without labelled rows the model allows.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    weights = fit(labelled_rows(rule_labels(urls, rules) if labelled is None else labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            chance = np.array([probability(weights, h, p) for h, p in pairs])
            decided = batch.column("rule_verdict").to_pylist()
            verdict = [d or ("block" if c > 0.5 else "allow") for d, c in zip(decided, chance)]
            columns = [batch.column(c) for c in ("page_id", "host", "path", "rule")] + [pa.array(verdict, pa.string()), pa.array(chance)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict", "block_probability"])

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, host string, path string, rule string, verdict string, block_probability double"
    return match_rules(urls, rules).mapInArrow(run, schema)
