"""Brute-force versions and awkward rows that the operators are held against."""

from __future__ import annotations

import re
import zlib

import duckdb

FOLDER = "/root/testdata/sf0.001"

#: Nulls, empty and blank texts, ties and repeated rows, other scripts, a long text.
AWKWARD = [
    (9001, None),
    (9002, ""),
    (9003, " \n\t "),
    (9004, "same words here\nsame words here"),
    (9005, "same words here\nsame words here"),
    (9006, "日本語のテキスト 😀 ünï"),
    (9007, "word " * 3000),
    (9008, "x"),
    (9009, "a  b \x00 c ▁ d"),
]


def rows(folder: str = FOLDER, name: str = "documents", columns: str = "doc_id, text"):
    return duckdb.sql(f"select {columns} from '{folder}/{name}.parquet'").fetchall()


def frame(spark, data, schema: str = "doc_id long, text string"):
    """The rows with further columns, some of whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, schema).repartition(3)
    return df.withColumns({c: F.lit("own") for c in ("_row", "row", "line", "id", "label", "h1", "words", "base", "_text", "removed", "segment", "place")})


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def blank_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def remainder(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


class Groups:
    """Union-find."""

    def __init__(self, items):
        self.up = {x: x for x in items}

    def top(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
