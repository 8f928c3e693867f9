"""Quality rules, line first: bad lines go, then documents that lost too much of their text.

All rules are expressions over one row's text, so the whole operator is one pass without a shuffle.

A line fails if it is *boilerplate* (a notice such as a licence, cookie or copyright line), *navigation* (a short line cut
by bars, arrows or bullets, or one of menu words only), or if its *punctuation* is off (at least half of its visible
characters are neither letters nor digits). Lines without a word are kept as they are; they carry no text to lose. A document is rejected if its base test fails or if more than
``MOST_LOST`` of its visible characters were in failing lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import let

#: Base test.
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
#: Most of a document's visible characters that failing lines may hold, in per cent.
MOST_LOST = 50

WORD = r"[^\x20\x09-\x0D]"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"

#: Phrases of notices, looked for without case.
NOTICES = [
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "accept cookies",
    "we use cookies",
    "subscribe to our newsletter",
    "enable javascript",
    "javascript is disabled",
    "licensed under the",
    "lorem ipsum",
]
#: Words that make up menu lines.
MENU_WORDS = [
    "home",
    "about",
    "contact",
    "login",
    "logout",
    "register",
    "menu",
    "search",
    "sitemap",
    "next",
    "previous",
    "share",
    "print",
    "faq",
]

#: The rules of a line, in the part of regular expressions that Spark's and DuckDB's have in common.
NOTICE = "(?i)" + "|".join(NOTICES)
_MARKS = r"[\x20\x09-\x0D|>»•·/-]*"
MENU = rf"(?i)\A{_MARKS}(?:(?:{'|'.join(MENU_WORDS)}){_MARKS})+\z"
BARS = r"\A(?:[^|»•>]{0,30}[|»•>]){3,}[^|»•>]{0,30}\z"
#: The same two for Java, which matches possessive groups in a loop and greedy ones by recursion. No menu word begins another
#: and no mark or bar is part of what it parts, so there is nothing to go back for.
MENU_LOOP = rf"(?i)\A{_MARKS}+(?:(?:{'|'.join(MENU_WORDS)}){_MARKS}+)++\z"
BARS_LOOP = r"\A(?:[^|»•>]{0,30}+[|»•>]){3,}+[^|»•>]{0,30}+\z"
PLAIN = r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def visible(text: Column) -> Column:
    """Characters that are no blanks."""
    return F.length(F.regexp_replace(text, BLANKS, ""))


def line_fails(line: Column) -> Column:
    """Whether a line that has a word fails a rule."""
    noise = let(visible(line), lambda n: 2 * F.length(F.regexp_replace(line, PLAIN, "")) >= n)
    return line.rlike(NOTICE) | line.rlike(MENU_LOOP) | line.rlike(BARS_LOOP) | noise


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more.

    The windows' hashes are sorted with their places, so equal windows are neighbours; each place of a repeated window then
    covers three words, less those that the next place covers too.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")),
    )

    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    found = let(F.sort_array(windows), lambda s: let(places(s), covered))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(found)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of the contract, ``clean`` (the text without failing lines) and ``lost_share``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select("*", text.alias("_text"), words_of(text).alias("_words"), F.split(text, "\n").alias("_lines"))

    def lines(all_lines: Column) -> Column:
        worded = F.filter(all_lines, lambda x: x.rlike(WORD))
        doubled = let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w)))
        failed = F.filter(all_lines, lambda x: x.rlike(WORD) & line_fails(x))
        return F.struct(doubled.cast("long").alias("n_dup_lines"), failed.alias("failed"))

    parts = parts.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        visible(F.col("_text")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        lines(F.col("_lines")).alias("_found"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    lost = F.aggregate("_found.failed", F.lit(0).cast("long"), lambda a, x: a + visible(x))
    clean = F.array_join(F.filter("_lines", lambda x: ~F.array_contains("_found.failed", x)), "\n")
    parts = parts.select(
        "*",
        F.col("_found.n_dup_lines").alias("n_dup_lines"),
        F.size("_found.failed").cast("long").alias("n_failed_lines"),
        lost.alias("_lost"),
        F.when(F.size("_found.failed") == 0, F.col("text")).otherwise(clean).alias("clean"),
    )
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    parts = parts.withColumn("base_failed", base)
    kept = ~F.col("base_failed") & (100 * F.col("_lost") <= MOST_LOST * F.col("word_chars"))
    return parts.withColumn("kept", kept).withColumn("lost_share", F.try_divide("_lost", "word_chars"))


def assess(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text); other columns are not read, so their names cannot clash.

    A null or empty text has no words and no lines with a word, fails the base test and is not kept. Repeated rows get the
    same verdict; an empty table gives an empty result.
    """
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines"]
    return as_made(measured(docs.select("doc_id", "text")), ["doc_id", *columns])


def as_made(measures: DataFrame, columns: list[str]) -> DataFrame:
    """The columns through a generator of one row each: a caller's filter would else be pushed below the measures, and every
    measure it mentions would be worked out again."""
    return measures.select(F.inline(F.array(F.struct(*columns))))


def keep_good(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` without their failing lines; all other columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = as_made(measured(docs.select(row.alias("_row"), F.col("text").alias("text"))), ["_row", "clean", "kept"])
    return found.where("kept").select(*[F.col("clean").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
