"""Text expressions: accent folding, tokens, all inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# English stop words of two or more letters (the list Spark ships, without contractions).
STOP_WORDS = (
    "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "an", "the",
    "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in",
    "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "can", "will", "just", "don", "should", "now", "cannot", "could",
    "ought", "would",
)

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _accent_pairs() -> tuple[str, str]:
    """Latin letters that decompose to one ASCII letter and a mark, and that ASCII letter."""
    accented, plain = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))
        if base[0].isascii() and base[0].isalpha() and all(unicodedata.combining(m) for m in base[1:]) and len(base) > 1:
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_pairs()


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Folded tokens without stop words; null text has none."""
    found = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))
