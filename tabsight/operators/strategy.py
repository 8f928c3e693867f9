"""What to do with each column: observed roles, the default recipe and the checks on a proposed one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F, types as T

from tabsight.functions.columns import is_numeric, ratio, text_columns, word_count
from tabsight.functions.frames import distinct_counts, per_column

# Limits.
MAX_ONEHOT = 50
NEAR_UNIQUE = 0.9
PROSE_WORDS = 20

# What each role may ask for; the first entry is the default.
IMPUTE = {
    "numeric": ("median", "mean", "constant", "none"),
    "datetime": ("median", "mean", "constant", "none"),
    "categorical": ("most_frequent", "constant", "none"),
    "ordinal": ("most_frequent", "constant", "none"),
    "text": ("most_frequent", "constant", "none"),
    "drop": ("none",),
}
ENCODE = {
    "numeric": ("none",),
    "datetime": ("none",),
    "categorical": ("onehot", "frequency"),
    "ordinal": ("ordinal",),
    "text": ("frequency", "tfidf"),
    "drop": ("none",),
}
SCALE = {
    "numeric": ("standard", "minmax", "none"),
    "datetime": ("standard", "minmax", "none"),
    "categorical": ("none",),
    "ordinal": ("none", "standard", "minmax"),
    "text": ("none", "standard", "minmax"),
    "drop": ("none",),
}


@dataclass(frozen=True)
class ColumnStrategy:
    column: str
    role: str
    impute: str = "none"
    encode: str = "none"
    scale: str = "none"
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Override:
    column: str
    field: str
    requested: str
    applied: str


def mean_words(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean_words, is_long_form): words per non-null value over whole texts."""
    out = per_column(df, columns, lambda _, c: {"mean_words": F.coalesce(F.avg(F.when(c.isNotNull(), word_count(c))), F.lit(0.0))})
    return out.withColumn("is_long_form", F.col("mean_words") >= PROSE_WORDS)


def observed_roles(df: DataFrame) -> DataFrame:
    """(column, ordinal, n_rows, n_missing, n_unique, mean_words, is_long_form, is_near_unique, role)."""
    texts = set(text_columns(df))
    n = F.count(F.lit(1))
    kinds = {}
    for f in df.schema:
        if is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType):
            kinds[f.name] = "numeric"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kinds[f.name] = "datetime"
        else:
            kinds[f.name] = "label"

    def measure(name, c):
        words = F.avg(F.when(c.isNotNull(), word_count(c))) if name in texts else F.max(F.lit(0.0))
        return {
            "ordinal": F.first(F.lit(df.columns.index(name))).cast("long"),
            "kind": F.first(F.lit(kinds[name])),
            "n_rows": n,
            "n_missing": n - F.count(c),
            "mean_words": F.coalesce(words, F.lit(0.0)),
        }

    base = per_column(df, df.columns, measure).join(F.broadcast(distinct_counts(df, df.columns)), "column", "left")
    base = base.withColumn("n_unique", F.coalesce("n_unique", F.lit(0).cast("long")))
    prose = (F.col("kind") == "label") & (F.col("mean_words") >= PROSE_WORDS)
    role = (
        F.when(F.col("kind") != "label", F.col("kind"))
        .when(prose | (F.col("n_unique") > MAX_ONEHOT), "text")
        .otherwise("categorical")
    )
    near = F.coalesce(ratio(F.col("n_unique"), F.col("n_rows")) > NEAR_UNIQUE, F.lit(False))
    return base.select(
        "column", "ordinal", "n_rows", "n_missing", "n_unique", "mean_words", prose.alias("is_long_form"), near.alias("is_near_unique"), role.alias("role")
    )


def default_strategy(roles: DataFrame) -> DataFrame:
    """(column, role, impute, encode, scale) for every row of ``observed_roles``."""
    text = F.col("role") == "text"
    role = F.when(text & ~F.col("is_long_form") & F.col("is_near_unique"), "drop").otherwise(F.col("role"))
    number = role.isin("numeric", "datetime")
    impute = (
        F.when(number, "median")
        .when(role == "drop", "none")
        .when(text & F.col("is_long_form"), "constant")
        .otherwise("most_frequent")
    )
    encode = (
        F.when(number | (role == "drop"), "none")
        .when(text & F.col("is_long_form"), "tfidf")
        .when(text, "frequency")
        .otherwise("onehot")
    )
    scale = F.when(number, "standard").otherwise("none")
    return roles.select("ordinal", "column", role.alias("role"), impute.alias("impute"), encode.alias("encode"), scale.alias("scale"))


def ordinal_gaps(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Values present in the data that a stated order leaves out."""
    listed = df.sparkSession.createDataFrame([(v,) for v in order], "value string")
    present = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    return present.join(F.broadcast(listed), "value", "left_anti")


def strategies_for(df: DataFrame, target: str | None = None) -> list[ColumnStrategy]:
    """The default recipe of a table, one small row per column read on the driver."""
    features = df.drop(target) if target else df
    rows = default_strategy(observed_roles(features)).orderBy("ordinal").collect()
    return [ColumnStrategy(r["column"], r["role"], r["impute"], r["encode"], r["scale"]) for r in rows]


def validate(df: DataFrame, proposed: Sequence[ColumnStrategy]) -> tuple[list[ColumnStrategy], list[str], list[Override]]:
    """Make a proposed strategy buildable: unknown columns are rejected, duplicates keep the first, gaps
    take the default, illegal choices are replaced and recorded, column order is kept."""
    facts = {r["column"]: r for r in observed_roles(df).collect()}
    defaults = {r["column"]: r for r in default_strategy(observed_roles(df)).collect()}
    rejected = [p.column for p in proposed if p.column not in facts]
    first: dict[str, ColumnStrategy] = {}
    for p in proposed:
        if p.column in facts:
            first.setdefault(p.column, p)
    chosen, overrides = [], []
    for name in df.columns:
        if name not in first:
            d = defaults[name]
            chosen.append(ColumnStrategy(name, d["role"], d["impute"], d["encode"], d["scale"]))
            continue
        p, f = first[name], facts[name]
        role = _role(p, f)
        if role == "ordinal" and (not p.order or not ordinal_gaps(df, name, p.order).isEmpty()):
            role = "categorical"
        if role != p.role:
            overrides.append(Override(name, "role", p.role, role))
        prose = role == "text" and f["is_long_form"]
        impute = _choice(p, "impute", IMPUTE[role], IMPUTE[role][0], overrides)
        if impute == "none" and role != "drop" and f["n_missing"]:
            overrides.append(Override(name, "impute", "none", IMPUTE[role][0]))
            impute = IMPUTE[role][0]
        encode = _choice(p, "encode", ENCODE[role], "tfidf" if prose else ENCODE[role][0], overrides)
        if encode == "frequency" and prose and f["is_near_unique"]:
            overrides.append(Override(name, "encode", "frequency", "tfidf"))
            encode = "tfidf"
        scale = _choice(p, "scale", SCALE[role], SCALE[role][0], overrides)
        chosen.append(replace(p, role=role, impute=impute, encode=encode, scale=scale, order=p.order if role == "ordinal" else ()))
    return chosen, rejected, overrides


def _choice(p: ColumnStrategy, field: str, allowed: tuple[str, ...], fallback: str, overrides: list[Override]) -> str:
    asked = getattr(p, field)
    if asked in allowed:
        return asked
    overrides.append(Override(p.column, field, asked, fallback))
    return fallback


def _role(p: ColumnStrategy, f) -> str:
    """A label may be claimed for a number with few values; everything else follows the data."""
    asked, seen = p.role, f["role"]
    if asked == "drop":
        return "drop"
    if seen == "numeric":
        return asked if asked in ("categorical", "ordinal", "text") and f["n_unique"] <= MAX_ONEHOT else "numeric"
    if seen == "datetime":
        return "datetime"
    if seen == "text":
        return "drop" if f["is_near_unique"] and not f["is_long_form"] else "text"
    return asked if asked in ("categorical", "ordinal", "text") else "categorical"
