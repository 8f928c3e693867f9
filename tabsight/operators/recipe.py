"""Column recipes: ``Recipe(strategies).fit(train).transform(anything)``.

There is no ``fit_transform``: everything learned (fills, scales, vocabularies, frequencies, topics, the
selected features) comes from the frame given to ``fit`` and nothing else. Fitted state is a few numbers
per column, a vocabulary of bounded size, or (for frequencies, whose size follows the data) a table that
is joined, so ``transform`` is a narrow plan plus those joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsight.functions.columns import deviation, named, ratio, variance
from tabsight.functions.frames import per_column, unpivot_number, unpivot_text, value_counts
from tabsight.operators.ordinal import counted_quantiles, quantiles
from tabsight.operators.select import univariate_scores
from tabsight.operators.strategy import MAX_ONEHOT, ColumnStrategy
from tabsight.operators.text import TextTopics
from tabsight.session import pin

MISSING_LABEL = "missing"
DATETIME_PARTS = ("year", "month", "day", "dayofweek", "hour")


class UnfittableColumn(ValueError):
    """A column cannot be encoded the way its strategy asks."""


def datetime_part(c: Column, part: str) -> Column:
    ts = c.try_cast("timestamp_ntz")
    value = {
        "year": F.year,
        "month": F.month,
        "day": F.dayofmonth,
        "dayofweek": F.weekday,
        "hour": F.hour,
    }[part](ts)
    return value.cast("double")


def common_labels(df: DataFrame, columns: Sequence[str], k: int) -> dict[str, list[str]]:
    """The ``k`` commonest labels per column, ties by label, from one job; at most ``k`` rows per column are read."""
    if not columns:
        return {}
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    ranked = value_counts(df, columns).withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= k)
    out: dict[str, list[str]] = {c: [] for c in columns}
    for row in sorted(ranked.collect(), key=lambda r: r["_p"]):
        out[row["column"]].append(row["value"])
    return out


def training_counts(counted: DataFrame, folds: Sequence[int], keys: Sequence[str], fold: str = "fold") -> DataFrame:
    """(fold, keys..., _n): how often ``keys`` occur outside each fold. One grouping counts all folds; a fold's training
    rows are the total less its own."""
    own = [F.count_if(F.col(fold) == f).alias(f"_own_{i}") for i, f in enumerate(folds)]
    counts = counted.where(F.col(fold).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), *own)
    parts = F.array(*[F.struct(F.lit(int(f)).alias(fold), (F.col("_all") - F.col(f"_own_{i}")).alias("_n")) for i, f in enumerate(folds)])
    return counts.select(*[named(k) for k in keys], F.inline(parts)).where("_n > 0").select(fold, *[named(k) for k in keys], "_n")


@dataclass(frozen=True)
class Moments:
    """Mergeable statistics of a column: values, mean, squared deviations, least, largest, nulls."""

    n: int
    mean: float | None
    m2: float | None
    lo: float | None
    hi: float | None
    nulls: int = 0

    @staticmethod
    def merged(parts: Sequence[Moments]) -> Moments:
        nulls, held = sum(p.nulls for p in parts), [p for p in parts if p.n]
        if not held:
            return Moments(0, None, None, None, None, nulls)
        n = sum(p.n for p in held)
        mean = sum(p.n * p.mean for p in held) / n
        lo, hi = min(p.lo for p in held), max(p.hi for p in held)
        m2 = 0.0 if lo == hi else sum(p.m2 + p.n * (p.mean - mean) ** 2 for p in held)
        return Moments(n, mean, m2, lo, hi, nulls)

    def filled(self, value: float | None) -> Moments:
        """With every null replaced by ``value``; None leaves them out."""
        if value is None or not self.nulls:
            return self
        return Moments.merged([Moments(self.n, self.mean, self.m2, self.lo, self.hi), Moments(self.nulls, value, 0.0, value, value)])

    def scale(self, kind: str) -> tuple[float, float]:
        if not self.n:
            return 0.0, 1.0
        shift, width = (self.mean, (self.m2 / self.n) ** 0.5) if kind == "standard" else (self.lo, self.hi - self.lo)
        return shift, width if width else 1.0


def frequency_table(df: DataFrame, value: Column, weight: Column | None = None) -> DataFrame:
    """(v, share): training proportion of each label; ``weight`` says how many rows a row stands for."""
    counts = df.select(value.alias("v"), (F.lit(1) if weight is None else weight).alias("w")).groupBy("v").agg(F.sum("w").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"), F.first(F.lit(1)).alias("_k"))
    return counts.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").select("v", ratio(F.col("n"), F.col("_total")).alias("share"))


@dataclass
class FittedRecipe:
    strategies: list[ColumnStrategy]
    label_fill: dict[str, str] = field(default_factory=dict)
    vocabularies: dict[str, list[str]] = field(default_factory=dict)
    frequencies: dict[str, DataFrame] = field(default_factory=dict)
    texts: dict[str, TextTopics] = field(default_factory=dict)
    number_fill: dict[str, float] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    lineage: list[tuple[str, str]] = field(default_factory=list)
    selected: list[str] | None = None

    # ---- expressions -----------------------------------------------------------------------------

    def _label(self, s: ColumnStrategy) -> Column:
        c = F.col(s.column).cast("string")
        if s.impute == "constant":
            return F.coalesce(c, F.lit("" if s.encode == "tfidf" else MISSING_LABEL))
        if s.impute == "most_frequent":
            return F.coalesce(c, F.lit(self.label_fill[s.column]))
        return c

    def _base(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Encoded columns before numeric fills and scales."""
        out = [F.col(k) for k in keep]
        joins = []
        for i, s in enumerate(self.strategies):
            c = F.col(s.column) if s.role != "drop" else None
            if s.role == "numeric":
                out.append(c.cast("double").alias(s.column))
            elif s.role == "datetime":
                out += [datetime_part(c, p).alias(f"{s.column}_{p}") for p in DATETIME_PARTS]
            elif s.role == "ordinal":
                position = F.array_position(F.array(*[F.lit(v) for v in s.order]), self._label(s)) - 1
                out.append(F.coalesce(position, F.lit(-1)).cast("double").alias(s.column))
            elif s.encode == "onehot":
                label = self._label(s)
                out += [F.coalesce((label == v).cast("double"), F.lit(0.0)).alias(f"{s.column}_{v}") for v in self.vocabularies[s.column]]
            elif s.encode == "frequency":
                out.append(self._label(s).alias(f"_label_{i}"))
                joins.append((i, s))
            elif s.encode == "tfidf":
                out.append(self._label(s).alias(f"_text_{i}"))
        result = df.select(*out)
        for i, s in joins:
            table = self.frequencies[s.column].select(F.col("v").alias(f"_label_{i}"), F.col("share").alias(f"{s.column}_frequency"))
            result = result.join(table, f"_label_{i}", "left").withColumn(
                f"{s.column}_frequency", F.coalesce(named(f"{s.column}_frequency"), F.lit(0.0))
            )
        for i, s in enumerate(self.strategies):
            if s.encode == "tfidf" and s.role == "text":
                model = self.texts[s.column]
                result = model.transform(result, f"_text_{i}", f"_topics_{i}")
                result = result.select(
                    *[c for c in result.columns if c != f"_topics_{i}"],
                    *[F.col(f"_topics_{i}")[j].alias(n) for j, n in enumerate(self._topic_names(s))],
                )
        names = [n for n, _ in self.lineage] if self.lineage else self._names()
        return result.select(*keep, *[named(n) for n in names])

    def _topic_names(self, s: ColumnStrategy) -> list[str]:
        model = self.texts[s.column]
        return [f"{s.column}_{model.kind}_{j}" for j in range(model.width)]

    def _pairs(self) -> list[tuple[str, str]]:
        pairs = []
        for s in self.strategies:
            if s.role in ("numeric", "ordinal"):
                pairs.append((s.column, s.column))
            elif s.role == "datetime":
                pairs += [(f"{s.column}_{p}", s.column) for p in DATETIME_PARTS]
            elif s.encode == "onehot":
                pairs += [(f"{s.column}_{v}", s.column) for v in self.vocabularies[s.column]]
            elif s.encode == "frequency":
                pairs.append((f"{s.column}_frequency", s.column))
            elif s.encode == "tfidf":
                pairs += [(n, s.column) for n in self._topic_names(s)]
        return pairs

    def _names(self) -> list[str]:
        return [n for n, _ in self._pairs()]

    def _filled(self, name: str) -> Column:
        c = named(name)
        return F.coalesce(c, F.lit(self.number_fill[name])) if name in self.number_fill else c

    def _scaled(self, name: str) -> Column:
        c = self._filled(name)
        if name in self.scales:
            shift, width = self.scales[name]
            c = (c - F.lit(shift)) / F.lit(width)
        return c

    # ---- public ----------------------------------------------------------------------------------

    @property
    def names(self) -> list[str]:
        """Encoded feature names, after selection."""
        every = [n for n, _ in self.lineage]
        return every if self.selected is None else [n for n in every if n in set(self.selected)]

    def encode(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns and one double per encoded feature."""
        base = self._base(df, [k for k in keep])
        return base.select(*keep, *[self._scaled(n).alias(n) for n in self.names])

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns and a ``features`` vector."""
        base = self._base(df, [k for k in keep])
        return base.select(*keep, array_to_vector(F.array(*[self._scaled(n) for n in self.names])).alias("features"))

    def lineage_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.lineage, "encoded string, source string")


def source_by_prefix(encoded: DataFrame, sources: DataFrame) -> DataFrame:
    """(encoded, source) where lineage is not recorded: the longest source name the encoded one starts with.

    Source names are grouped by length and matched by an equality join per length, never all against all.
    """
    lengths = sources.select(F.length("source").alias("_len")).distinct()
    cut = encoded.withColumn("_k", F.lit(1)).join(F.broadcast(lengths.withColumn("_k", F.lit(1))), "_k").where(F.length("encoded") >= F.col("_len"))
    hits = cut.withColumn("source", F.substring(F.col("encoded"), F.lit(1), F.col("_len"))).join(sources.select("source"), "source")
    rest = F.expr("substring(encoded, length(source) + 1)")
    hits = hits.where((rest == "") | rest.startswith("_"))
    return hits.groupBy("encoded").agg(F.max_by("source", F.length("source")).alias("source"))


class Recipe:
    def __init__(
        self,
        strategies: Sequence[ColumnStrategy],
        select_k: int | None = None,
        target: str | None = None,
        task: str | None = None,
        topics: int = 120,
    ):
        self.strategies = [s for s in strategies if s.role != "drop"]
        self.select_k, self.target, self.task, self.topics = select_k, target, task, topics

    @property
    def _labelled(self) -> list[str]:
        return [s.column for s in self.strategies if s.role in ("categorical", "ordinal", "text") and (s.impute == "most_frequent" or s.encode == "onehot")]

    @property
    def _marked(self) -> list[str]:
        return [s.column for s in self.strategies if s.encode == "onehot" and s.impute == "constant"]

    def fit(self, train: DataFrame) -> FittedRecipe:
        gaps = {}
        if self._marked:
            row = train.agg(*[F.count_if(named(c).isNull()).alias(f"g{i}") for i, c in enumerate(self._marked)]).first()
            gaps = {c: row[f"g{i}"] for i, c in enumerate(self._marked)}
        known = common_labels(train, self._labelled, MAX_ONEHOT + 1)
        return self._assemble(
            train, known, gaps, lambda fitted, s: frequency_table(train, fitted._label(s)), lambda fitted: self._fit_numbers(train, fitted)
        )

    def fit_folds(self, df: DataFrame, folds: Sequence[int], fold: str = "fold") -> dict[int, FittedRecipe]:
        """What ``fit`` learns from the rows outside each fold, for all folds together.

        Values are grouped once with one count a fold, and a training fold has the total less its own; moments come as one
        row a fold and column, of which the other folds' are merged. So label tables, frequencies, fills and scales cost the
        same scans for any number of folds. Text topics, scales of encoded labels and feature selection are still fitted
        fold by fold. A null fold belongs to none.
        """
        folds, df = list(folds), df.where(F.col(fold).isNotNull())
        known: dict[int, dict[str, list[str]]] = {f: {c: [] for c in self._labelled} for f in folds}
        if self._labelled:
            counts = training_counts(unpivot_text(df, self._labelled, [fold]), folds, ["column", "value"], fold)
            order = Window.partitionBy(fold, "column").orderBy(F.col("_n").desc(), F.col("value"))
            ranked = counts.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= MAX_ONEHOT + 1)
            for row in sorted(ranked.collect(), key=lambda r: r["_p"]):
                known[row[fold]][row["column"]].append(row["value"])
        gaps: dict[int, dict[str, int]] = {f: {} for f in folds}
        if self._marked:
            found = df.groupBy(fold).agg(*[F.count_if(named(c).isNull()).alias(f"g{i}") for i, c in enumerate(self._marked)]).collect()
            gaps = {f: {c: sum(r[f"g{i}"] for r in found if r[fold] != f) for i, c in enumerate(self._marked)} for f in folds}
        tables = {}
        for s in self.strategies:
            if s.encode == "frequency" and s.role != "ordinal":
                text = df.select(fold, named(s.column).cast("string").alias(s.column))
                tables[s.column] = pin(training_counts(text, folds, [s.column], fold))
        moments, medians = self._fold_numbers(df, folds, fold)

        def one(f: int) -> FittedRecipe:
            train = df.where(F.col(fold) != f)

            def frequency(fitted: FittedRecipe, s: ColumnStrategy) -> DataFrame:
                return frequency_table(tables[s.column].where(F.col(fold) == f), fitted._label(s), F.col("_n"))

            def numbers(fitted: FittedRecipe) -> None:
                for s in self.strategies:
                    for n in self._outputs(s, fitted) if s.role in ("numeric", "datetime") else []:
                        whole = Moments.merged([m for (g, name), m in moments.items() if name == n and g != f])
                        fill = {"median": medians.get((f, n), 0.0), "mean": whole.mean or 0.0, "constant": 0.0}.get(self._fill_of(s))
                        if fill is not None:
                            fitted.number_fill[n] = fill
                        if s.scale != "none":
                            fitted.scales[n] = whole.filled(fill).scale(s.scale)
                self._fit_scales(train, fitted, [s for s in self.strategies if s.role not in ("numeric", "datetime")])

            return self._assemble(train, known[f], gaps[f], frequency, numbers)

        return {f: one(f) for f in folds}

    def encode_folds(self, df: DataFrame, folds: Sequence[int], keep: Sequence[str], fold: str = "fold") -> DataFrame:
        """Out-of-fold encoding: every row is encoded by the recipe that learned from the other folds only. A label that a
        fold's recipe has not seen leaves that column null there."""
        out = None
        for f, fitted in self.fit_folds(df, folds, fold).items():
            part = fitted.encode(df.where(F.col(fold) == f), [fold, *keep])
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _fold_numbers(self, df: DataFrame, folds: Sequence[int], fold: str) -> tuple[dict[tuple[int, str], Moments], dict[tuple[int, str], float]]:
        """Moments of each fold and numeric output, and the medians of the rows outside each fold: one row a fold and column."""
        stub = FittedRecipe([s for s in self.strategies if s.role in ("numeric", "datetime")])
        names = stub._names()
        if not names:
            return {}, {}
        base = stub._base(df, [fold])

        def measure(_, c):
            return {"n": F.count(c), "mean": F.avg(c), "m2": variance(c) * F.count(c), "lo": F.min(c), "hi": F.max(c), "nulls": F.count_if(c.isNull())}

        rows = per_column(base, names, measure, [fold]).collect()
        moments = {(r[fold], r["column"]): Moments(r["n"], r["mean"], r["m2"], r["lo"], r["hi"], r["nulls"]) for r in rows}
        ranked = [n for s in stub.strategies if self._fill_of(s) == "median" for n, source in stub._pairs() if source == s.column]
        if not ranked:
            return moments, {}
        counts = training_counts(unpivot_number(base, ranked, [fold]), folds, ["column", "value"], fold)
        found = counted_quantiles(counts, [fold, "column"], [0.5]).collect()
        return moments, {(r[fold], r["column"]): float(r["q"][0]) for r in found if r["q"] and r["q"][0] is not None}

    def _assemble(
        self,
        train: DataFrame,
        known: dict[str, list[str]],
        gaps: dict[str, int],
        frequency: Callable[[FittedRecipe, ColumnStrategy], DataFrame],
        numbers: Callable[[FittedRecipe], None],
    ) -> FittedRecipe:
        fitted = FittedRecipe(self.strategies)
        fitted.label_fill = {c: v[0] if v else MISSING_LABEL for c, v in known.items()}
        for s in self.strategies:
            if s.role == "ordinal":
                continue
            if s.encode == "onehot":
                words = set(known[s.column])
                if gaps.get(s.column) or (s.impute == "most_frequent" and not words):
                    words.add(MISSING_LABEL)
                if len(words) > MAX_ONEHOT:
                    raise UnfittableColumn(f"{s.column} has more than {MAX_ONEHOT} labels; use frequency encoding")
                fitted.vocabularies[s.column] = sorted(words)
            elif s.encode == "frequency":
                # as large as the label set, so it stays a table; written once instead of recounted at every transform
                fitted.frequencies[s.column] = pin(frequency(fitted, s))
            elif s.encode == "tfidf":
                texts = train.select(fitted._label(s).alias("t"))
                fitted.texts[s.column] = TextTopics.fit(texts, "t", self.topics)
        fitted.lineage = fitted._pairs()
        numbers(fitted)
        if self.select_k is not None:
            scored = fitted.encode(train, [self.target])
            best = univariate_scores(scored, fitted.names, self.target, self.task).orderBy(F.col("f").desc_nulls_last(), "column")
            fitted.selected = [r["column"] for r in best.limit(self.select_k).collect()]
        return fitted

    def _outputs(self, s: ColumnStrategy, fitted: FittedRecipe) -> list[str]:
        return [n for n, source in fitted.lineage if source == s.column]

    @staticmethod
    def _fill_of(s: ColumnStrategy) -> str:
        return "median" if s.role == "datetime" and s.impute == "none" else s.impute

    def _fit_numbers(self, train: DataFrame, fitted: FittedRecipe) -> None:
        """Fills first, then scales of the filled columns: two aggregates whatever the number of columns."""
        base = fitted._base(train, [])
        ranked, means = [], []
        for s in self.strategies:
            if s.role not in ("numeric", "datetime"):
                continue
            how = self._fill_of(s)
            names = self._outputs(s, fitted)
            if how == "median":
                ranked += names
            elif how == "mean":
                means += names
            elif how == "constant":
                fitted.number_fill.update({n: 0.0 for n in names})
        if ranked:
            for row in quantiles(base, ranked, [0.5]).collect():
                fitted.number_fill[row["column"]] = float(row["q"][0]) if row["q"] and row["q"][0] is not None else 0.0
        if means:
            for row in per_column(base, means, lambda _, c: {"m": F.avg(c)}).collect():
                fitted.number_fill[row["column"]] = row["m"] if row["m"] is not None else 0.0
        self._fit_scales(train, fitted, self.strategies)

    def _fit_scales(self, train: DataFrame, fitted: FittedRecipe, strategies: Sequence[ColumnStrategy]) -> None:
        scaled = {n: s.scale for s in strategies if s.scale != "none" for n in self._outputs(s, fitted)}
        if not scaled:
            return
        base = fitted._base(train, [])
        filled = base.select(*[fitted._filled(n).alias(n) for n in scaled])

        def measure(_, c):
            return {"mean": F.avg(c), "std": deviation(c), "lo": F.min(c), "hi": F.max(c)}

        for row in per_column(filled, list(scaled), measure).collect():
            shift, width = (row["mean"], row["std"]) if scaled[row["column"]] == "standard" else (row["lo"], (row["hi"] or 0) - (row["lo"] or 0))
            fitted.scales[row["column"]] = (shift or 0.0, width if width else 1.0)
