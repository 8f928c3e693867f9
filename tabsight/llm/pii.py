"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that patterns find. They are always masked.
Words around them can give them away, too: for a word t and an entity kind c, the corpus says how many documents hold t, c
and both, and PMI(t; c) / IC(c) = log(p(t, c) / (p(t) p(c))) / -log p(c) is the share of the entity's information that the
word discloses, 1 if the word never occurs without the entity. In documents that hold the entity, a word over the first
threshold is generalised and one over the second removed. A pair counts only with enough joint documents, so that rare words
do not disclose by chance.

Everything is DataFrame code: a match's place follows from the lengths of the pieces between matches, the corpus counts are
one grouped sum with map-side combining over hashed words, and only documents with an entity take part in the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import let, staged

#: Fixed values of the contract, in the order of its kinds. A local part starts a run or follows the match before it.
#: Repeated groups are possessive, which finds the same: Java matches them in a loop, greedy ones by recursion.
KINDS = ["email", "ip", "card", "phone"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = [EMAIL, IP, CARD, PHONE]
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Kinds of the spans that the method adds, and the share of an entity's information from which each holds.
GENERALISED, REMOVED = "generalised", "removed"
GENERALISE_FROM, REMOVE_FROM = 0.7, 0.9
#: Documents that a word and an entity kind must share.
LEAST_JOINT = 5
TERM = r"[\p{L}\p{N}]{3,}"

SPAN = "array<struct<kind:string,start:bigint,stop:bigint>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z")
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that spares most texts the pattern."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9 -]{14}"), "phone": text.rlike(r"\+[0-9]")}[kind]


def placed(text: Column, pattern: Column) -> Column:
    """Every match as (match, start, stop), in code points, from the lengths of matches and of the pieces between them."""

    def walk(matches: Column, pieces: Column) -> Column:
        nothing = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<match:string,start:bigint,stop:bigint>>)").alias("found"))

        def step(acc: Column, k: Column) -> Column:
            start = acc["at"] + F.length(pieces[k])
            stop = start + F.length(matches[k])
            one = F.struct(matches[k].alias("match"), start.alias("start"), stop.alias("stop"))
            return F.struct(stop.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

        places = F.filter(F.sequence(F.lit(0), F.size(matches)), lambda k: k < F.size(matches))
        return F.aggregate(places, nothing, step, lambda acc: acc["found"])

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda p: walk(m, p)))


def base_spans(text: Column) -> Column:
    """The contract's spans, by kind and start; an empty array for null."""
    found = []
    for kind, pattern in zip(KINDS, PATTERNS):
        good = F.filter(placed(text, F.lit(pattern)), lambda x: _passes(kind, x["match"]))  # noqa: B023
        spans = F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))  # noqa: B023
        found.append(F.when(_may_hold(kind, text), spans).otherwise(F.expr(f"cast(array() as {SPAN})")))
    return F.coalesce(F.concat(*found), F.expr(f"cast(array() as {SPAN})"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def terms(text: Column, spans: Column) -> Column:
    """Distinct lower-case words of three letters or digits and more, without those of entity patterns."""
    masked = text
    for pattern in PATTERNS:
        masked = F.regexp_replace(masked, pattern, " ")
    masked = F.when(F.size(spans) > 0, masked).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(masked), F.lit(TERM), F.lit(0)))


def disclosing_terms(found: DataFrame, least_joint: int = LEAST_JOINT) -> DataFrame:
    """(h, kind, share): hashed words that disclose at least ``GENERALISE_FROM`` of an entity kind.

    ``found`` (text, base) are all documents; the totals of documents and of those with each kind are one row.
    """
    flags = [F.exists("base", lambda x: x["kind"] == kind).cast("long").alias(f"has_{kind}") for kind in KINDS]  # noqa: B023
    totals = found.select(*flags).agg(F.count("*").alias("docs"), *[F.sum(f"has_{k}").alias(f"all_{k}") for k in KINDS]).first()
    rows = found.select(*flags, F.explode(terms(F.col("text"), F.col("base"))).alias("term"))
    held = [F.sum(f"has_{k}").alias(f"n_{k}") for k in KINDS]
    counts = rows.groupBy(F.xxhash64("term").alias("h")).agg(F.count("*").alias("n"), *held)
    counts = counts.where(F.greatest(*[f"n_{k}" for k in KINDS]) >= least_joint)
    shares = counts.withColumns({c: F.lit(totals[c] or 0) for c in totals.asDict()})
    by_kind = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("joint"), F.col(f"all_{k}").alias("all")) for k in KINDS])
    long = shares.select("h", "n", "docs", F.inline(by_kind)).where((F.col("joint") >= least_joint) & (F.col("all") < F.col("docs")))
    joint = F.try_divide(F.col("joint") * F.col("docs"), F.col("n") * F.col("all"))
    share = F.try_divide(F.log(joint), -F.log(F.try_divide("all", "docs")))
    return long.select("h", "kind", share.alias("share")).where(F.col("share") >= GENERALISE_FROM)


def _free_of(base: Column, span: Column) -> Column:
    return ~F.exists(base, lambda b: (b["start"] < span["stop"]) & (span["start"] < b["stop"]))


def found_spans(docs: DataFrame, least_joint: int = LEAST_JOINT) -> DataFrame:
    """``docs`` (doc_id, text and any further columns) with base and spans, all spans by kind and start.

    Null and empty texts have no spans. Rows are told apart by a number of their own, so repeated and null ids are kept as
    they are. An empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = docs.select(row.alias("_row"), F.col("text").alias("text"), base_spans(F.col("text")).alias("base"))
    found = staged(found.withColumn("_id", F.monotonically_increasing_id()), "entities")
    with_entity = found.where(F.size("base") > 0)
    flagged = staged(disclosing_terms(found.select("text", "base"), least_joint), "terms")
    kinds = F.array_distinct(F.transform("base", lambda x: x["kind"]))
    words = with_entity.select("_id", kinds.alias("kinds"), F.explode(terms(F.col("text"), F.col("base"))).alias("term"))
    hits = words.withColumn("h", F.xxhash64("term")).join(flagged, "h").where(F.array_contains("kinds", F.col("kind")))
    hits = hits.groupBy("_id", "term").agg(F.max("share").alias("share"))
    chosen = hits.groupBy("_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("share") < REMOVE_FROM, F.col("term")))).alias("general"),
        F.sort_array(F.collect_set(F.when(F.col("share") >= REMOVE_FROM, F.col("term")))).alias("removed"),
    )

    def of_terms(kind: str, words: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        free = F.filter(placed(F.col("text"), pattern), lambda x: _free_of(F.col("base"), x))
        spans = F.transform(free, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
        return F.when(F.size(words) > 0, spans).otherwise(F.expr(f"cast(array() as {SPAN})"))

    marked = with_entity.join(chosen, "_id").select(
        "_id", F.concat(of_terms(GENERALISED, F.col("general")), of_terms(REMOVED, F.col("removed"))).alias("added")
    )
    all_spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))
    return found.join(marked, "_id", "left").select("_row", "text", "base", all_spans.alias("spans"))


def find(docs: DataFrame, least_joint: int = LEAST_JOINT) -> DataFrame:
    """One row a row of ``docs``: doc_id, base and spans. Columns besides doc_id and text are not read."""
    found = found_spans(docs.select("doc_id", "text"), least_joint)
    return found.select(F.col("_row.doc_id").alias("doc_id"), "base", "spans")


def sanitise(docs: DataFrame, least_joint: int = LEAST_JOINT) -> DataFrame:
    """``docs`` with entities as ``[KIND]``, generalised words as ``[WORD]`` or ``[NUMBER]`` and removed words gone."""
    found = found_spans(docs, least_joint)

    def part(span: Column) -> Column:
        word = F.substring(F.col("text"), (span["start"] + 1).cast("int"), (span["stop"] - span["start"]).cast("int"))
        general = F.when(word.rlike(r"\A\p{N}+\z"), "[NUMBER]").otherwise("[WORD]")
        return F.when(span["kind"] == REMOVED, "").when(span["kind"] == GENERALISED, general).otherwise(F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))

    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(acc: Column, span: Column) -> Column:
        start = F.greatest(acc["at"], span["start"])
        before = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int"))
        # An entity inside another is masked with it.
        token = F.when(span["stop"] > acc["at"], part(span)).otherwise("")
        return F.struct(F.greatest(acc["at"], span["stop"]).alias("at"), F.concat(acc["parts"], F.array(before, token)).alias("parts"))

    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    end = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    clean = F.when(F.size("spans") > 0, F.aggregate(by_start, nothing, step, end)).otherwise(F.col("text"))
    return found.select(*[clean.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
