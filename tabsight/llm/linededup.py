"""Fuzzy line deduplication by MinHash: of every group of near-equal lines one stays.

A line's shingles are the runs of ``SHINGLE_BYTES`` bytes of its UTF-8, one beginning at every byte, so at every character; a
shorter line is its own shingle. Each shingle has one 64-bit hash, which orders the shingles in ``TURNS`` ways, by its bits from
``TURN_BITS`` further on each; the first and the last of every order, ``MINIMA`` in all, are the signature. Bands are ``BANDS``
triples of minima, lines that agree in a whole band are candidates, candidates are verified by the exact Jaccard similarity of
their shingle sets, and verified links go through a distributed union-find. At similarity 0.8 a pair becomes a candidate with
probability 0.993 or more, from lines of nine shingles to lines of thousands (simulated, see the tests). Memory for a line grows
with its length: verifying holds a number a byte.

No large group is ever expanded into all its pairs. Lines that meet in a band's bucket of at most ``SMALL_BUCKET`` are compared
as pairs. In a larger one every line is compared with one leader, the line that meets the most others over all its bands (among
many near copies that is the text they come from), and lines that after that are still in different components inside a join
that puts out links only. So every candidate pair is either verified itself or connected by verified links. Sets folded to 16
bits a shingle rule pairs out ahead of the whole sets, by an exact bound. Equal lines count once from the first shuffle on.

All steps are DataFrame expressions, grouped aggregates and joins. A document is known by the hash of its id and text, so
rows that share an id only are told apart. Intermediate tables are staged in the shared folder and removed after their last
reader; lines themselves are never staged, splitting the texts again is cheaper than their disk.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsight.llm.common import deleted, let, links_to_labels, staged

SHINGLE_BYTES = 12
#: Least Jaccard similarity as a fraction, so that whole numbers are compared.
SIMILARITY = (4, 5)
MINIMA, BANDS, ROWS = 16, 12, 3
#: Orders of the shingles, each by their hashes without some of the first bits; the two ends of every order are taken.
TURNS, TURN_BITS = MINIMA // 2, 4
#: Columns of a signature: four minima each, of which 16 bits are kept.
PARTS = [f"s{p}" for p in range(MINIMA // 4)]
BLANKS = " \t\r\x0b\x0c"
#: Shingles of a row of the signature's aggregate.
PACK = 16
SMALL_BUCKET = 32
#: Groups of eight 64-bit words in the bit map that lines of a large bucket compare ahead of their sets.
MAP_GROUPS = 8
#: Lines of a large bucket that a group of the join takes from the left; the right side goes to every group.
BLOCK = 256
#: Slots of each set of wanted lines that is broadcast ahead of a join; more lines only fill it up.
SLOTS = 1 << 20


def band_triples(minima: int = MINIMA, bands: int = BANDS) -> list[tuple[int, ...]]:
    """``bands`` triples of the minima that share as few pairs as they can and use all about equally often."""
    used, met, out = [0] * minima, {}, []
    for _ in range(bands):
        cost = lambda t: (max(met.get(p, 0) for p in combinations(t, 2)), sum(used[i] for i in t))
        best = min(combinations(range(minima), ROWS), key=cost)
        out.append(best)
        for i in best:
            used[i] += 1
        for p in combinations(best, 2):
            met[p] = met.get(p, 0) + 1
    return out


def n_places(line: Column) -> Column:
    """The number of a line's shingles, repeats included."""
    return F.greatest(F.lit(1), F.octet_length(line) - (SHINGLE_BYTES - 1))


def of_shingles(line: Column, hash_: Callable[[Column], Column]) -> Column:
    """``hash_`` of each of a line's shingles."""
    one = lambda raw, i: hash_(F.substring(raw, i, F.lit(SHINGLE_BYTES)))
    return let(line.cast("binary"), lambda raw: F.transform(F.sequence(F.lit(1), n_places(raw)), lambda i: one(raw, i)))


def shingle_set(line: Column) -> Column:
    """The distinct hashes of a line's shingles."""
    return F.array_distinct(of_shingles(line, F.xxhash64))


def folded_set(line: Column) -> Column:
    """The distinct 16-bit hashes of a line's shingles, about twice the line's bytes."""
    return F.array_distinct(of_shingles(line, lambda shingle: F.shiftright(F.hash(shingle), 16).cast("short")))


def document_key() -> list[Column]:
    """128 bits that name a document: its id and text. Rows that agree in both are one document."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2")]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, no, line, h1, h2) of every line with a visible character; blanks at its ends do not count.

    h1 and h2 are 128 bits that name the line.
    """
    # The keys are worked out a document, below the explode, which is an outer one, since a plain one brings a filter that splits
    # the text once more. Trimming is dear, so only lines that begin or end with a blank are trimmed; that is asked a blank at a
    # time, since taking a line's last character counts all its characters.
    split = docs.select("doc_id", *document_key(), F.split("text", "\n").alias("parts"))
    split = split.select("doc_id", "k1", "k2", F.posexplode_outer("parts").alias("no", "raw"))
    blank = reduce(Column.__or__, [end("raw", F.lit(b)) for b in BLANKS for end in (F.startswith, F.endswith)])
    line = F.when(blank, F.btrim("raw", F.lit(BLANKS))).otherwise(F.col("raw"))
    lines = split.select("doc_id", "k1", "k2", "no", line.alias("line")).where("line <> ''")
    return lines.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def signatures(lines: DataFrame) -> DataFrame:
    """(id, h1, h2, first, n, s0, ...): a row a distinct line, with its smallest document and its number of occurrences.

    Rows of ``PACK`` neighbouring shingles carry the least and the greatest of each order into a grouped minimum and maximum,
    so equal lines already meet in the map-side combine. Of each, the last 16 bits of the shingle's hash are kept.
    """
    raw = lines.select("doc_id", "h1", "h2", F.col("line").cast("binary").alias("raw"))
    sized = raw.withColumn("last", F.greatest(F.lit(1), F.octet_length("raw") - (SHINGLE_BYTES - 1)))
    placed = sized.select("*", F.explode_outer(F.sequence(F.lit(1), F.col("last"), F.lit(PACK))).alias("at"))
    shingle = lambda k: F.substring("raw", F.least(F.col("at") + k, F.col("last")), F.lit(SHINGLE_BYTES))
    hashed = placed.select("doc_id", "h1", "h2", "at", *[F.xxhash64(shingle(k)).alias(f"x{k}") for k in range(PACK)])
    turned = lambda m: [F.shiftleft(F.col(f"x{k}"), TURN_BITS * m) if m else F.col(f"x{k}") for k in range(PACK)]
    minima = [end(of(*turned(m))).alias(f"m{2 * m + i}") for m in range(TURNS) for i, (end, of) in enumerate([(F.min, F.least), (F.max, F.greatest)])]
    found = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count_if(F.col("at") == 1).alias("n"), *minima)
    low = lambda m, at: F.shiftleft(F.shiftright(F.col(f"m{m}"), TURN_BITS * (m // 2)).bitwiseAND(F.lit(0xFFFF)), at)
    parts = [reduce(Column.bitwiseOR, [low(4 * p + i, 16 * i) for i in range(4)]).alias(part) for p, part in enumerate(PARTS)]
    return found.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "first", "n", *parts)


def bands() -> Column:
    """The keys of a signature's bands: hashes of 48 bits of it, which lines that have little in common share by chance only."""
    low = lambda m: F.shiftright(F.col(PARTS[m // 4]), 16 * (m % 4)).bitwiseAND(F.lit(0xFFFF))
    return F.array(*[F.xxhash64(F.lit(b), *map(low, triple)) for b, triple in enumerate(band_triples())])


def buckets(signed: DataFrame) -> DataFrame:
    """(key, id, n): the lines of every band bucket that holds two or more, with their number."""
    members = signed.select("id", F.explode_outer(bands()).alias("key"))
    return members.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")


def small_pairs(members: DataFrame) -> DataFrame:
    """(a, b): the pairs of lines that meet in a bucket of at most ``SMALL_BUCKET``."""
    few = members.where(F.col("n") <= SMALL_BUCKET)
    left, right = (few.select("key", F.col("id").alias(x)) for x in "ab")
    return left.join(right, "key").where("a < b").select("a", "b").distinct()


def stars(members: DataFrame) -> DataFrame:
    """(a, b): the leader of each bucket in ``members`` with each other line of it."""
    weights = members.groupBy("id").agg(F.sum("n").alias("w"))
    leads = members.join(weights, "id").groupBy("key").agg(F.max_by("id", "w").alias("lead"))
    return members.join(leads, "key").where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()


def only_wanted(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines whose two hashes both fall into a slot of the ``wanted`` lines: two sets of at most ``SLOTS`` numbers go ahead by
    broadcast, so that most other lines are not shuffled. A join on both hashes decides after this."""
    for name in ("h1", "h2"):
        slots = wanted.select(F.pmod(name, F.lit(SLOTS)).alias("slot")).distinct()
        lines = lines.withColumn("slot", F.pmod(name, F.lit(SLOTS))).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    return lines


def bit_map(hashes: Column) -> Column:
    """A set folded to ``MAP_GROUPS`` times 8 longs: each hash sets one bit."""
    bits = lambda x, at: F.shiftright(x, at).bitwiseAND(F.lit(63))
    numbers = lambda n: F.array(*[F.lit(i).cast("long") for i in range(n)])

    def word(part: Column, w: Column) -> Column:
        mine = F.filter(part, lambda x: bits(x, 6).bitwiseAND(F.lit(7)) == w)
        one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), bits(x, 0).cast("int"))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda held, x: held.bitwiseOR(one(x)))

    group = lambda g: F.filter(hashes, lambda x: F.pmod(F.shiftright(x, 9), F.lit(MAP_GROUPS)) == g)
    return F.flatten(F.transform(numbers(MAP_GROUPS), lambda g: let(group(g), lambda part: F.transform(numbers(8), lambda w: word(part, w)))))


def texts_of(lines: DataFrame, signed: DataFrame, members: DataFrame) -> DataFrame:
    """(id, line, s0, ..., k, bits): the text and signature of each line in a bucket; for a line in a large bucket also the size
    of its shingle set, which is many times the text, and its bit map, else null."""
    ids = members.groupBy("id").agg((F.max("n") > SMALL_BUCKET).alias("large"))
    wanted = staged(signed.join(ids, "id").select("id", "h1", "h2", "large", *PARTS), "wanted")
    text = only_wanted(lines, wanted).groupBy("h1", "h2").agg(F.first("line").alias("line"))
    measure = lambda s: F.struct(F.size(s).alias("k"), bit_map(s).alias("bits"))
    of = F.when(F.col("large"), let(shingle_set(F.col("line")), measure)).alias("of")
    measured = text.join(wanted, ["h1", "h2"]).select("id", "line", *PARTS, of)
    texts = staged(measured.select("id", "line", *PARTS, "of.k", "of.bits"), "texts")
    deleted(lines.sparkSession, wanted.staged_path)
    return texts


def near_sizes() -> Column:
    """Whether the sizes ka and kb allow the similarity; unequal sizes rule most pairs out."""
    over, under = SIMILARITY
    return under * F.least("ka", "kb") >= over * F.greatest("ka", "kb")


def alike(left: Column, right: Column) -> Column:
    """Whether two shingle sets of sizes ka and kb have a Jaccard similarity of ``SIMILARITY`` or more."""
    over, under = SIMILARITY
    common = F.size(F.array_intersect(left, right))
    return near_sizes() & ((under + over) * common >= over * (F.col("ka") + F.col("kb")))


def may_be_alike() -> Column:
    """False only for lines that are not alike: two maps differ in no more bits than their sets in shingles."""
    over, under = SIMILARITY
    words = F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(words, F.lit(0), lambda held, n: held + n)
    return (under + over) * apart <= (under - over) * (F.col("ka") + F.col("kb"))


def first_met() -> Column:
    """Whether ``key`` is the first band that both lines agree in, so that a pair is compared in one of its buckets only."""
    agreed = [F.when(F.col("bandsa")[i] == F.col("bandsb")[i], F.col("bandsa")[i]) for i in range(BANDS)]
    return F.col("key") == F.coalesce(*agreed)


def folds_may_be_alike() -> Column:
    """False only for lines that are not alike: their folded sets differ in no more than their sets do, and a set is no larger
    than the line has places."""
    over, under = SIMILARITY
    room = (under - over) * (F.col("placesa") + F.col("placesb"))
    sizes = F.abs(F.size("folda") - F.size("foldb"))
    apart = F.size("folda") + F.size("foldb") - 2 * F.size(F.array_intersect("folda", "foldb"))
    return ((under + over) * sizes <= room) & ((under + over) * apart <= room)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose shingle sets are alike. Folded sets, made once a line and shuffled once for both joins, rule
    nearly all others out; of what they leave the whole sets are compared."""
    over, under = SIMILARITY
    side = lambda x, *columns: texts.select(F.col("id").alias(x), *[c.alias(f"{name}{x}") for name, c in columns])
    fold = [("places", n_places(F.col("line"))), ("fold", folded_set(F.col("line")))]
    near = pairs.join(side("b", *fold), "b").join(side("a", *fold), "a").where(folds_may_be_alike()).select("a", "b", "placesa", "placesb")
    near = staged(near, "near")
    line = ("line", F.col("line"))
    lines = near.join(side("b", line), "b").join(side("a", line), "a")
    left, right = (of_shingles(F.col(f"line{x}"), F.xxhash64) for x in "ab")
    # A set is no larger than its line has places, so most pairs are settled by the first number alone.
    common = F.size(F.array_intersect(left, right))
    plainly = (under + over) * common >= over * (F.col("placesa") + F.col("placesb"))
    links = staged(lines.where(plainly | (under * common >= over * F.size(F.array_union(left, right)))).select("a", "b"), "verified")
    deleted(texts.sparkSession, near.staged_path)
    return links


def left_open(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between labels: lines that are in a large bucket together, in different components, and alike."""
    spark = members.sparkSession
    large = members.where(F.col("n") > SMALL_BUCKET)
    placed = large.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    open_ = staged(placed.join(mixed, "key"), "open")

    # Rows carry a line and its bit map, which leaves hardly a pair whose sets, many times the bytes, are made and are not alike.
    groups = F.ceil(F.col("n") / BLOCK).cast("long")
    many = open_.join(texts.select("id", "line", "k", "bits", bands().alias("bands")), "id")
    one, each = F.pmod(F.xxhash64("id"), groups), F.explode(F.sequence(F.lit(0).cast("long"), groups - 1))
    left, right = (
        many.select("key", at.alias("at"), F.col("label").alias(x), *[F.col(c).alias(c + x) for c in ("k", "line", "bits", "bands")]) for x, at in (("a", one), ("b", each))
    )
    sets = [of_shingles(F.col(f"line{x}"), F.xxhash64) for x in "ab"]
    near = (F.col("a") < F.col("b")) & first_met() & near_sizes() & may_be_alike() & alike(*sets)
    links = staged(left.join(right, ["key", "at"]).where(near).select("a", "b").distinct(), "links")
    deleted(spark, open_.staged_path)
    return links


def line_classes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, h1, h2, first, n) of the distinct lines, and (id, label) of those in a component of two or more."""
    spark = lines.sparkSession
    signed = staged(signatures(lines), "signatures")
    members = staged(buckets(signed), "buckets")
    texts = texts_of(lines, signed, members)
    pairs = small_pairs(members).unionAll(stars(members.where(F.col("n") > SMALL_BUCKET)))
    links = verified(pairs, texts)
    labels = staged(links_to_labels(links, "lines"), "labels")
    deleted(spark, links.staged_path)
    more = left_open(members, labels, texts)
    deleted(spark, members.staged_path, texts.staged_path)
    moved = links_to_labels(more, "components").select(F.col("node").alias("label"), F.col("label").alias("top"))
    first = labels.unionAll(moved.select(F.col("label").alias("node"), "label")).distinct()
    final = first.join(moved, "label", "left").select(F.col("node").alias("id"), F.coalesce("top", "label").alias("label"))
    classes = staged(final, "classes")
    deleted(spark, more.staged_path, labels.staged_path)
    return signed, classes


def removed_lines(docs: DataFrame) -> DataFrame:
    """(k1, k2, removed): the line numbers, from 0, that each document loses; documents that lose none have no row.

    Of a component the occurrence in the document with the smallest doc_id stays (null is the largest; equal ids by their
    keys), in that document the first.
    """
    spark = docs.sparkSession
    lines = lines_of(docs.select("doc_id", "text"))
    signed, classes = line_classes(lines)
    grouped = signed.join(classes, "id", "left").where("n > 1 or label is not null")
    grouped = grouped.select("h1", "h2", "first", F.coalesce("label", "id").alias("label"))
    owners = grouped.groupBy("label").agg(F.min("first").alias("owner"))
    known = staged(grouped.join(owners, "label").select("h1", "h2", "label", "owner"), "repeated")
    deleted(spark, signed.staged_path, classes.staged_path)
    found = only_wanted(lines.select("doc_id", "k1", "k2", "no", "h1", "h2"), known)
    places = ["k1", "k2", "no", "h1", "h2"]
    # Which occurrence stays is worked out a line first; a line's many occurrences only meet their own line, never a label.
    found = staged(found.join(known, ["h1", "h2"]).select(*places, F.col("doc_id").eqNullSafe(F.col("owner")).alias("owns")), "occurrences")
    least = found.where("owns").groupBy("h1", "h2").agg(F.min(F.struct("k1", "k2", "no")).alias("least"))
    kept = known.join(least, ["h1", "h2"]).groupBy("label").agg(F.min("least").alias("kept"))
    stays = staged(known.join(kept, "label").select("h1", "h2", "kept"), "kept")
    marked = found.join(stays, ["h1", "h2"]).where("k1 <> kept.k1 or k2 <> kept.k2 or no <> kept.no")
    removed = staged(marked.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("no")).alias("removed")), "removed")
    deleted(spark, known.staged_path, found.staged_path, stays.staged_path)
    return removed


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, n_lines, n_removed, removed.

    Null texts have no lines; lines without a visible character are never removed. Rows that agree in doc_id and text are one
    document and lose the same lines; rows that share only the doc_id are documents of their own, and so are those without a
    doc_id, which come last. Other columns are not read, an empty table gives an empty result.
    """
    narrow = docs.select("doc_id", *document_key(), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    found = narrow.join(removed_lines(docs), ["k1", "k2"], "left")
    removed = F.coalesce("removed", F.expr("cast(array() as array<int>)"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines; a document that loses all its lines keeps an empty text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = docs.select(row.alias("row"), *document_key()).join(removed_lines(docs), ["k1", "k2"], "left")
    kept = F.filter(F.split(F.col("row.text"), "\n"), lambda line, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return found.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
