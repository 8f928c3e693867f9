"""Language-model scoring with an Elias-Fano n-gram trie.

**Model.** Order three, interpolated absolute discounting: p(w|u,v) = a(u,v,w) + b(u,v) p(w|v), p(w|v) = a(v,w) + b(v) p(w),
where a is the discounted relative frequency of an n-gram seen ``least`` times and more, b what that leaves of the context's
mass, and p(w) = (c + 0.1) / (N + 0.1 (V + 1)). The token before a text's first is the end token.

**Trie.** Words are numbered by hash. Level one holds word hashes, counts and b; level two the successors of each word, level
three those of each kept bigram. A level stores its successors' numbers packed, sorted within each context, 16-bit quantised
a's and b's, and where a context's successors begin as an Elias-Fano coded monotone sequence. A lookup takes a context's
range from the pointers and searches the first successor that is not smaller than the word in it, after a sparse sample of
(context, word) keys has narrowed the range to a block.

**Spark's part.** Every level is cut into shards by the context's hash range; map tasks count n-grams in runs of documents,
one shuffle brings a shard's counts together, and its task writes one file to the shared folder. The driver sees one row of
sizes a shard. Scoring tasks map the files they touch, so memory holds only pages in use, and a lost executor's tasks map
them again. Level three counts only n-grams both of whose bigrams are kept: no other can be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tabsight.llm.common import shared_path, shuffles_dropped, slices, staged
from tabsight.llm.eliasfano import ef_encode, ef_ranges, map_arrays, pack, runs, summed, unpack, write_arrays

SMOOTH = 0.1
DISCOUNT = 0.75
#: An n-gram of two or three words is kept from this count on if the caller names none; 1 keeps all.
LEAST = 1
FOLDS = 10
#: One shard for so many documents, or for so many bytes of text if that makes more shards.
SHARD_DOCS = 15_000
SHARD_BYTES = 32 << 20
#: Beyond so many shards partial counts are summed by (shard, hash of the n-gram) before a shard's task gathers them.
MERGE_FROM = 64
#: Hash ranges of a shard's n-grams in that sum.
PARTS = 16
#: Tokens handled at once.
RUN_TOKENS = 1_000_000
#: A task's table of words is summed beyond so many, and starts anew if over half of them are distinct.
TABLE_WORDS = 600_000
#: Bytes of text split at once; a longer text is split alone.
RUN_BYTES = 4 << 20
#: One sampled key for so many successors.
SAMPLE = 16
#: Steps of a quantised probability in a decade.
STEPS = 4096
#: Hash of the end token: no word holds a blank.
END = xxhash.xxh64_intdigest(b" end")


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.minimum(np.rint(-np.log10(np.clip(p, 0, 1)) * STEPS), 65535).astype(np.uint16)


#: Value of each code; the last is zero.
VALUES = np.append(10.0 ** (-np.arange(65535) / STEPS), 0.0)


def bit_width(n: int) -> int:
    return max(1, int(n).bit_length())


def shard_of_hash(h: np.ndarray, shards: int) -> np.ndarray:
    """Which of ``shards`` equal ranges of the hashes."""
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def places_by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs (below zero is none) and where, from one sort however many there are."""
    small = shard.astype(np.int16 if len(shard) and shard.max() < 1 << 15 else np.int64)
    order = np.argsort(small, kind="stable")
    own, first = runs(small[order])
    for s, a, b in zip(own, first, np.append(first[1:], len(order))):
        if s >= 0:
            yield int(s), order[a:b]


@dataclass
class Trie:
    """Where the levels are and how large; opens files when first asked for."""

    folder: str
    shards: int
    #: First number of each shard's words and bigrams, and the total at the end.
    words: np.ndarray | None = None
    bigrams: np.ndarray | None = None
    tokens: int = 0
    #: Names of the files that exist; a shard without n-grams of an order has none for it.
    present: frozenset = frozenset()
    files: dict = field(default_factory=dict)

    @property
    def parts(self) -> int:
        return PARTS if self.shards > MERGE_FROM else 1

    def __getstate__(self):
        return self.__dict__ | {"files": {}}

    @property
    def size(self) -> int:
        return int(self.words[-1])

    @property
    def radix(self) -> np.uint64:
        """Keys are context times radix plus word; the number ``size`` is the unknown word's."""
        return np.uint64(self.size + 1)

    def file(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.files:
            self.files[name] = map_arrays(self.folder, name)
        return self.files[name]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; unknown words get ``size``."""
        out = np.full(len(hashes), self.size, np.int64)
        shard = shard_of_hash(hashes, self.shards)
        for s, at in places_by_shard(shard):
            if self.words[s] < self.words[s + 1]:
                known = self.file(f"words-{s}")["h"]
                k = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
                out[at] = np.where(known[k] == hashes[at], k + self.words[s], self.size)
        return out

    def gather(self, level: str, key: str, index: np.ndarray, starts: np.ndarray, default: float) -> np.ndarray:
        """Values of an array that is spread over the shards, at global numbers; ``default`` outside."""
        out = np.full(len(index), default)
        shard = np.searchsorted(starts, index, "right") - 1
        shard[(index < 0) | (index >= starts[-1])] = -1
        for s, at in places_by_shard(shard):
            if f"{level}-{s}" in self.present:
                x = self.file(f"{level}-{s}")[key][index[at] - starts[s]]
                out[at] = VALUES[x] if x.dtype == np.uint16 else x
        return out

    def base(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and smoothed probabilities of words."""
        c = self.gather("words", "c", index, self.words, 0.0)
        return c, (c + SMOOTH) / (self.tokens + SMOOTH * (self.size + 1))

    def successors(self, level: str, keys: np.ndarray, starts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams ``keys`` (sorted: context times radix plus word) in a level, or -1."""
        out = np.full(len(keys), -1, np.int64)
        cut = np.searchsorted(keys, starts.astype(np.uint64) * self.radix)
        for s in range(self.shards):
            a, b = cut[s], cut[s + 1]
            if a == b or totals[s] == totals[s + 1]:
                continue
            f = self.file(f"{level}-{s}")
            context = (keys[a:b] // self.radix).astype(np.int64) - int(starts[s])
            word = keys[a:b] % self.radix
            own, first = runs(context)
            repeat = np.diff(np.append(first, len(context)))
            lo, end = (np.repeat(x, repeat) for x in ef_ranges(f, own))
            long = np.flatnonzero(end - lo > SAMPLE)
            block = np.searchsorted(f["sample"], context[long].astype(np.uint64) * self.radix + word[long], "right") * SAMPLE
            lo[long], end[long] = np.maximum(lo[long], block - SAMPLE), np.minimum(end[long], block)
            bits = int(f["width"][0])
            # only keys whose range is open are looked at again
            at = np.flatnonzero(lo < end)
            low, high, wanted = lo[at], end[at], word[at]
            while len(at):
                mid = (low + high) >> 1
                found = unpack(f["ids"], mid, bits)
                out[a + at[found == wanted]] = mid[found == wanted] + int(totals[s])
                less = found < wanted
                low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
                open_ = np.flatnonzero((low < high) & (found != wanted))
                at, low, high, wanted = at[open_], low[open_], high[open_], wanted[open_]
        return out


def level_arrays(context: np.ndarray, word: np.ndarray, counts: np.ndarray, contexts: np.ndarray, radix: np.uint64, last: bool) -> dict:
    """A shard's level: ``context`` (local, sorted), ``word`` and ``counts`` of its n-grams, ``contexts`` the contexts' counts.

    Nothing follows the ``last`` level's n-grams, so it needs no counts.
    """
    held = {} if last else {"c": counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)}
    share = (counts - DISCOUNT) / np.maximum(contexts[context], 1)
    rest = 1 - np.bincount(context, share, len(contexts))
    pointers = np.searchsorted(context, np.arange(len(contexts) + 1))
    width = bit_width(int(radix))
    keys = context.astype(np.uint64) * radix + word
    return ef_encode(pointers) | held | {
        "ids": pack(word, width),
        "width": np.array([width], np.int64),
        "sample": keys[::SAMPLE],
        "a": quantised(share),
        "b": quantised(rest),
    }


# --- what the map tasks do -------------------------------------------------------------------------------------------------


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, each token's place among them, and where each text's tokens begin, and the last end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    tokens = lists.flatten()
    real = pc.binary_length(tokens).to_numpy(zero_copy_only=False) > 0
    ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    encoded = tokens.dictionary_encode()
    place = encoded.indices.to_numpy(zero_copy_only=False)
    if not real.all():  # blanks at a text's ends leave empty pieces
        ends, place = np.append(0, np.cumsum(real))[ends], place[real]
    words = encoded.dictionary.cast(pa.binary() if pa.types.is_string(tokens.type) else pa.large_binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), place, ends


def count_words(trie: Trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0

        def rows():
            h, c = summed(*map(np.concatenate, zip(*held)))
            return by_shard(shard_of_hash(h, trie.shards), h, c, trie.parts)

        for batch in batches:
            for part in slices(batch, limit=RUN_BYTES):
                h, place, _ = words_of(part.column("text"))
                c = np.bincount(place, minlength=len(h))
                held.append((h[c > 0], c[c > 0]))
                ends += part.num_rows
                if sum(len(h) for h, _ in held) > TABLE_WORDS:
                    held = [summed(*map(np.concatenate, zip(*held)))]
                    if len(held[0][0]) > TABLE_WORDS // 2:
                        yield rows()
                        held = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        if ends:
            held.append((np.array([END], np.uint64), np.array([ends], np.int64)))
            yield rows()

    return run


def by_shard(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row a shard and hash range of its keys: keys and counts as bytes."""
    part = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % parts
    group = shard * parts + part
    order = np.lexsort((keys, group))
    own, first = runs(group[order])
    last = np.append(first[1:], len(order))
    rows = [(*divmod(int(g), parts), thin_keys(keys[order[a:b]]), thin_counts(counts[order[a:b]])) for g, a, b in zip(own, first, last)]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["shard", "part", "keys", "counts"])


def thin_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of all: only as many bytes a key as the largest difference has."""
    steps = np.diff(np.sort(keys), prepend=np.uint64(0)).astype("<u8")
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8 or 1
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def wide_keys(raw: bytes) -> np.ndarray:
    width, steps = raw[0], np.frombuffer(raw, np.uint8, offset=1)
    out = np.zeros((len(steps) // width, 8), np.uint8)
    out[:, :width] = steps.reshape(width, -1).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def thin_counts(counts: np.ndarray) -> bytes:
    """A byte a count, 255 for those that follow in full at the end."""
    large = counts >= 255
    return int(large.sum()).to_bytes(8, "little") + np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def wide_counts(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    counts = np.frombuffer(raw, np.uint8, len(raw) - 8 - 8 * n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<i8", n, len(raw) - 8 * n)
    return counts


def encode(trie: Trie):
    """Texts to token numbers, with the counts and the base score of the contract."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = trie.numbers(np.array([END], np.uint64))
        end_count, end_p = trie.base(end)
        for batch in batches:
            for part in slices(batch, limit=RUN_BYTES):
                hashes, place, ends = words_of(part.column("text"))
                numbers = trie.numbers(hashes)
                c, p = trie.base(numbers)
                ids, known, log = numbers.astype(np.uint32)[place], (c > 0)[place], np.log10(p)[place]
                rows = []
                for a, b in zip(ends, ends[1:]):
                    n_known, base = int(known[a:b].sum()) + int(end_count[0] > 0), float(log[a:b].sum() + np.log10(end_p[0]))
                    rows.append((int(b - a) + 1, n_known, base, np.append(ids[a:b], end.astype(np.uint32)).tobytes()))
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.binary()))]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *columns], names)

    return run


def token_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of documents: the rows, all their token numbers, and where each document begins."""
    for batch in batches:
        texts = [np.frombuffer(x, np.uint32) for x in batch.column("ids").to_pylist()]
        start, held = 0, 0
        for i, ids in enumerate([*texts, None]):
            if i > start and (ids is None or held + len(ids) > RUN_TOKENS):
                lengths = [len(x) for x in texts[start:i]]
                yield batch.slice(start, i - start), np.concatenate(texts[start:i]).astype(np.int64), np.cumsum([0, *lengths[:-1]])
                start, held = i, 0
            held += len(ids) if ids is not None else 0


def bigram_keys(trie: Trie, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it; a text's first token follows the end token, its last."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first] = ids[-1]
    return before.astype(np.uint64) * trie.radix + ids.astype(np.uint64)


def distinct_places(keys: np.ndarray, find: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``find`` of the sorted distinct keys, back in place."""
    distinct, back = np.unique(keys, return_inverse=True)
    return find(distinct)[back]


def bigram_numbers(trie: Trie, keys: np.ndarray) -> np.ndarray:
    return distinct_places(keys, lambda k: trie.successors("pairs", k, trie.words, trie.bigrams))


def count_ngrams(trie: Trie, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, first in token_runs(batches):
            keys, starts = bigram_keys(trie, ids, first), trie.words
            if order == 3:
                pair = bigram_numbers(trie, keys)
                inner = np.ones(len(ids), bool)
                inner[first] = False
                at = np.flatnonzero(inner[1:] & (pair[1:] >= 0) & (pair[:-1] >= 0)) + 1
                keys, starts = pair[at - 1].astype(np.uint64) * trie.radix + ids[at].astype(np.uint64), trie.bigrams
            distinct, counts = np.unique(keys, return_counts=True)
            if len(distinct):
                yield by_shard(np.searchsorted(starts, (distinct // trie.radix).astype(np.int64), "right") - 1, distinct, counts, trie.parts)

    return run


def score_runs(trie: Trie, trigrams: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, first in token_runs(batches):
            keys = bigram_keys(trie, ids, first)
            pair = bigram_numbers(trie, keys)
            context = (keys // trie.radix).astype(np.int64)
            p = trie.base(ids)[1]
            p = trie.gather("pairs", "a", pair, trie.bigrams, 0.0) + trie.gather("pairs", "b", context, trie.words, 1.0) * p
            inner = np.ones(len(ids), bool)
            inner[first] = False
            at = np.flatnonzero(inner[1:] & (pair[:-1] >= 0)) + 1
            node = pair[at - 1]
            triple = distinct_places(
                node.astype(np.uint64) * trie.radix + ids[at].astype(np.uint64),
                lambda k: trie.successors("triples", k, trie.bigrams, trigrams),
            )
            p[at] = trie.gather("triples", "a", triple, trigrams, 0.0) + trie.gather("triples", "b", node, trie.bigrams, 1.0) * p[at]
            score = np.add.reduceat(np.log10(p), first)
            names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], pa.array(score)], [*names, "score"])

    return run


# --- what a shard's task does ----------------------------------------------------------------------------------------------


def gathered(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = np.concatenate([wide_keys(x) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([wide_counts(x) for x in table.column("counts").to_pylist()])
    return table.column("shard")[0].as_py(), *summed(keys, counts)


def merge(table: pa.Table) -> pa.Table:
    """The partial counts of one hash range of a shard as one row."""
    shard, keys, counts = gathered(table)
    return pa.table({"shard": [shard], "part": [table.column("part")[0].as_py()], "keys": [thin_keys(keys)], "counts": [thin_counts(counts)]})


SIZES = "shard long, size long, tokens long"


def sizes(shard: int, size: int, tokens: int) -> pa.Table:
    return pa.table({"shard": [shard], "size": [size], "tokens": [tokens]})


def write_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        shard, h, c = gathered(table)
        write_arrays(folder, f"words-{shard}", {"h": h, "c": c.astype(np.uint64)})
        return sizes(shard, len(h), int(c.sum()))

    return run


def write_level(trie: Trie, order: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        shard, keys, counts = gathered(table)
        kept = counts >= least
        keys, counts = keys[kept], counts[kept]
        level, starts, above = ("pairs", trie.words, "words") if order == 2 else ("triples", trie.bigrams, "pairs")
        context = (keys // trie.radix).astype(np.int64) - int(starts[shard])
        contexts = trie.file(f"{above}-{shard}")["c"].astype(np.float64)
        write_arrays(trie.folder, f"{level}-{shard}", level_arrays(context, keys % trie.radix, counts, contexts, trie.radix, order == 3))
        return sizes(shard, len(keys), int(counts.sum()))

    return run


def built(trie: Trie, level: str, counted: DataFrame, write) -> tuple[Trie, np.ndarray, int]:
    """Run the shards' tasks: the trie with its new files, where each shard's numbers begin, and the sum of all counts."""
    if trie.parts > 1:
        counted = counted.groupBy("shard", "part").applyInArrow(merge, COUNTED)
    with shuffles_dropped(counted.sparkSession):
        done = counted.groupBy("shard").applyInArrow(write, SIZES).collect()  # one row a shard
    size = np.zeros(trie.shards + 1, np.int64)
    for r in done:
        size[r.shard + 1] = r.size
    present = trie.present | {f"{level}-{r.shard}" for r in done}
    return replace(trie, present=present), np.cumsum(size), sum(r.tokens for r in done)


COUNTED = "shard long, part long, keys binary, counts binary"


def score(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): the contract's columns, by a model of the n-grams seen ``least`` times.

    Null and empty texts are the end token alone. Rows without a doc_id are held out. Repeated rows are learned from and
    scored as often as they occur; other columns are not read; an empty table gives an empty result. With nothing to learn
    from every token has probability one of one unknown word.
    """
    spark = docs.sparkSession
    remainder = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS
    texts = docs.select("doc_id", F.coalesce(remainder == 0, F.lit(True)).alias("held_out"), "text")
    volume = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    trie = Trie(shared_path(spark, "trie"), 1 + max(volume.docs // SHARD_DOCS, volume.bytes // SHARD_BYTES))

    counted = texts.where("not held_out").select("text").mapInArrow(count_words(trie), COUNTED)
    trie, words, tokens = built(trie, "words", counted, write_words(trie.folder))
    trie = replace(trie, words=words, tokens=tokens)
    if trie.size >= (1 << 32) - 1:
        raise ValueError("word numbers are 32-bit; this corpus has more distinct words")

    kind = docs.schema["doc_id"].dataType.simpleString()
    shown = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double"
    numbered = staged(texts.mapInArrow(encode(trie), shown + ", ids binary"), "numbers")
    learned = numbered.where("not held_out").select("ids")

    trie, bigrams, _ = built(trie, "pairs", learned.mapInArrow(count_ngrams(trie, 2), COUNTED), write_level(trie, 2, least))
    trie = replace(trie, bigrams=bigrams)
    if int(trie.bigrams[-1]) * (trie.size + 1) >= 1 << 64:
        raise ValueError("keys of three words are 64-bit; this corpus has more bigrams times words")
    trie, trigrams, _ = built(trie, "triples", learned.mapInArrow(count_ngrams(trie, 3), COUNTED), write_level(trie, 3, least))

    scored = numbered.mapInArrow(score_runs(trie, trigrams), shown + ", score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
