"""URL filter, line dedup, language model, shards, SimHash and the pipeline against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import functions as F

from tabsight.llm import decontaminate, linededup, lmscore, shards, simhash, urlfilter
from tabsight.llm.common import links_to_labels
from tabsight.llm.eliasfano import ef_access, ef_encode, ef_ranges, pack, unpack

from .helpers import AWKWARD, Groups, blank_words, frame, lower_ascii, remainder, rows


def test_url_rules(spark):
    hard = ["http://COM/x", "http://xcom/a", "https://www.example.com/en/?q#f", "https://a.www.example.com/en/1", "http://example.com/en", "no scheme", None, "", "a://b://c/d", "http://net/es/", "http://x.net/es/\nfoo?a"]
    data = rows(name="pages", columns="page_id, url") + [(9000 + i, u) for i, u in enumerate(hard)]
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    found = {r.page_id: r for r in urlfilter.judge(frame(spark, data, "page_id long, url string").drop("label")).collect()}
    for page_id, url in data:
        host = path = ""
        if url and (k := url.find("://")) >= 0:
            m = re.match(r"([^/?#]*)([^?#]*)", url[k + 3 :])
            host, path = lower_ascii(m[1]), m[2]
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        r = found[page_id]
        assert (r.host, r.path, r.rule) == (host, path, best and best[1] + best[2])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")


def test_url_model_learns_from_a_labelled_table(spark):
    good = [(f"news{i}.site.org", f"/articles/{i}", 0) for i in range(60)]
    bad = [(f"cheap-pills{i}.shop.biz", f"/buy/now-{i}", 1) for i in range(60)]
    weights = urlfilter.fit(good[:40] + bad[:40])
    assert all(urlfilter.probability(weights, h, p) < 0.5 for h, p, _ in good[40:])
    assert all(urlfilter.probability(weights, h, p) > 0.5 for h, p, _ in bad[40:])
    assert urlfilter.probability(urlfilter.fit([]), "a", "/") == 0.5
    assert urlfilter.judge(frame(spark, [], "page_id long, url string")).count() == 0


def test_line_dedup_equals_all_pairs(spark):
    base = " ".join(f"token{i}" for i in range(60))
    near = [(9500 + k, base.replace(f"token{5 * k + 3} ", f"other{k} ") + "\nown line " + chr(97 + k) * 20) for k in range(8)]
    data = rows() + AWKWARD + near + [(9005, "same words here\nsame words here")]
    places = {}
    for doc_id, text in sorted({d for d in data if d[1]}):
        for no, line in enumerate(text.split("\n")):
            if line := line.strip(" \t\r\x0b\x0c"):
                places.setdefault(line, []).append((doc_id, no))
    sets = {x: frozenset(x.encode()[i : i + 12] for i in range(max(1, len(x.encode()) - 11))) for x in places}
    holders = defaultdict(list)
    for x, s in sets.items():
        for g in s:
            holders[g].append(x)
    groups = Groups(places)
    for x, s in sets.items():
        for y, k in Counter(y for g in s for y in holders[g] if y > x).items():
            if k >= 0.8 * (len(s) + len(sets[y]) - k):
                groups.join(x, y)
    members = defaultdict(list)
    for x, at in places.items():
        members[groups.top(x)] += at
    gone = defaultdict(set)
    for at in members.values():
        for doc_id, no in at:
            if (doc_id, no) != min(at):
                gone[doc_id].add(no)
    found = linededup.dedup_report(frame(spark, data)).collect()
    assert len(found) == len(data)
    # Banding may miss a pair in some hundreds; it never makes one up.
    assert all(set(r.removed) <= gone[r.doc_id] for r in found)
    assert sum(r.n_removed for r in found if r.doc_id != 9005) >= 0.99 * sum(len(v) for d, v in gone.items() if d != 9005)
    kept = {r.doc_id: r.text for r in linededup.drop_lines(frame(spark, near)).collect()}
    assert kept[9500] == near[0][1] and kept[9501] == near[1][1].split("\n")[1]


def test_line_dedup_of_nothing_and_of_unspaced_text(spark):
    assert linededup.dedup_report(frame(spark, [])).count() == 0
    han = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈剑号巨阙珠称夜光"
    data = [(1, han), (2, han[:40] + "新" + han[40:]), (3, han[::-1]), (4, None), (None, han)]
    assert {r.doc_id: r.n_removed for r in linededup.dedup_report(frame(spark, data)).collect()} == {1: 0, 2: 0 if _jaccard(han, data[1][1]) < 0.8 else 1, 3: 0, 4: 0, None: 1}


def test_line_dedup_sees_every_character(spark):
    text = "A plain sentence of some length that two documents share but for one place in its last word, "
    pairs = [
        ("transaction_0001", "transaction_0002"),
        ("2024-01-15T09:00:01", "2024-01-15T05:47:01"),
        ("id\r" + "0123456789abcdef" * 2, "id\r" + "0123456789abXXXX" * 2),
        ("short 1", "short 2"),
        (text + "unremarkable", text + "unremarkably"),
        (text[::-1] * 3 + "0123456789abcdefghij", text[::-1] * 3 + "0123456789abcdEFghij"),
    ]
    data = [(2 * i + k, line) for i, pair in enumerate(pairs) for k, line in enumerate(pair)]
    every = lambda x: {x[i : i + 12] for i in range(max(1, len(x) - 11))}
    alike = [len(every(a) & every(b)) >= 0.8 * len(every(a) | every(b)) for a, b in pairs]
    assert alike == [False] * 4 + [True] * 2
    found = {r.doc_id: r.n_removed for r in linededup.dedup_report(frame(spark, data)).collect()}
    assert found == {2 * i + k: int(k and near) for i, near in enumerate(alike) for k in (0, 1)}


def test_line_dedup_tells_rows_with_one_id_apart(spark):
    data = [(1, "a shared line of text\nsecond line"), (1, "other text\na shared line of text"), (2, "a shared line of text"), (None, "second line\nfresh"), (2, "a shared line of text")]
    left = sorted(r.text for r in linededup.drop_lines(frame(spark, data)).collect())
    ones = [t for t in left if "a shared line of text" in t]
    assert len(ones) == 1 and "fresh" in left and left.count("") == 2
    assert sum("second line" in t for t in left) == 1 and sum("other text" in t for t in left) == 1


def test_line_dedup_of_large_buckets_and_very_long_lines(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SMALL_BUCKET", 3)
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    families = [[word() for _ in range(40)] for _ in range(3)]
    data = []
    for f, base in enumerate(families):  # chains: each neighbour is near, the ends are not
        for k in range(12):
            base = [*base[:k], word(), *base[k + 1 :]]
            data.append((100 * f + k, " ".join(base)))
    found = {r.doc_id: r.n_removed for r in linededup.dedup_report(frame(spark, data)).collect()}
    assert found == {d: int(d % 100 > 0) for d, _ in data}
    long = " ".join(word() for _ in range(20_000))
    report = linededup.dedup_report(frame(spark, [(1, long), (2, long + " end"), (3, long[::-1])])).collect()
    assert {r.doc_id: r.n_removed for r in report} == {1: 0, 2: 1, 3: 0}


def test_bit_maps_never_rule_out_alike_lines(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in (1, 9, 200, 900, 5000):
        base = rng.integers(-(1 << 62), 1 << 62, n)
        for apart in (0, n // 20, n // 9, n // 4, n):
            rows.append((base.tolist(), [*base[apart:].tolist(), *rng.integers(-(1 << 62), 1 << 62, apart).tolist()]))
    sets = spark.createDataFrame(rows, "sa array<long>, sb array<long>")
    maps = sets.select("*", *[linededup.bit_map(F.col(f"s{x}")).alias(f"bits{x}") for x in "ab"], *[F.size(f"s{x}").alias(f"k{x}") for x in "ab"])
    found = maps.select("sa", "sb", "bitsa", linededup.may_be_alike().alias("may"), linededup.alike(F.col("sa"), F.col("sb")).alias("alike")).collect()
    assert len(found) == len(rows) and any(not r.may for r in found)
    for r in found:
        a, b = set(r.sa), set(r.sb)
        assert r.alike == (5 * len(a & b) >= 4 * len(a | b)) and (r.may or not r.alike)
        assert len(r.bitsa) == 8 * linededup.MAP_GROUPS and sum(bin(w & (1 << 64) - 1).count("1") for w in r.bitsa) <= len(a)


def test_bands_find_pairs_of_the_least_similarity():
    rng, triples, shift = np.random.default_rng(0), linededup.band_triples(), 64 // linededup.MINIMA
    turn = lambda x, m: (x << np.uint64(m * shift)) | (x >> np.uint64(64 - m * shift)) if m else x
    for size, common in ((9, 8), (18, 16), (45, 40), (90, 80), (200, 178)):
        missed = 0
        for _ in range(1000):
            a, b = (np.concatenate([c, rng.integers(0, 1 << 63, size - common, np.uint64) << np.uint64(1)]) for c in [rng.integers(0, 1 << 63, common, np.uint64) << np.uint64(1)] * 2)
            same = [turn(a, m).min() == turn(b, m).min() for m in range(linededup.MINIMA)]
            missed += not any(all(same[i] for i in t) for t in triples)
        assert missed <= 15, (size, missed)


def test_line_signatures_keep_both_ends_of_each_order(spark):
    texts = ["a short one", "tiny", "the quick brown fox jumps over the lazy dog " * 9, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich"]
    lines = linededup.lines_of(frame(spark, list(enumerate(texts))))
    h1 = {r.h1: r.line for r in lines.collect()}
    found = {h1[r.h1]: [r[p] >> 16 * i & 0xFFFF for p in linededup.PARTS for i in range(4)] for r in linededup.signatures(lines).collect()}
    for line in (t.strip() for t in texts):
        raw = line.encode()
        hashes = np.array([xxhash.xxh64(raw[i : i + 12], seed=42).intdigest() for i in range(max(1, len(raw) - 11))], np.uint64)
        expected = []
        for m in range(linededup.TURNS):
            order = np.left_shift(hashes, np.uint64(linededup.TURN_BITS * m)).view(np.int64)
            expected += [int(hashes[order.argmin()]) & 0xFFFF, int(hashes[order.argmax()]) & 0xFFFF]
        assert found[line] == expected


def test_both_ends_of_shifted_orders_find_pairs_of_the_least_similarity():
    rng, triples = np.random.default_rng(0), linededup.band_triples()
    for size, common in ((9, 8), (18, 16), (45, 40), (90, 80), (200, 178), (2000, 1778)):
        missed = 0
        for _ in range(1000):
            both = rng.integers(0, 1 << 64, common, np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 1 << 64, size - common, np.uint64)]) for _ in range(2))
            turned = [[np.left_shift(x, np.uint64(linededup.TURN_BITS * m)).view(np.int64) for x in (a, b)] for m in range(linededup.TURNS)]
            same = [end(x) == end(y) for x, y in turned for end in (np.min, np.max)]
            missed += not any(all(same[i] for i in t) for t in triples)
        assert missed <= 10, (size, missed)


def test_line_dedup_splits_a_text_and_shuffles_band_keys_once(spark):
    lines = linededup.lines_of(frame(spark, [(1, "one line\nand one more")]))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(lines).count("split(") == 1
    parts = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, (2, len(linededup.PARTS)), np.int64).tolist()
    signed = spark.createDataFrame([(1, *parts[0]), (2, *parts[0]), (3, *parts[1])], ["id", *linededup.PARTS])
    found = linededup.buckets(signed)
    assert plan(found).count("Exchange hashpartitioning(key") == 1
    assert sorted((r.id, r.n) for r in found.collect()) == [(1, 2)] * linededup.BANDS + [(2, 2)] * linededup.BANDS


def test_wanted_lines_pass_and_most_others_do_not(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SLOTS", 1 << 10)
    lines = linededup.lines_of(frame(spark, [(1, "\n".join(f"line number {i}" for i in range(2000)))]))
    wanted = lines.where("no % 10 = 0").select("h1", "h2")
    found = [r.no for r in linededup.only_wanted(lines, wanted).collect()]
    assert {no for no in found if no % 10 == 0} == set(range(0, 2000, 10)) and len(found) < 350


def test_folded_sets_never_rule_out_alike_lines(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    pairs = []
    for n in (1, 3, 30, 400, 3000):
        base = [word() for _ in range(n)]
        for apart in (0, 1, n // 60, n // 30, n // 15, n):
            pairs.append((" ".join(base), " ".join([*[word() for _ in range(apart)], *base[apart:]])))
    pairs += [("ab" * 40, "ab" * 400), ("tiny", "tinY")]
    sides = spark.createDataFrame(pairs, "a string, b string")
    columns = [c for x in "ab" for c in (linededup.n_places(F.col(x)).alias(f"places{x}"), linededup.folded_set(F.col(x)).alias(f"fold{x}"))]
    found = [r.may for r in sides.select("a", "b", *columns).select(linededup.folds_may_be_alike().alias("may")).collect()]
    every = lambda x: {x[i : i + 12] for i in range(max(1, len(x) - 11))}
    alike = [5 * len(every(a) & every(b)) >= 4 * len(every(a) | every(b)) for a, b in pairs]
    assert all(may or not near for may, near in zip(found, alike)) and not all(found) and any(alike)
    texts = spark.createDataFrame([(2 * i + k, line) for i, pair in enumerate(pairs) for k, line in enumerate(pair)], "id long, line string")
    links = linededup.verified(spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(pairs))], "a long, b long"), texts)
    assert {r.a // 2 for r in links.collect()} == {i for i, near in enumerate(alike) if near}


def _jaccard(a, b):
    s, t = ({x.encode()[i : i + linededup.SHINGLE_BYTES] for i in range(len(x.encode()) - linededup.SHINGLE_BYTES + 1)} for x in (a, b))
    return len(s & t) / len(s | t)


def test_labels_of_links(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 300)]
    found = dict(map(tuple, links_to_labels(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100, 300: 300, 301: 300}
    assert links_to_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packed_and_monotone_sequences():
    draw = np.random.default_rng(1)
    for values in ([], [0], [5, 5, 5], np.sort(draw.integers(0, 10**6, 3000)), np.arange(2000)):
        values = np.asarray(values, np.int64)
        assert (ef_access(ef_encode(values), np.arange(len(values))) == values).all()
    for bits in (1, 7, 32, 33, 63):
        values = draw.integers(0, 1 << bits, 500).astype(np.uint64)
        assert (unpack(pack(values, bits), np.arange(500), bits) == values).all()


def test_language_model_equals_its_formula(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "SHARD_DOCS", 50)
    data = rows() + AWKWARD + [(9600, "unseenword unseenword")]
    tokens = {d: [*blank_words(lower_ascii(t or "")), None] for d, t in data}
    train = [d for d in tokens if remainder(d, 10)]
    one = Counter(w for d in train for w in tokens[d])
    n, v = sum(one.values()), len(one)
    two, three = Counter(), Counter()
    for d in train:
        q = [None, *tokens[d]]
        two.update(zip(q, q[1:]))
        three.update(zip(q, q[1:], q[2:]))
    two2, three2 = ({k: c for k, c in x.items() if c >= 2} for x in (two, three))
    rest2, rest3 = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
    for (a, _), c in two2.items():
        rest2[a] -= (c - 0.75) / one[a]
    for (a, b, _), c in three2.items():
        rest3[a, b] -= (c - 0.75) / two[a, b]
    p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda a, w: ((two2[a, w] - 0.75) / one[a] if (a, w) in two2 else 0) + (rest2[a] if a in one else 1) * p1(w)

    def p3(a, b, w):
        if (a, b) not in two2:
            return p2(b, w)
        return ((three2[a, b, w] - 0.75) / two[a, b] if (a, b, w) in three2 else 0) + rest3[a, b] * p2(b, w)

    found = lmscore.score(frame(spark, data), least=2).collect()
    assert len(found) == len(data)
    for r in found:
        t = tokens[r.doc_id]
        q = [None, *t]
        exact = math.log10(p2(None, t[0])) + sum(math.log10(p3(*x)) for x in zip(q, q[1:], q[2:]))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(one[w] > 0 for w in t), n)
        assert r.held_out == (remainder(r.doc_id, 10) == 0)
        assert abs(r.base_score - sum(math.log10(p1(w)) for w in t)) < 1e-6
        assert abs(r.score - exact) < 0.001 * len(t)  # quantised


def test_language_model_of_the_query_keeps_what_was_seen_once(spark, tmp_path):
    from tabsight.llm.queries import QUERIES

    data = [(i, t) for i, t in enumerate(["a b c d", "a b d c", "c a b b", "d d a", "x y z"] * 2 + ["q r s", "b c a"]) if remainder(i, 10)]
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    one, two, three = Counter(), Counter(), Counter()
    for _, t in data:
        q = [None, *t.split(), None]
        one.update(q[1:])
        two.update(zip(q, q[1:]))
        three.update(zip(q, q[1:], q[2:]))
    assert {1} < set(two.values()) and {1} < set(three.values())
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda a, w: (two[a, w] - 0.75) / one[a] + (1 - sum(c - 0.75 for k, c in two.items() if k[0] == a) / one[a]) * p1(w)
    p3 = lambda a, b, w: (three[a, b, w] - 0.75) / two[a, b] + (1 - sum(c - 0.75 for k, c in three.items() if k[:2] == (a, b)) / two[a, b]) * p2(b, w)
    found = {r.doc_id: r for r in QUERIES["op8_lm_score"](spark, str(tmp_path)).collect()}
    assert len(found) == len(data)
    for doc_id, t in data:
        q = [None, *t.split(), None]
        exact = math.log10(p2(None, q[1])) + sum(math.log10(p3(*x)) for x in zip(q, q[1:], q[2:]))
        assert abs(found[doc_id].score - exact) < 0.001 * len(q)


def test_language_model_shards_follow_the_bytes_of_text(spark, monkeypatch):
    data = rows() + AWKWARD
    seen = []
    built = lmscore.built
    monkeypatch.setattr(lmscore, "built", lambda trie, *rest: (seen.append(trie.shards), built(trie, *rest))[1])
    columns = lambda: {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.score, 6)) for r in lmscore.score(frame(spark, data)).collect()}
    whole = columns()
    size = sum(len((t or "").encode()) for _, t in data)
    monkeypatch.setattr(lmscore, "SHARD_BYTES", size // 5)
    monkeypatch.setattr(lmscore, "RUN_TOKENS", 2_000)
    cut = columns()
    monkeypatch.setattr(lmscore, "MERGE_FROM", 2)
    assert columns() == cut == whole
    assert seen[:3] == [1] * 3 and min(seen[3:]) >= 6


def test_language_model_without_training_rows(spark):
    held = next(i for i in range(100) if remainder(i, 10) == 0)
    found = lmscore.score(frame(spark, [(held, "some words")])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found] == [(3, 0, 0, 0.0)]
    assert lmscore.score(frame(spark, [])).count() == 0


def test_shards_are_even_and_gapless(spark):
    data = [(*r, "en", f"s{r[0] % 7}") for r in rows()] + [(d, t, None, None) for d, t in AWKWARD]
    found = shards.digest(shards.hilbert_shards(frame(spark, data, "doc_id long, text string, lang string, source string"))).collect()
    text = {d: t for d, t, *_ in data}
    count = Counter(r.shard for r in found)
    assert set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    for s, n in count.items():
        assert sorted(r.slot for r in found if r.shard == s) == list(range(n))
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.law == "rows" and r.grown_shard is None for r in found)
    by_place = sorted(found, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in by_place] == sorted(r.hilbert for r in found)
    few = shards.hilbert_shards(frame(spark, data[:3], "doc_id long, text string, lang string, source string"))
    assert sorted(r.slot for r in few.collect()) == [0, 0, 0]
    assert shards.hilbert_shards(frame(spark, [], "doc_id long, text string, lang string, source string")).count() == 0


def test_hilbert_neighbours_are_grid_neighbours():
    import itertools

    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dimensions))).T
        number = shards.hilbert_number(list(grid), bits)
        order = np.argsort(number)
        assert (number[order] == np.arange(grid.shape[1])).all()
        assert (np.abs(np.diff(grid[:, order], axis=1)).sum(axis=0) == 1).all()


def test_decisions_are_by_row_whatever_the_id(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve"
    data = [(1, text), (1, text), (None, text), (None, "quite another text of a few words"), (1, "a third text with words of its own"), (3, text), (None, None), (None, None)]
    kept = sorted(map(tuple, simhash.keep_one(frame(spark, data)).select("doc_id", "text").collect()), key=str)
    assert kept == sorted([(1, text), (None, "quite another text of a few words"), (1, "a third text with words of its own"), (None, None)], key=str)
    items = spark.createDataFrame([(7, "three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    clean = decontaminate.drop_contaminated(frame(spark, data), items)
    assert sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == sorted((d or 0, t or "") for d, t in data if t != text)
    docs = frame(spark, data).withColumn("lang", F.lit("en")).withColumn("source", F.lit("web"))
    shards.write_shards(docs, str(tmp_path / "shards"), 3)
    written = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id or 0, r.text or "") for r in written.collect()) == sorted((d or 0, t or "") for d, t in data)
    assert {r["hilbert_shard"]: r["count"] for r in written.groupBy("hilbert_shard").count().collect()} == {0: 3, 1: 3, 2: 2}


def test_thin_keys_and_counts_come_back():
    rng = np.random.default_rng(3)
    for keys in ([5], [0, 1 << 63], rng.integers(0, 1 << 40, 500)):
        keys = np.sort(np.asarray(keys, np.uint64))
        assert (lmscore.wide_keys(lmscore.thin_keys(keys)) == keys).all()
    for counts in ([1], [254, 255, 256, 1 << 40], rng.integers(1, 300, 500)):
        counts = np.asarray(counts, np.int64)
        assert (lmscore.wide_counts(lmscore.thin_counts(counts)) == counts).all()


def test_simhash_components_equal_all_pairs(spark):
    long = " ".join(f"t{i}" for i in range(900))
    data = rows() + AWKWARD + [(9700 + k, long.replace(f"t{40 * k + 7} ", "zz ")) for k in range(6)] + [(9005, "same words here\nsame words here")]
    prints = {}
    for d, t in data:
        w = blank_words(lower_ascii(t or ""))
        k = min(3, len(w))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    groups, ids = Groups(prints), sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                groups.join(a, b)
    found = simhash.digest(simhash.near_duplicates(frame(spark, data))).collect()
    assert len(found) == len(data)
    assert all((int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id], groups.top(r.doc_id)) for r in found)
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, data)).collect()}
    assert kept == {groups.top(d) for d in ids}


def test_simhash_links_every_two_bit_pair(spark):
    draw = np.random.default_rng(3)
    base = [int(x) for x in draw.integers(-(1 << 63), (1 << 63) - 1, 12)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    fps = set(base)
    for x in base:
        i, j = draw.choice(64, 2, replace=False)
        fps.add(signed((x & (1 << 64) - 1) ^ (1 << int(i)) ^ (1 << int(j))))
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    met = {frozenset((r.a, r.b)) for r in links}
    assert len(met) == 12 and all(((a ^ b) & (1 << 64) - 1).bit_count() == 2 for a, b in map(tuple, met))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_pipeline_equals_its_operators_one_by_one(spark, folder):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        path = corpus_pipeline.shared_path(spark, "test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {r.doc_id: len(library.encode(r.text or "")) for r in docs.collect()}
    found = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, folder).collect()}
    assert found == expected and 0 < len(found) < len(rows(folder))


def test_words_of_texts_are_those_between_ascii_blanks():
    texts = ["", None, " \t\n", "One two  ONE", "\x0btail\x0c", "a\x1cb \x85c\u00a0d", "\x00 x", "Ärger \U0001f600 ÄRGER", " ".join(["w%d" % (i % 7) for i in range(999)]) + "\r"]
    for kind in (pa.string(), pa.large_string()):
        hashes, place, ends = lmscore.words_of(pa.array([*texts, "cut off"], kind)[: len(texts)])
        for text, a, b in zip(texts, ends, ends[1:]):
            wanted = [lmscore.xxhash.xxh64_intdigest(w) for w in (text or "").encode().lower().split()]
            assert hashes[place[a:b]].tolist() == wanted


def test_ranges_of_contexts_equal_two_lookups_and_shards_are_visited_once():
    rng = np.random.default_rng(4)
    for top in (1, 3, 200, 100_000):
        values = np.sort(np.concatenate([rng.integers(0, top, 3000), np.zeros(200, np.int64), np.full(300, top)]))
        ef, at = ef_encode(values), np.sort(rng.integers(0, len(values) - 1, 2000))
        first, second = ef_ranges(ef, at)
        assert (first == values[at]).all() and (second == values[at + 1]).all() and (ef_access(ef, at) == values[at]).all()
    shard = rng.integers(-1, 40_000, 5000)
    found = dict(lmscore.places_by_shard(shard))
    assert set(found) == set(shard[shard >= 0].tolist()) and all((np.flatnonzero(shard == s) == at).all() for s, at in found.items())
    assert not list(lmscore.places_by_shard(np.empty(0, np.int64)))
