"""Heap-bounded clustering, multiset fingerprints and conversation repair against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tabsight.llm import heapmeans, multiset, queries, turns

from .helpers import AWKWARD, FOLDER, frame, rows

# --- clustering -------------------------------------------------------------------------------------------------------------


def lloyd(data, dims=64, k=40, rounds=5):
    """{row: (cluster, distance, cluster_inertia, inertia, sha)} in the order of the kept rows."""
    kept = [(i, v) for i, v in data if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(np.array([v for _, v in kept], np.float32).astype(np.float64) * 256).astype(np.int64)
    order = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(f"2:{kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    centroids = x[order[:k]].copy()
    for _ in range(rounds):
        own = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1).argmin(axis=1)
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = x[own == c].sum(axis=0) // (own == c).sum()
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    own, least = d.argmin(axis=1), d.min(axis=1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return sorted((kept[r][0], int(c), int(m), int(least[own == c].sum()), int(least.sum()), sha[c]) for r, (c, m) in enumerate(zip(own, least)))


def clustered(spark, data, **options):
    df = frame(spark, data, "vec_id long, embedding array<float>").withColumnRenamed("id", "block")
    return sorted(tuple(r) for r in heapmeans.cluster(df, **options).collect())


def test_clusters_equal_lloyd(spark):
    data = rows(name="embeddings", columns="vec_id, embedding")
    hot = [(10_000 + i, data[3][1]) for i in range(300)]
    bad = [(20_001, None), (20_002, data[0][1][:63]), (20_003, [None, *data[0][1][1:]]), (20_004, [float("nan"), *data[0][1][1:]]), (20_005, [float("-inf"), *data[0][1][1:]]), (20_006, [])]
    assert clustered(spark, data + hot + bad + data[:5], block_rows=100) == lloyd(data + hot + data[:5])


def test_few_tied_and_large_vectors(spark):
    assert clustered(spark, [(1, [0.0] * 64)]) == lloyd([(1, [0.0] * 64)])
    line = [(i, [float(i // 2)] + [0.0] * 63) for i in range(90)]  # every centroid between two others: ties
    assert clustered(spark, line, block_rows=16) == lloyd(line)
    far = [(i, [float(i * 9001)] + [-2000.0 * i] * 63) for i in range(50)]
    assert clustered(spark, far) == lloyd(far)
    assert clustered(spark, []) == []
    with pytest.raises(Exception, match="too large"):
        clustered(spark, [(1, [1e30] * 64)])


def test_only_expired_vectors_are_scanned(spark):
    rng = np.random.default_rng(1)
    data = [(i, (20 * np.eye(64)[i % 40] + rng.normal(0, 0.05, 64)).tolist()) for i in range(2000)]
    seen = []
    assert clustered(spark, data, rounds=12, trace=seen) == lloyd([(i, [float(np.float32(x)) for x in v]) for i, v in data], rounds=12)
    assert seen[0] == 2000 and seen[-1] == 0


def test_heap_gives_exactly_the_expired_keys():
    rng = np.random.default_rng(2)
    keys = rng.normal(size=500)
    heap = keys[heapmeans.heap_order(keys)]
    for limit in (-9.0, -1.0, 0.0, heap[17], 9.0):
        assert sorted(heapmeans.expired(heap, limit)) == np.flatnonzero(heap <= limit).tolist()
    assert len(heapmeans.expired(np.empty(0), 1.0)) == 0


# --- fingerprints -----------------------------------------------------------------------------------------------------------


def prints(texts):
    return multiset.Prints.of([t.split(b"\n") for t in texts])


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_edited_texts_and_their_prints(spark, partitions):
    data = rows() + AWKWARD + [(9010, "word and more. " * 4000), (9011, "a\n" * 20000)]
    found = {r.doc_id: r for r in multiset.digest(multiset.compare_with_edits(frame(spark, data), partitions)).collect()}
    assert len(found) == len(data)
    order = sorted(data, key=lambda d: d[0], reverse=True)
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        both = prints([text.encode(), edited.encode(), following.encode()])
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == [x.hex() for x in both.raw()[:2]]
        assert r.near_edited == both[0:1].likeness(both[1:2])[0] and r.near_next == both[0:1].likeness(both[2:3])[0]
        assert (r.fingerprint == r.edited_fingerprint) == (sorted(text.split("\n")) == sorted(edited.split("\n")))
    long = [r for d, r in found.items() if d < 9000 and r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.4 and np.mean([r.near_next for r in long]) < 0.1


def test_repeated_null_and_no_ids(spark):
    data = [(None, "a\nb"), (None, None), (5, "x"), (5, "x"), (5, "y z")]
    assert multiset.compare_with_edits(frame(spark, data)).count() == 5
    assert multiset.compare_with_edits(frame(spark, [])).count() == 0
    one = multiset.compare_with_edits(frame(spark, [(1, "only text")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"only only").hexdigest()


def test_order_does_not_matter_but_number_does():
    a, b, c, d = prints([b"p\nq\nq", b"q\np\nq", b"p\nq", b"p\nq\nq\n"]).raw()
    assert a == b and a != c and a != d


def test_likeness_estimates_the_common_share():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    text = lambda: [" ".join(rng.choice(words) for _ in range(12)) for _ in range(200)]
    for share in (0.0, 0.25, 0.5, 0.9):
        a, b = text(), text()
        b[: int(200 * share)] = a[: int(200 * share)]
        rng.shuffle(b)
        p = prints(["\n".join(x).encode() for x in (a, b)])
        assert abs(p[0:1].likeness(p[1:2])[0] - share) < 0.25


def test_sums_and_incremental_edits(spark):
    data = rows()[:60] + [(9001, None), (None, "p\nq")]
    docs = frame(spark, data)
    before = multiset.fingerprints(docs)
    edits = [(data[0][0], "a new paragraph", 2), (data[1][0], (data[1][1] or "").split("\n")[0], -1), (9999, "first\nsecond", 1), (None, None, None)]
    after = {r.doc_id: bytes(r.print) for r in multiset.changed(before, spark.createDataFrame(edits, "doc_id long, paragraph string, times long")).collect()}
    texts = dict(data)
    texts[data[0][0]] += "\na new paragraph\na new paragraph"
    texts[data[1][0]] = "\n".join(texts[data[1][0]].split("\n")[1:]) if "\n" in texts[data[1][0]] else None
    texts[9999] = "first\nsecond"
    for doc_id, text in texts.items():
        if text is not None or doc_id == 9001:
            assert after[doc_id] == prints([(text or "").encode()]).raw()[0], doc_id
    whole = multiset.total(before.selectExpr("1 AS k", "print"), "k").first()
    assert bytes(whole.print) == prints(["\n".join(t or "" for _, t in data).encode()]).raw()[0]


# --- conversations ------------------------------------------------------------------------------------------------------------

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(coded):
    """Least (cost, audit) by dynamic programming over whole strings."""
    best = {(len(coded), s): {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}[s] for s in range(4)}
    for i in range(len(coded) - 1, -1, -1):
        role, truncated, must = coded[i]
        for s in range(4):
            ways, state, before = [], s, (0, "")
            for _ in range(4):
                after = lambda t, cost, letter: (before[0] + cost + best[i + 1, t][0], before[1] + letter + best[i + 1, t][1])  # noqa: B023, E731
                ways.append(after(state, 4, "D"))
                if not must:
                    ways.append(after(NEXT[state], 3 + 3 * truncated, "R"))
                    if (state, role) in KEEP:
                        ways.append(after(KEEP[state, role], 3 * truncated, "K"))
                state, before = NEXT[state], (before[0] + 3, before[1] + "I")
            best[i, s] = min(ways)
    return best[0, 0]


def repaired(data):
    talks = {}
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        rows_ = talks.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(hit, text)
        if hit:
            rows_ += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv, rows_ in talks.items():
        rows_.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, coded, counts = set(), [], [0, 0, 0]
        for _, role, text in rows_:
            body = text.strip(" \t\n\v\f\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            coded.append((role[:1], fault == 2, fault in (0, 1)))
        legal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows_, rows_[1:]))
        at = {t for t, _, _ in rows_ if t is not None}
        cost, audit = cheapest(coded) if rows_ else (0, "")
        state, lines, left = 0, [], iter(rows_)
        for letter in audit:
            role, text = (None, "") if letter == "I" else next(left)[1:]
            if letter == "D":
                continue
            state = KEEP[state, role[0]] if letter == "K" else NEXT[state]
            lines.append((role if letter == "K" else {2: "user", 3: "assistant"}[state]) + ":" + text)
        out[conv] = (max(at) - min(at) + 1 - len(at) if at else 0, *counts, legal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def awkward_talks():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "über"], ["hello.", "yes!", "no", "", " \n", "what? ", None, "é", "x\x00."]
    talks = [(9000 + i % 7 if i % 11 else None, rng.choice([None, *range(400)]), rng.choice(roles), rng.choice(texts)) for i in range(300)]
    long = [(8000, i, rng.choice(["user", "assistant"]), f"turn {rng.randrange(300)}" + rng.choice([".", "", "!"])) for i in range(900)]
    dropped = [(7000 + c, t, "user", "a.") for c in range(3) for t in range(60) if zlib.crc32(f"{7000 + c}:{t}".encode()) % 20 == 0]
    return talks + long + dropped + [(7100, None, "user", "same."), (7100, None, "user", "same."), (7200, 1, "user", "long " * 40_000)]


@pytest.mark.parametrize(("partitions", "chunk_rows", "chunk_bytes"), [(None, 128, 4 << 20), (5, 7, 4 << 20), (3, 1, 4 << 20), (4, 100, 500)])
def test_repair_equals_dynamic_programming(spark, partitions, chunk_rows, chunk_bytes):
    data = rows(name="conversations", columns="conv_id, turn, role, text") + awkward_talks()
    df = frame(spark, data, SCHEMA).withColumnRenamed("place", "conv").withColumnRenamed("removed", "slice")
    found = turns.structure(turns.damaged(df), partitions, chunk_rows, chunk_bytes).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == repaired(data) and len(found) == len({d[0] for d in data})


def test_no_conversations(spark):
    assert turns.repair(frame(spark, [], SCHEMA)).count() == 0


def test_auction_prices_are_dual_feasible():
    rng = random.Random(7)
    for _ in range(300):
        codes = "".join(rng.choice("suaxSUAX-") for _ in range(rng.randrange(0, 12)))
        edges, price, sink = turns.lattice(codes, turns.CLOSE)
        distance = turns.auction(edges, price, 0, sink)
        assert all(price[i] <= cost + price[j] for i, out in enumerate(edges) for _, cost, j in out)
        kinds = [(c.lower(), c.isupper(), c == "-") for c in codes]
        assert turns.repaired(codes) == cheapest(kinds) and distance == cheapest(kinds)[0]


def test_queries_run_over_their_tables(spark):
    assert queries.op11_heap_clusters(spark, FOLDER).count() == len(rows(name="embeddings", columns="vec_id"))
    assert queries.op12_multiset_fingerprints(spark, FOLDER).count() == len(rows(columns="doc_id"))
    assert queries.op13_conversation_repair(spark, FOLDER).count() == len(set(rows(name="conversations", columns="conv_id")))
