"""Sanitising, quality rules, decontamination, SentencePiece ids and language id against brute force."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabsight.llm import decontaminate, langid, pii, quality, sentencepieces

from .helpers import AWKWARD, blank_words, frame, lower_ascii, remainder, rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PRIVATE = [
    (9101, "a@b.com.x_y@z.w a@b.c@d.e a..b@c-.d.e @x.y x@y"),
    (9102, "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.4 1.2.3"),
    (9103, "4111 1111 1111 1111, 4111-1111-1111-1112, 12 4111111111111111, +1 (456) 555-2186 +12 +1234567890123456 +1 2 3 4 5 6 7 8"),
    (9104, "😀 é a@b.co 日本 +49 30 1234567 𝒳1.2.3.4"),
]


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def test_entities_are_found_as_the_contract_says(spark):
    data = rows() + AWKWARD + PRIVATE
    found = {r.doc_id: r for r in pii.digest(pii.find(frame(spark, data))).collect()}
    assert len(found) == len(data)
    for doc_id, text in data:
        spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = found[doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in PATTERNS)
        assert r.base_sha256 == sha(shown) and r.spans.startswith(shown)


def test_words_that_give_an_entity_away_are_masked(spark):
    # zorblax never occurs without an address, maybe in most cases, please as often without.
    data = [(i, f"call zorblax now a{i}@b.com please maybe") for i in range(40)]
    data += [(100 + i, "please call now" + " maybe" * (i < 16)) for i in range(400)]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, data)).where("doc_id < 2 or doc_id = 100").collect()}
    assert clean[0] == "call  now [EMAIL] please [WORD]"
    assert clean[100] == "please call now maybe"
    assert pii.find(frame(spark, []).select("doc_id", "text")).count() == 0


def test_rare_words_disclose_nothing(spark):
    data = [(1, "unique stranger a@b.com")] + [(i, "plain words") for i in range(2, 60)]
    assert pii.sanitise(frame(spark, data)).where("doc_id = 1").first().text == "unique stranger [EMAIL]"


def test_entities_of_very_long_runs(spark):
    texts = ["7" * 20_000, "7 " * 100_000, "a@b" + ".c" * 100_000, "+1" + "2" * 20_000]
    data = [(9110 + i, t + "\nx@y.org") for i, t in enumerate(texts)]
    found = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find(frame(spark, data)).collect()}
    last = {d: ("email", len(t) - 7, len(t)) for d, t in data}
    assert found == {d: [("email", 0, 200_003), last[d]] if d == 9112 else [last[d]] for d, _ in data}


def test_quality_rules_of_very_long_lines(spark):
    fails = ["home | " * 100_000, ">" * 99_999 + "x", "a | " * 100_000, "home" * 100_000]
    holds = ["home | " * 100_000 + "x" * 31, "a | " * 100_000 + "abcd " * 7, "homely " * 100_000]
    found = quality.assess(frame(spark, list(enumerate(fails + holds)))).collect()
    assert {r.doc_id: r.n_failed_lines for r in found} == {i: int(i < len(fails)) for i in range(len(fails + holds))}
    lines = ["Home > About", "home-", "LOGIN logout", "a|b|c", "a|b|c|", "|||", "x" * 31 + "|a|b|c", "a|b|" + "x" * 31 + "|", "about us", "faqmenu", "a > b > c > " + "y" * 30, "a > b > c >" + "y" * 31]
    table = spark.createDataFrame([(x,) for x in lines], "line string")
    for greedy, loop in ((quality.MENU, quality.MENU_LOOP), (quality.BARS, quality.BARS_LOOP)):
        assert table.where(F.col("line").rlike(greedy) != F.col("line").rlike(loop)).count() == 0
        assert 0 < table.where(F.col("line").rlike(loop)).count() < len(lines)


def test_quality_measures(spark):
    data = rows() + AWKWARD
    found = {r.doc_id: r for r in quality.assess(frame(spark, data)).collect()}
    for doc_id, text in data:
        words = blank_words(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if blank_words(x)]
        r, n = found[doc_id], len(words)
        expected = (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (n < 50 or 100 * len(covered) > 50 * n)
        assert not (r.base_failed and r.kept)


def test_failing_lines_go_and_heavy_losers_with_them(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    data = [
        (1, prose + "\nHome | About | Contact\n" + prose.upper() + "\n\nend"),
        (2, "a | b | c | d\n" + "\n".join(f"xyz{i} | u{i} | v{i} | w{i}" for i in range(60))),
        (3, prose),
    ]
    kept = {r.doc_id: r.text for r in quality.keep_good(frame(spark, data)).collect()}
    assert kept == {1: prose + "\n" + prose.upper() + "\n\nend", 3: prose}
    assert quality.keep_good(frame(spark, data)).columns == frame(spark, data).columns
    assert quality.assess(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [20, 1000])
def test_contamination(spark, size):
    items = rows(name="benchmark", columns="item_id, text") + [(9001, "x"), (9002, None), (9003, "!!"), (9004, "same words")]
    data = rows() + AWKWARD + [(9201, "before " + (items[0][1] or "") + " after")]
    table = frame(spark, items, "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.digest(decontaminate.find_contamination(frame(spark, data), table, size=size)).collect()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t or ""))
    windows = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item_id))
    for doc_id, text in data:
        w, hit, held = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    held |= windows[k]
        r = found[doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(held))
        assert r.items_sha256 == sha(",".join(sorted(held))) and r.contaminated == bool(hit)
        places = {x: [i for i, y in enumerate(w) if y == x] for x in set(w)}
        near = set()
        for window, holders in windows.items():
            if all(x in places for x in window) and not holders <= near:
                if any(all(any(abs(p - q) <= decontaminate.NEAR for q in places[x]) for x in window) for p in places[window[0]]):
                    near |= holders
        assert r.n_near_items == len(near)
    assert found[9201].contaminated


def test_index_of_all_words_answers_the_same(spark):
    data = [(1, "the quick brown fox"), (2, "fox the brown quick quick"), (3, None)]
    index = decontaminate.build_index(frame(spark, data))
    found = {r.doc_id: r for r in decontaminate.search(index, [("i", b"Quick brown")]).collect()}
    assert found[1].hit == [1, 2] and found[1].items == ["i"]
    assert found[2].hit == [] and found[2].near_items == ["i"]
    assert found[3].n_words == 0


def test_empty_tables_of_items_and_documents(spark):
    none = frame(spark, [], "item_id long, text string")
    assert [r.n_items for r in decontaminate.digest(decontaminate.find_contamination(frame(spark, [(1, "x")]), none)).collect()] == [0]
    assert decontaminate.find_contamination(frame(spark, []), frame(spark, [(1, "x")], "item_id long, text string")).count() == 0


def test_sentencepieces_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    hard = ["▁", "▁▁ a", "a ", " ", "  a  b\n ", "<s> </s> <0x0A>", "x\r\n y", "a" * 4000 + " b", "👨‍👩‍👧 ", "ﬁ　é"]
    data = rows() + AWKWARD + [(9300 + i, t) for i, t in enumerate(hard)]
    found = {r.doc_id: r for r in sentencepieces.encode_decode(frame(spark, data), path, keep_text=True).collect()}
    for doc_id, text in data:
        ids = library.encode(text or "")
        r = found[doc_id]
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ",".join(map(str, ids)), library.decode(ids))
        assert (r.ids_sha256, r.decoded_sha256) == (sha(r.ids), sha(r.decoded))


def test_a_full_chunk_table_changes_nothing():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    texts = [t or "" for _, t in rows()[:40]]
    small, large = sentencepieces.ChunkTable(model, size=50), sentencepieces.ChunkTable(model)
    assert [x for t in texts for x in small([t])] == list(large(texts))


def test_language_id_on_held_out_rows(spark):
    data = rows(columns="doc_id, text, lang")
    lang = {d: x for d, _, x in data}
    hard = [(d, t, None) for d, t in AWKWARD] + [(9400, "123 !!", "en")]
    found = {r.doc_id: r for r in langid.identify(frame(spark, data + hard, "doc_id long, text string, lang string")).collect()}
    assert all(r.held_out == (remainder(d, 5) == 0) and 0 <= r.score <= 1 for d, r in found.items())
    tested = [d for d, r in found.items() if r.held_out and d in lang]
    assert sum(found[d].lang_pred == lang[d] for d in tested) >= 0.95 * len(tested)
    assert {found[d].lang_pred for d in (9001, 9002, 9003, 9400)} == {"und"}
    assert {r.lang_pred for r in found.values()} <= {*lang.values(), "und"}


def test_language_id_ignores_what_it_must_not_see(spark):
    data = rows(columns="doc_id, text, lang")
    told = langid.labelled_sample(frame(spark, data, "doc_id long, text string, lang string"))
    held = {(x, t.encode()) for d, t, x in data if remainder(d, 5) == 0}
    seen = {(x, t.encode()) for d, t, x in data if remainder(d, 5) != 0}
    assert set(told) <= seen and not (set(told) - seen) & held


def test_nothing_to_learn_a_language_from(spark):
    found = langid.identify(frame(spark, [(1, "some text", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)]


@pytest.mark.parametrize("n", [0, 1, 5])
def test_slices_cover_a_batch(n):
    import pyarrow as pa

    from tabsight.llm.common import slices

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["abc" * i for i in range(n)], pa.string())})
    assert sum(part.num_rows for part in slices(batch, limit=4)) == n


def test_marker_columns_do_not_clash(spark):
    table = frame(spark, [(1, "some words " * 40)])
    assert quality.keep_good(table.withColumn("kept", F.lit(True))).columns == [*table.columns, "kept"]
