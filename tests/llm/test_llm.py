import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from typeloom.llm import copies, cross_split, encodings, leaks, one_form, packing, terms, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


# --- 2


def jaccard_pairs(rows):
    sets = [(i, s, frozenset(t.lower().split())) for i, s, t in rows if t and t.strip() and s]
    return {(a, b) for a, s, x in sets if s == "train" for b, u, y in sets if u != "train" and 10 * len(x & y) >= 7 * len(x | y)}


def test_overlaps_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        if rows and rnd.random() < 0.6:
            w = rnd.choice(rows)[2].split()
            for _ in range(rnd.randint(0, 4)):
                k = rnd.randrange(len(w))
                w[k : k + 1] = rnd.choice([[], [rnd.choice(WORDS)], [w[k], f"new{i}"]])
                w = w or ["x"]
            rnd.shuffle(w)
        else:
            w = [rnd.choice(WORDS) + rnd.choice(["", "s", "ed", "ing"]) for _ in range(rnd.randint(1, 14))]
        rows.append((i, rnd.choice(["train", "train", "dev", "final"]), " ".join(w)))
    rows += [(1000, "train", None), (1001, None, "alpha"), (1002, "dev", ""), (1003, "dev", " . "), (1004, "train", "long " * 20_000 + "tail"), (1005, "dev", "tail long"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "sent_id long, split string, sentence string, hs string")
    want = jaccard_pairs(rows)
    for rare, often in ((50, None), (0, 0), (3, 3), (3, 30), (0, 30), (30, 1000)):
        assert {(r.id_train, r.id_other) for r in cross_split.overlapping(df, rare=rare, often=often).collect()} == want
    assert cross_split.overlapping(df.limit(0)).count() == 0


def test_long_records_against_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(120):
        w = set(rnd.choice(rows)[2].split()) if rows and rnd.random() < 0.7 else set(rnd.sample(vocabulary, rnd.randint(20, 75)))
        for x in rnd.sample(vocabulary, rnd.randint(0, 14)):
            w ^= {x}
        rows.append((i, rnd.choice(["train", "dev"]), " ".join(sorted(w))))
    df = spark.createDataFrame(rows, "sent_id long, split string, sentence string")
    for rare, often in ((0, 0), (20, 20), (20, 60), (0, 1000), (1000, 1000)):
        assert {(r.id_train, r.id_other) for r in cross_split.overlapping(df, rare=rare, often=often).collect()} == jaccard_pairs(rows)


def test_overlap_fractions(spark):
    df = spark.createDataFrame([(1, "train", "one two three four"), (2, "dev", "four three two one"), (3, "dev", "five six"), (4, "dev", None)], "sent_id long, split string, sentence string")
    assert {r.id: r.overlap for r in cross_split.overlap_fractions(df).collect()} == {2: 1.0, 3: 0.0}


# --- 3


@pytest.mark.parametrize(
    ("a", "b"),
    [("пpивeт", "привет"), ("ｆｕｌｌ １２", "full 12"), ("ﬁnal", "final"), ("café", "café"), ("й", "й"), ("a​b­c", "abc"), ("a b c", "a b c"), ("SMS-код v2 № 5…", "SMS-код v2 № 5…"), ("", ""), ("слοво", "слово"), ("x²½™", "x²½™")],
)
def test_one_form(a, b):
    assert one_form.one_form(a) == b and one_form.one_form(b) == b


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_one_form_is_final(s):
    once = one_form.one_form(s)
    assert one_form.one_form(once) == once


def test_mapping_has_sources_of_several_characters():
    table = one_form.mapping()
    assert table["e\u0301"] == "é" and table["e\u0302\u0301"] == "ế" and table["и\u0306"] == "й" and max(map(len, table)) >= 3
    assert one_form.one_form("e\u0302\u0301") == "ế" and one_form.one_form("ê\u0301") == "ế" and one_form.one_form("e\u200b\u0301") == "é"
    assert one_form.one_form("п\u200bp\u0438вет") == "привет" and one_form.one_form("\u1112\u1161\u11ab") == "한"
    assert len(one_form.look_alikes()) > 90


def test_disguised_rows(spark):
    rows = [(1, "пpивет", "k"), (2, "привет", "k"), (3, None, "k"), (4, "", "k"), (5, "a b" * 30_000, "k"), (2, "привет", "k"), (6, "café", None)]
    df = spark.createDataFrame(rows, "review_id long, word string, canonical string")
    assert sorted(r.review_id for r in one_form.disguised(df, "word").collect()) == [1, 5]
    got = {r.review_id: r.canonical for r in one_form.canonical(df, "word").where("review_id < 5").collect()}
    assert got == {1: "привет", 2: "привет", 3: None, 4: ""} and one_form.canonical(df.limit(0), "word").count() == 0


# --- 4


def test_copies(spark):
    rows = [(3, "a", "Hello,  World!"), (1, "a", "hello world"), (2, "b", "hello world"), (4, "a", None), (5, None, "hello world"), (6, "a", "hello\tWORLD"), (7, "a", ""), (8, "a", "..."), (9, "a", "x" * 100_000)]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    h = copies.hashed(df, "id", copies.text_key(F.col("source"), F.col("text")), "t")
    assert {(r.id_1, r.id_2) for r in copies.members(h).collect()} == {(1, 3), (1, 6), (7, 8)}
    assert sorted(r.n_copies for r in copies.groups(h).collect()) == [1, 1, 2, 3] and copies.collisions(h).count() == 0
    assert copies.members(h.limit(0)).count() == 0


def test_json_copies(spark):
    rows = [(1, '{"a":"X y","sentence":"Da, net"}'), (2, '{ "sentence" : "da  net." , "a":"x Y"}'), (3, '{"a":"x y","sentence":null}'), (4, '{"a":"x y","sentence":null}'), (5, "broken"), (6, None), (7, '{"sentence":"da net"}')]
    h = copies.hashed(spark.createDataFrame(rows, "id long, payload string"), "id", copies.json_key(F.col("payload"), "sentence"), "t")
    assert {(r.id_1, r.id_2) for r in copies.members(h).collect()} == {(1, 2)}


# --- 5


def test_term_counts_against_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(3000):
        w = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6)))
        rows.append((i, rnd.randrange(200), w))
    rows += [(None, 1, "zz"), (5000, 1, None), (5001, 1, ""), (5002, None, "norecord"), (5003, 7, "long" * 30_000)] + rows[:100]
    df = spark.createDataFrame(rows, "token_id long, record_id long, word string").repartition(3)
    want = {}
    for t, r, w in {x for x in rows if x[0] is not None and x[2]}:
        c = want.setdefault(w, [0, set()])
        c[0] += 1
        c[1] |= {r} - {None}
    for share, most in ((None, 400_000), (100_000, 400_000), (50, 100)):
        got = {r.term: (r.occurrences, r.records) for r in terms.term_counts(df, F.col("word"), "record_id", "token_id", share, most).collect()}
        assert got == {w: (n, len(s)) for w, (n, s) in want.items()}
    assert terms.term_counts(df.limit(0), F.col("word"), "record_id", "token_id").count() == 0


def test_routes_split_long_common_beginnings(spark):
    rows = [(i, i % 7, "http://example.org/a/long/way/" + str(i % 4000)) for i in range(9000)] + [(20_000 + i, 1, x) for i, x in enumerate(["http", "http://example.or", "zebra"])]
    df = spark.createDataFrame(rows, "token_id long, record_id long, word string").repartition(3)
    want = Counter(w for _, _, w in rows)
    assert {r.term: r.occurrences for r in terms.term_counts(df, F.col("word"), "record_id", "token_id", share=500).collect()} == want
    wide = {"": 9000, **{"http://example.org"[:k]: 9000 for k in range(1, 13)}}
    at = Counter(terms.route(w, wide, 500) for w in want)
    assert max(at.values()) < 500 and len(at) > 15 and terms.route("zebra", wide, 500) == "z"


def test_tries_merge_by_subtrees():
    rnd = random.Random(3)
    whole, tries = {}, []
    for _ in range(4):
        t = terms.BurstTrie(burst=rnd.choice([3, 20, 1000]))
        for _ in range(500):
            w = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 8)))
            t.add(w, 1, 1)
            whole[w] = whole.get(w, 0) + 1
        tries.append(t)
    into = terms.BurstTrie(burst=10)
    for t in tries:
        for prefix, leaf in t.leaves():
            into.merge(prefix, leaf)
    assert {w: c[0] for _, leaf in into.leaves() for w, c in leaf.items()} == whole and into.size == len(whole)
    assert all(w.startswith(p) for p, leaf in into.leaves() for w in leaf)


def test_burst_trie():
    t = terms.BurstTrie(burst=4)
    for i in range(200):
        t.add(f"p{i % 50}", 1, i % 2)
    flat = {w: c for _, leaf in t.leaves() for w, c in leaf.items()}
    assert t.size == 50 and all(c[0] == 4 for c in flat.values()) and all(w.startswith(p) for p, leaf in t.leaves() for w in leaf)
    same = terms.BurstTrie(burst=1, depth=3)
    for w in ("aaaaa", "aaaab", "aaaac", ""):
        same.add(w, 1, 1)
    assert sum(len(leaf) for _, leaf in same.leaves()) == 4


# --- 6

CLEAN = ["Сегодня мы проверяли словарь и записали ошибки", "The captain checked the harbour and wrote a letter", "Завтра они читают новые письма в библиотеке", "Nobody reads the long report before the morning"]


def garble(text, right, wrong):
    return text.encode(right).decode(wrong, "strict")


def test_round_trips():
    rnd = random.Random(4)
    ru, en = CLEAN[0].split() + CLEAN[2].split(), CLEAN[1].split() + CLEAN[3].split()
    model = encodings.Language({"ru": [" ".join(rnd.choices(ru, k=8)) for _ in range(400)], "en": [" ".join(rnd.choices(en, k=8)) for _ in range(400)]})
    for right, wrong in (("utf-8", "cp866"), ("utf-8", "latin-1"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866")):
        for text in (CLEAN[0], CLEAN[2]):
            got, name, damaged = encodings.restore(garble(text, right, wrong), model)
            assert got == text and name and damaged, (right, wrong)
    half = "Сегодня мы проверяли " + garble("словарь и записали", "utf-8", "cp866") + " ошибки"
    assert encodings.restore(half, model)[0] == CLEAN[0]
    for text in (*CLEAN, CLEAN[0].upper(), CLEAN[0].swapcase(), "A café costs €15, it’s +5 °C © n° 7 ½", ""):
        assert encodings.restore(text, model) == (text, None, False)
    assert encodings.restore("Nobody couldn\ufffdt read the report", model) == ("Nobody couldn\ufffdt read the report", None, True)
    lost = " ".join(garble(w, "utf-8", "cp866")[:-1] for w in CLEAN[0].split())  # the last byte of every word is gone
    assert encodings.restore(lost, model)[2]


def test_garbled_rows(spark):
    rows = [("t", 1, CLEAN[0]), ("t", 2, garble(CLEAN[0], "utf-8", "cp866")), ("t", 2, garble(CLEAN[0], "utf-8", "cp866")), ("t", 3, None), ("t", 4, ""), ("t", 5, "a�b")] + [("t", 10 + i, x) for i, x in enumerate(CLEAN)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "table_name string, row_id long, text string, chain int")
    got = {r.row_id: r.restored for r in encodings.garbled(df, encodings.fitted(df)).collect()}
    assert set(got) == {2, 5} and got[2] == CLEAN[0]
    assert encodings.garbled(df.limit(0), encodings.fitted(df.limit(0))).count() == 0


def test_dictionaries_of_all_texts(spark, monkeypatch):
    rnd = random.Random(6)
    texts = {
        lang: [" ".join("".join(rnd.choices(letters, k=rnd.randint(2, 6))) for _ in range(4)) + f"{end} {i}." for i in range(4500)] + [f"{word}, {word}! " * 200] * 3
        for lang, letters, word, end in (("ru", "абвгдежз", "библиотекарь", " слово,"), ("en", "abcdefgh", "lighthouses", " words:"))
    }
    df = spark.createDataFrame([(t,) for ts in texts.values() for t in ts], "text string")
    want = encodings.Language(texts)
    for kept, parts in ((encodings._KEPT, 1), (500, 7)):  # words are passed on at the end, and in between
        monkeypatch.setattr(encodings, "_KEPT", kept)
        got = encodings.fitted(df.repartition(parts))
        assert "библиотекарь".encode() in got.dictionaries["ru"] and b"lighthouses" in got.dictionaries["en"]
        assert got.dictionaries == want.dictionaries and got.pairs == want.pairs


# --- 7


@pytest.mark.parametrize("capacity", [7, 100, 4096])
def test_packing_fills(capacity):
    rng = np.random.default_rng(1)
    s = np.minimum(capacity, rng.integers(1, max(2, capacity // 2), 30_000))
    w = packing.sum_of_squares(s, capacity)
    fill = np.bincount(w, s)
    assert fill.max() <= capacity and fill.min() > 0 and len(fill) <= 1.02 * s.sum() / capacity + 2


def plain_sum_of_squares(sizes, capacity, levels):
    """By trying every open window and every level anew."""
    width, fills, out = max(1, -(-capacity // levels)), [], []
    squares = lambda fs: sum(n * n for n in Counter(f // width for f in fs if f < capacity).values())
    for i, s in enumerate(sizes):
        ending = sum(capacity - f for f in fills) >= sum(sizes[i:])
        choices = []
        for k in {f // width for f in fills if f < capacity}:
            fit = [(f, j) for j, f in enumerate(fills) if f < capacity and f // width == k and f + s <= capacity]
            if fit:
                f, j = max(fit)
                choices.append((squares([*fills[:j], f + s, *fills[j + 1 :]]), -k, j))
        if choices and (ending or min(choices)[0] <= squares([*fills, s])):
            j = min(choices)[2]
        else:
            j = len(fills)
            fills.append(0)
        fills[j] += s
        out.append(j)
    return out


@pytest.mark.parametrize(("capacity", "levels"), [(1, 4), (10, 4), (37, 8), (64, 256)])
def test_packing_is_sum_of_squares(capacity, levels):
    for seed in range(6):
        s = np.random.default_rng(seed).integers(1, capacity + 1, 120)
        assert packing.sum_of_squares(s, capacity, levels).tolist() == plain_sum_of_squares(s.tolist(), capacity, levels)


def test_documents_packed(spark):
    text = [None, "", "one", "word " * 3000] + ["some words here"] * 50
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(text)] + [(None, "no id", "x")], "doc_id long, text string, window string")
    windows = spark.createDataFrame([("a", 64), ("b", 1000), ("c", None), ("d", 0)], "window_name string, capacity_tokens int")
    rows = packing.documents_packed(docs, windows).collect()
    count = {r.id: r.tokens for r in packing.token_counts(docs, "doc_id", "text").collect()}
    for name, capacity in (("a", 64), ("b", 1000)):
        mine = [r for r in rows if r.window_name == name]
        by_doc, by_window = {}, {}
        for r in mine:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_window[(r.part, r.window)] = by_window.get((r.part, r.window), 0) + r.tokens
        assert max(by_window.values()) <= capacity
        assert {d: sum(r.tokens for r in x) for d, x in by_doc.items()} == {d: n for d, n in count.items() if n}
        assert all(len(x) == 1 or count[d] > capacity for d, x in by_doc.items())
    assert {r.window_name for r in rows} == {"a", "b"}
    assert packing.documents_packed(docs.limit(0), windows).count() == 0
    assert packing.documents_packed(docs, windows.limit(0)).count() == 0


# --- 8


def leak_truth(docs, items, size=12):
    out = set()
    for d, t in docs:
        w = (t or "").split()
        for i, x in items:
            q = (x or "").split()
            n = min(size, len(q))
            if n and any(w[a : a + n] == q[b : b + n] for a in range(len(w) - n + 1) for b in range(len(q) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rnd = random.Random(9)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([1, 3, 8, 12, 20, 40])))) for i in range(25)] + [(90, None), (91, ""), (92, "... !")]
    docs = []
    for d in range(60):
        w = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.6:
            q = rnd.choice(items[:25])[1].split()
            a = rnd.randrange(len(q))
            w[5:5] = q[a : a + rnd.choice([5, 11, 12, 13, 40])]
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, ""), (102, (items[4][1] + " x ") * 800)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int").repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    for block in (400_000, 30):
        got = {(r.doc_id, r.item_id) for r in leaks.leaked(d, i, block=block).where("exact").collect()}
        assert got == leak_truth(docs, items)
    assert leaks.leaked(d.limit(0), i).count() == 0 and leaks.leaked(d, i.limit(0)).count() == 0


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(3)
    p = leaks.Passages(rng.integers(-(2**62), 2**62, (300, 40)), np.arange(300), np.ones(300, bool), 0.8)
    probe = p.prints.copy()
    for row in range(300):
        for bit in rng.choice(64, leaks.RADIUS, replace=False):
            probe[row] ^= np.uint64(1) << np.uint64(bit)
    w, q = p.near(probe)
    assert p.radius == leaks.RADIUS and {(x, x) for x in range(300)} <= set(zip(w.tolist(), q.tolist(), strict=True))


def near_truth(docs, items, least=0.8):
    def grams(w):
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    out = {}
    for d, t in docs:
        w = t.split()
        for i, x in items:
            q = x.split()
            want = grams(q)
            for a in range(len(w) - len(q) + 1):
                got = grams(w[a : a + len(q)])
                sim = (want & got).total() / (want | got).total()
                if sim >= least:
                    out[d, i] = max(sim, out.get((d, i), 0))
    return out


def test_near_leaks_against_brute_force(spark):
    rnd = random.Random(11)
    items = [(i, " ".join(rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(rnd.choice([10, 13, 20, 49, 60, 90])))) for i in range(40)]
    docs = []
    for d in range(200):
        q = rnd.choice(items)[1].split()
        for _ in range(rnd.randint(0, 2)):
            k = rnd.choice([0, len(q) - 1, rnd.randrange(len(q))])
            q[k : k + 1] = rnd.choice([["changed"], [], [q[k], "more"]])
        w = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 40))]
        docs.append((d, " ".join([*w[:9], *q, *w[9:]])))
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("similarity is not null").collect()}
    want = near_truth(docs, items)
    assert all(abs(want[k] - s) < 1e-9 for k, s in got.items())
    edited = {k for k, s in want.items() if s < 1}
    assert len(edited) > 40 and len(edited & set(got)) >= 0.9 * len(edited) and all(k in got for k, s in want.items() if s == 1)


# --- 9


def test_chain_on_held_out_documents(spark):
    rnd = random.Random(6)
    bad = ["you are a {} fool, get out", "they are all {} vermin and should be driven out", "i will find you and break your {} arms", "watch {} porn for free tonight"]
    plain = ["the {} key sticks again", "the goat is a {} animal behind the barn", "please print the {} report", "the {} plant grows in spring"]
    slot = ["stupid", "filthy", "old", "whole", "green"]
    rows = []
    for i in range(900):
        toxic = i % 6 == 0
        part = [" ".join(rnd.choice(WORDS) + str(rnd.randrange(9)) for _ in range(10)) + "." for _ in range(4)]
        part.append(rnd.choice(bad if toxic else plain).format(rnd.choice(slot)).capitalize() + ".")
        rnd.shuffle(part)
        rows.append((i, " ".join(part), "s", int(toxic)))
    rows += [(5000, None, None, 0), (5001, "", "s", 0)]
    docs = spark.createDataFrame([r[:3] + (0.5,) for r in rows], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, y ^ (rnd.random() < 0.04)) for i, _, _, y in rows if i < 600] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    held = [(y, got[i] >= 0.5) for i, _, _, y in rows if i >= 600]
    assert sum(y and p for y, p in held) >= 0.9 * sum(y for y, _ in held)
    assert sum(p and not y for y, p in held) <= 0.02 * len(held)
    assert got[5000] < 0.5 and got[5001] < 0.5
    assert toxicity.scored(docs, labels.limit(0)).count() == len(rows) and toxicity.scored(docs.limit(0), labels).count() == 0
    assert {r.source: r.n_docs for r in toxicity.rates(toxicity.scored(docs, labels)).collect()} == {"s": 901, None: 1}


def test_few_labels_flag_few():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("bcdfghklmnprstvz") for _ in range(6))
    common, marks = [word() for _ in range(300)], [word() for _ in range(6)]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        parts = [" ".join(rnd.choices(common, k=9)) for _ in range(5)]
        if toxic:
            parts.append(" ".join([*rnd.choices(common, k=3), *rnd.sample(marks, 3), *rnd.choices(common, k=2)]))
        docs.append(". ".join(parts))
        labels.append(int(toxic))
    each = [np.array([toxicity._h(w) for x in d.split(". ") for w in [*x.split(), toxicity.STOP]], np.int64) for d in docs]
    bare = [np.array([toxicity._h(toxicity.skeleton(w)) for x in d.split(". ") for w in [*x.split(), toxicity.STOP]], np.int64) for d in docs]
    off = np.concatenate(([0], np.cumsum([len(x) for x in each])))
    for n in (0, 8, 40, 96, 300):
        chain = toxicity.fitted(each[:n], bare[:n], np.array(labels[:n], np.int64))
        got = toxicity.scored_rows(chain, np.concatenate(each), np.concatenate(bare), off)[:, -1] >= 0.5
        assert not (got & (np.array(labels) == 0)).any(), n
        assert n < 300 or got.sum() >= 45, (n, got.sum())


def test_skeletons_resist_tricks():
    assert toxicity.skeleton("погнаый") == toxicity.skeleton("поганый") == toxicity.skeleton("пганый")
    assert toxicity.skeleton("тварррррь") == toxicity.skeleton("тварь")
