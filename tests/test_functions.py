import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from typeloom.functions import edits as E
from typeloom.functions import hashing as H
from typeloom.functions import layout as Y
from typeloom.functions import text as T
from typeloom.operators import boundary as B
from typeloom.operators import gestures as G


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], f"i long, a {kind}" + (", b string" if isinstance(values[0], tuple) else ""))
    return [r.x for r in rows.select("i", make.alias("x")).orderBy("i").collect()]


def test_layout(spark):
    words = ["ghbdtn", "привет", "Ghbdtn!", "`", "Ё", None, "", "7/?"]
    got = column(spark, words, Y.convert(F.col("a")))
    assert got == ["привет", "ghbdtn", "Привет!", "ё", "~", None, "", "7/?"]
    assert column(spark, words, Y.convert(Y.convert(F.col("a")))) == words
    assert column(spark, ["abc", "абв", "aб", "1", None], Y.script(F.col("a"))) == ["en", "ru", "other", "other", "other"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_layout_is_an_involution(s):
    assert s.translate(B._KEYS).translate(B._KEYS) == s


def test_hashes(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h & 65535

    words = ["", "a", "привет", "o3:^пр", "x" * 300]
    assert column(spark, words, H.fnv16(F.col("a"))) == [fnv(w) for w in words]

    def probes(s, bits):
        a, b = 14695981039346656037, 1099511628211
        for x in s.encode():
            a = ((a ^ x) * 1099511628211) % 2**64
            b = ((b ^ x) * 14029467366897019727) % 2**64
        return [(a + i * (b | 1)) % 2**64 % bits for i in range(7)]

    assert column(spark, words, H.bloom_probes(1 << 27)(F.col("a"))) == [probes(w, 1 << 27) for w in words]
    import hashlib

    assert column(spark, words, H.split_bucket(F.col("a"))) == [int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "little") % 1000 for w in words]


def levenshtein(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def swapped(a, b):
    return any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1)) and a != b


def test_distances_against_brute_force(spark):
    rnd = random.Random(3)
    pairs = []
    for _ in range(300):
        a = "".join(rnd.choice("абвь") for _ in range(rnd.randint(0, 6)))
        b = list(a)
        for _ in range(rnd.randint(0, 2)):
            if b and rnd.random() < 0.5:
                del b[rnd.randrange(len(b))]
            else:
                b.insert(rnd.randint(0, len(b)), rnd.choice("абвь"))
        if rnd.random() < 0.3 and len(a) > 1:
            k = rnd.randrange(len(a) - 1)
            b = list(a[:k] + a[k + 1] + a[k] + a[k + 2 :])
        pairs.append((a, "".join(b)))
    want = [1 if swapped(a, b) else levenshtein(a, b) for a, b in pairs]
    assert column(spark, pairs, E.distance(F.col("a"), F.col("b"))) == want
    assert column(spark, pairs, E.is_transposition(F.col("a"), F.col("b"))) == [swapped(a, b) for a, b in pairs]


def test_edit_cost_and_confusion(spark):
    cases = [("приевт", "привет", 0.55), ("будеш", "будешь", 0.0), ("собираешся", "собираешься", 0.0), ("ден", "день", 0.3), ("рпивет", "привет", 1.05), ("превет", "привет", 1.0), ("пртвет", "привет", 0.65), ("прмвет", "привет", 0.65), ("приет", "привет", 0.75)]
    got = column(spark, [(a, b) for a, b, _ in cases], E.edit_cost(F.col("a"), F.col("b"), F.lit(True)))
    assert [round(x, 4) for x in got] == [c for _, _, c in cases]
    kinds = [("учится", "учиться", 1), ("можете", "можите", 2), ("слово", "слова", 4), ("дом", "дом", 0), ("кот", "стол", 0)]
    assert column(spark, [(a, b) for a, b, _ in kinds], E.confusion(F.col("a"), F.col("b"))) == [k for *_, k in kinds]


def test_deletes_and_edits(spark):
    assert set(column(spark, ["abc"], E.deletes(F.col("a"), 2))[0]) == {"abc", "ab", "ac", "bc", "a", "b", "c"}
    got = column(spark, ["ab"], E.single_edits(F.col("a"), "ab"))[0]
    want = {"a", "b", "ba", "bb", "aa", "aab", "bab", "abb", "aba"}
    assert set(got) == want and len(got) == len(set(got))


def test_alignment(spark):
    assert E.align(["a", "x", "c"], ["a", "b", "c"]) == [(0, 0), (1, 1), (2, 2)]
    assert E.align(["a", "x", "y", "c"], ["a", "b", "c"]) == [(0, 0), (1, None), (2, None), (3, 2)]
    assert E.align([], ["a"]) == [] and E.align(["a"], []) == [(0, None)]
    df = spark.createDataFrame([(["a"], ["b"]), (None, ["b"]), (["a"], None)], "a array<string>, b array<string>")
    assert [[tuple(x) for x in r.x] for r in df.select(E.aligned_words("a", "b").alias("x")).collect()] == [[("a", "b")], [], [("a", None)]]
    assert E.osa("ca", "abc") == 3 and E.osa("ab", "ba") == 1


def test_patterns(spark):
    """Expected by hand from the rules of each pattern, slips first."""
    cases = [
        ("писмо", "письмо", "soft_hard_sign"), ("обьект", "объект", "soft_hard_sign"), ("ночьной", "ночной", "soft_hard_sign"),
        ("учится", "учиться", "tsya"), ("учиться", "учится", "tsya"),
        ("програма", "программа", "double_letter"), ("агресссия", "агрессия", "double_letter"), ("ддом", "дом", "double_letter"),
        ("здать", "сдать", "z_s_prefix"), ("сдать", "здать", None), ("разширить", "расширить", "z_s_prefix"), ("безсильный", "бессильный", "z_s_prefix"), ("козмос", "космос", None),
        ("карова", "корова", "unstressed_vowel"), ("пирог", "перог", "unstressed_vowel"), ("язык", "езык", None), ("мыло", "мила", None), ("жыли", "жили", None), ("слова", "слово", None),
        ("щея", "шея", "sh_shch"), ("ещо", "ечо", "sh_shch"), ("чшо", "ччо", None),
        ("здраствуй", "здравствуй", "missing_letter"), ("здравствуйй", "здравствуй", "double_letter"), ("будущщий", "будущий", "double_letter"), ("следущий", "следующий", "missing_letter"), ("инциндент", "инцидент", "missing_letter"),
        ("дома", "дом", None), ("кот", "стол", None), ("дом", "дом", None),
    ]
    assert column(spark, [(a, b) for a, b, _ in cases], E.misspelling_pattern(F.col("a"), F.col("b"))) == [k for *_, k in cases]


def test_shape_reasons(spark):
    cases = {"": "length", "w42": "structured-token", "a..b": "structured-token", "site.com": "domain-or-dot", "aб": "mixed-or-unsupported-script", "iPhone": "identifier", "SQL": "abbreviation", "слово": None, "a*b": "symbols"}
    assert column(spark, list(cases), T.shape_reason(F.col("a"))) == list(cases.values())


def test_kwic_and_tokens(spark):
    assert column(spark, ["один два три"], T.kwic(F.col("a"), F.lit(6), F.lit(3), 3)) == ["…ин [[два]] тр…"]
    assert column(spark, ["a b,c  d"], T.boundary_tokens(F.col("a"))) == [["a ", "b,c ", " ", "d"]]


def test_edits_applied(spark):
    text = "abcdef"
    edits = [(1, 2, "X"), (2, 1, "bad"), (4, 0, "I"), (4, 0, "J"), (9, 1, "z"), (5, 1, "")]
    want = G.applied_edits(text, edits)
    assert want == "abbaddIe"
    df = spark.createDataFrame([(text, edits), (None, edits), (text, None), (text, [])], "t string, e array<struct<offset:int,length:int,replacement:string>>")
    got = [r.edited for r in G.edited(df, "t", "e").collect()]
    assert got[1:] == [None, text, text] and got[0] == want


def test_taps_and_limits(spark):
    d = G.TapDetector()
    trace = [("shift", True, 0), ("shift", False, 100), ("shift", True, 200), ("shift", False, 300)]
    assert [d.feed(*x) for x in trace] == [False, False, False, True]
    d = G.TapDetector()
    assert not any(d.feed(*x) for x in [("shift", True, 0), ("shift", False, 100), ("a", True, 150), ("shift", True, 200), ("shift", False, 300)])
    limiter = G.RateLimiter()
    assert [limiter.offer(t, 10) for t in (0, 2, 5, 11)] == [True, False, True, True]
    assert not limiter.offer(20, 70_000)


def test_guarded_words(spark):
    text = "plain don't mail@host.com a-dash longer, слово: x.yaml ещё one_two end."
    assert column(spark, [text, None, ""], T.guarded_words(F.col("a"))) == [["plain", "longer", "слово"], None, []]
