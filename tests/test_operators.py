import json
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from typeloom.operators import boundary as B
from typeloom.operators import correct as C
from typeloom.operators import decide as D
from typeloom.operators import gestures as G
from typeloom.operators import lexicon as L
from typeloom.operators import model as M
from typeloom.sources import artifacts as A
from typeloom.sources import readers as R
from typeloom.streaming.sessions import counted_stream, rate_limited_stream, replay_stream
from typeloom.tables import written


def test_ranks_without_one_sort(spark):
    words = [("en", w, c) for w, c in [("abc", 5), ("abd", 5), ("ab", 5), ("zz", 9), ("b", 1), ("abca", 5)]] + [("ru", "да", 1)]
    got = {(r.lang, r.word): r["rank"] for r in L.with_rank(spark.createDataFrame(words, "lang string, word string, cnt long")).collect()}
    assert got == {("en", "zz"): 1, ("en", "ab"): 2, ("en", "abc"): 3, ("en", "abca"): 4, ("en", "abd"): 5, ("en", "b"): 6, ("ru", "да"): 1}


def test_lexicon_merges_forms_and_takes_nulls(spark):
    s = spark.createDataFrame([(1, "rus_a", "Ёлка елка ёлка"), (2, None, "word word"), (3, "eng_a", None), (4, "eng_a", "the cat the")], "sent_id long, source string, sentence string")
    lex = {(r.lang, r.key): (r.word, r.cnt, r["rank"]) for r in L.ranked(L.tokens(s)).collect()}
    assert lex == {("ru", "елка"): ("ёлка", 3, 1), ("en", "the"): ("the", 2, 1), ("en", "cat"): ("cat", 1, 2)}
    assert L.ranked(L.tokens(s.limit(0))).count() == 0


def test_candidates_against_brute_force(spark):
    words = ["hello", "help", "hallo", "keyboard", "keyboards", "world", "word"]
    lex = spark.createDataFrame([("en", w, i + 1) for i, w in enumerate(words)], "lang string, word string, rank int")
    typed = ["helo", "wrold", "keybaord", "keyborads", "zzzz"]
    got = {(r.typed, r.word, r.dist) for r in C.candidates(spark.createDataFrame([("en", t) for t in typed], "lang string, typed string"), lex).collect()}

    def dist(a, b):
        last = list(range(len(b) + 1))
        if a != b and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1)):
            return 1
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    want = {(t, w, dist(t, w)) for t in typed for w in words if dist(t, w) == 1 or dist(t, w) == 2 and len(t) >= 8}
    assert got == want


def test_candidate_keys_are_not_gathered_on_the_driver(spark):
    """Neither side's keys are sent to every task, however small the planner takes the words to be."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    typed = spark.createDataFrame([("en", "helo")], "lang string, typed string")
    words = spark.createDataFrame([("en", w, k) for k, w in enumerate(("hello", "help", "word"), 1)], "lang string, word string, rank int")
    found = C.candidates(typed, words)
    assert {(r.word, r.dist) for r in found.collect()} == {("hello", 1), ("help", 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_single_edits_of_both_languages(spark, monkeypatch):
    from typeloom.plans import decisions as P

    words = {"en": ["cat", "cart", "keyboard", "keybaord", "keyboards", "at"], "ru": ["слово", "слова", "словно", "счёт", "счет", "клавиатура", "клавиатуры"]}
    lex = spark.createDataFrame([(k, w) for k, ws in words.items() for w in ws], "lang string, word string")
    monkeypatch.setattr(P, "lex", lambda *_: lex)

    def edits(w):
        letters = "abcdefghijklmnopqrstuvwxyzабвгдеёжзийклмнопрстуфхцчшщъыьэюя"
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        return (out | {a + x + b for a, b in cuts for x in letters} | {a + x + b[1:] for a, b in cuts if b for x in letters}) - {w}

    rows = [tuple(r) for r in P.single_edits(spark, "").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(a, b) for ws in words.values() for a in ws for b in ws if b in edits(a)}


def evidence(spark, pairs=()):
    """Small lists for spelling decisions."""
    ranked = [("en", w, i + 1) for i, w in enumerate(["because", "keyboard", "letter", "better"])] + [("ru", w, i + 1) for i, w in enumerate(["слово", "клавиша", "учится", "учиться", "словарь", "он", "хочет"])]
    words = lambda *x: spark.createDataFrame([(w,) for w in x], "word string")
    known = spark.createDataFrame([(g, w) for g, w, _ in ranked] + [("ru", "словоа")], "lang string, word string")
    counts = spark.createDataFrame([(w, 50) for g, w, _ in ranked if g == "ru"], "word string, cnt long")
    return C.Evidence(
        spark.createDataFrame(ranked, "lang string, word string, rank int"),
        known,
        spark.createDataFrame([("вобщем", "в общем")], "word string, spelled string"),
        words("клавишка"),
        words("клавишо"),
        spark.createDataFrame([("Becuase",)], "token string"),
        spark.createDataFrame(list(pairs), "prev string, next string, cnt long") if pairs else None,
        counts,
        counts,
        1000,
    )


def test_decisions(spark):
    """Every reason of the cascade, expected by hand."""
    typed = [("keybaord", None, False), ("because", None, False), ("becuase", None, False), ("вобщем", None, False), ("recieve", None, False), ("abc", None, False), ("слво", None, False), ("Keybaord", None, True), ("KEYS", None, False), ("mixед", None, False), ("клавишка", None, False), ("клавишо", None, False), ("клавиаш", None, False), ("Клавиаш", None, True), ("Клавиаш", None, False), ("betetr", None, False), ("netter", None, False), ("словао", None, False), (None, None, False), ("becuase", None, False)]
    words = spark.createDataFrame(typed, "word string, previous string, at_start boolean")
    got = {(r.word, r.at_start): (r.corrected, r.reason) for r in C.decisions(words, evidence(spark)).collect()}
    assert got == {
        ("keybaord", False): ("keyboard", "typo"), ("because", False): (None, "known-original"), ("becuase", False): (None, "exception"), ("вобщем", False): ("в общем", "typo-known-misspelling"),
        ("recieve", False): (None, "no-candidate"), ("abc", False): (None, "protected-shape"), ("слво", False): (None, "protected-shape"), ("Keybaord", True): (None, "protected-case"), ("KEYS", False): (None, "protected-case"),
        ("mixед", False): (None, "protected-script"), ("клавишка", False): (None, "known-corpus"), ("клавишо", False): (None, "colloquial"), ("клавиаш", False): ("клавиша", "typo"), ("Клавиаш", True): ("Клавиша", "typo"),
        ("Клавиаш", False): (None, "protected-case"), ("betetr", False): ("better", "typo"), ("netter", False): (None, "ambiguous-candidate"), ("словао", False): (None, "ambiguous-form"),
    }
    weak = C.decisions(words.where("word = 'Клавиаш' and at_start"), evidence(spark), replace(C.AUTO, capital_margin=4.5)).first()
    assert (weak.corrected, weak.reason) == (None, "ambiguous-capital")
    off = C.decisions(words.where("word = 'клавиаш'"), evidence(spark), replace(C.AUTO, russian=False)).first()
    assert off.reason == "ru-typo-disabled" and C.decisions(words.limit(0), evidence(spark)).count() == 0
    manual = C.decisions(words.where("word = 'Клавиаш' and not at_start"), evidence(spark), C.MANUAL).first()
    assert (manual.corrected, manual.reason) == ("Клавиша", "typo-manual")


def test_decisions_by_the_word_before(spark):
    e = evidence(spark, [("хочет", "учиться", 60), ("он", "учится", 60)])
    words = spark.createDataFrame([("учится", "хочет", False), ("учится", "он", False), ("учиться", "Он", False), ("учится", None, False), ("клавиаш", "хочет", False)], "word string, previous string, at_start boolean")
    got = {(r.word, r.previous): (r.corrected, r.reason) for r in C.decisions(words, e).collect()}
    assert got == {("учится", "хочет"): ("учиться", "typo-context-tsya"), ("учится", "он"): (None, "known-original"), ("учиться", "он"): ("учится", "typo-context-tsya"), ("учится", None): (None, "known-original"), ("клавиаш", "хочет"): ("клавиша", "typo")}
    veto = C.decisions(words.where("word = 'клавиаш'"), e, replace(C.AUTO, context_veto=-0.1)).first()
    assert veto.reason == "context-mismatch"


def test_layout_decisions(spark):
    lex = spark.createDataFrame([("ru", w, w, 9, i + 1, len(w)) for i, w in enumerate(["привет", "как", "мы"])] + [("en", w, w, 9, i + 1, len(w)) for i, w in enumerate(["hello", "vs"])], "lang string, word string, key string, cnt long, rank int, len int")
    words = spark.createDataFrame([("ghbdtn", None), ("hello", True), ("rfr", True), ("rfr", False), ("the", True), ("Ghjcnj", False), ("ghbdtn.org", False), ("API", False), (None, True), ("z", True), ("vs", True)], "token string, near boolean")
    scores = spark.createDataFrame([("ghbdtn", 3.0), ("Ghjcnj", 3.0), ("rfr", -3.0), ("ghbdtn.org", 9.0)], "token string, logit double")
    model = L.trigram_model(lex, "^^", F.ln(1 + F.col("cnt")))
    got = {(r.token, r.near): (r.reason, r.should_convert) for r in D.layout_decisions(words, lex, model, 1.0, spark.createDataFrame([("Простo",), ("GHJCNJ",)], "token string"), scores).collect()}
    assert got == {
        ("ghbdtn", False): ("trained-model", True), ("hello", True): ("known-original", False), ("rfr", True): ("context-short-word", True), ("rfr", False): ("model-below-threshold", False),
        ("the", True): ("known-original", False), ("Ghjcnj", False): ("exception", False), ("ghbdtn.org", False): ("domain-or-dot", False), ("API", False): ("abbreviation", False), ("z", True): ("length", False), ("vs", True): ("context-short-word", True),
    }
    none = D.layout_decisions(words.where("token = 'ghbdtn'"), lex, model, None).first()
    assert none.reason == "model-below-threshold" and none.logit is not None and D.layout_decisions(words.limit(0), lex, model, 1.0).count() == 0


def test_calibration(spark):
    import random

    rnd = random.Random(1)
    rows = [(0, rnd.gauss(0, 1)) for _ in range(3000)] + [(0, 2.5)] * 5 + [(1, 5.0)] * 10
    s = spark.createDataFrame(rows, "label int, score double")
    neg = sorted((x for y, x in rows if y == 0), reverse=True)
    t = M.calibrated(s, 0.01, bins=64).first()["threshold"]
    assert t == pytest.approx(neg[int(len(neg) * 0.01)])
    assert M.calibrated(s.where("label = 1")).first()["threshold"] is None


def test_rate_limiter_and_exceptions(spark):
    e = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", 5), (2, 1, "2024-01-01 00:00:02", 5), (3, 1, "2024-01-01 00:00:06", None), (4, 1, None, 5)], "event_id long, user_id long, ts string, size int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.event_id: r.accepted for r in G.accepted(e).collect()} == {1: True, 2: False, 3: True, 4: False}
    t = spark.createDataFrame([("Ab",), ("ab",), ("c",), (None,)], "token string")
    assert [tuple(r) for r in G.learned_exceptions(t, "token").collect()] == [("ab", 2)]


def test_readers(spark, tmp_path):
    (tmp_path / "l.txt").write_text("﻿Слово\nёж\nеж\nab1\nx\nдом\n", encoding="utf-8")
    assert [tuple(r) for r in R.ranked_words(spark, str(tmp_path / "l.txt")).orderBy("rank").collect()] == [("слово", "слово", 1), ("ёж", "еж", 2), ("дом", "дом", 3)]
    (tmp_path / "c.txt").write_text("one\ntwo 7\none 3\n")
    assert {tuple(r) for r in R.counted_words(spark, str(tmp_path / "c.txt")).collect()} == {("one", 3), ("two", 7)}
    (tmp_path / "p.txt").write_text("# c\nслво → слива\nСлво → Слово\nбез\n", encoding="utf-8")
    assert [tuple(r) for r in R.word_pairs(spark, str(tmp_path / "p.txt")).collect()] == [("слво", "слово")]
    (tmp_path / "t.txt").write_text("я бду → буду\nteh -> the\n", encoding="utf-8")
    assert {(tuple(r.context), r.typed, r.intended) for r in R.typos_in_context(spark, str(tmp_path / "t.txt")).collect()} == {(("я",), "бду", "буду"), ((), "teh", "the")}
    (tmp_path / "s.tsv").write_text("rus_a\tда нет\nnone\neng_a\tyes\tno\n", encoding="utf-8")
    assert {tuple(r) for r in R.sentences_after_tab(spark, str(tmp_path / "s.tsv")).collect()} == {("rus_a", "да нет", "ru"), ("eng_a", "yes\tno", "en")}
    (tmp_path / "u.conllu").write_text("# genre = news\n# text = no\n# genre = social\n# text = yes\n1\tx\n# text = also\n")
    assert {r.sentence for r in R.treebank_texts(spark, str(tmp_path / "u.conllu")).collect()} == {"yes", "also"}
    (tmp_path / "j.jsonl").write_text('{"source":"a","correction":"b"}\n\n{"source":"c"}\n')
    assert {tuple(r) for r in R.json_pairs(spark, str(tmp_path / "j.jsonl")).collect()} == {("a", "b"), ("c", None)}
    (tmp_path / "r.tsv").write_text('# note\nid\tcontext\n1\t"a ""b"""\n')
    assert [tuple(r) for r in R.reviews(spark, str(tmp_path / "r.tsv")).collect()] == [("1", 'a "b"')]
    df = spark.createDataFrame([("train", "x", 1), ("dev", "y", 2)], "split string, a string, n int")
    R.write_splits(df, str(tmp_path / "out"))
    R.write_report(df, str(tmp_path / "rep"))
    R.write_review(df, str(tmp_path / "rev"), ["a"])
    assert (tmp_path / "out" / "split=dev").is_dir() and spark.read.json(str(tmp_path / "rep")).count() == 2
    assert R.comparison(df, "a", "split", "n").columns == ["a", "dev", "train"]


def judged(spark, tokens, threshold=None, **more):
    lex = spark.createDataFrame([("ru", w, 9) for w in ("привет", "мир", "не", "спасибо")] + [("en", "hello", 9)], "lang string, word string, cnt long")
    spelled = more.pop("spelled", None)
    return B.verdicts(tokens, B.form_facts(tokens, lex, L.trigram_model(lex, "^^", F.ln(1 + F.col("cnt"))), threshold, **more), spelled)


def test_boundary_scenarios(spark):
    """Punctuation, repairs, resets, exceptions and spellings; expected by hand."""
    texts = [(1, 'yt ghbdtn, hello cgfcb,j "ghbdtn" x'), (2, "yt. ghbdtn"), (3, "yt  ghbdtn"), (4, "vbh ghbdtn!\nvbh"), (5, "teh ghbdtn@x Teh"), (6, None), (7, ""), (8, "Ghbdtn htlrj, rfr"), (1, "hello")]
    df = spark.createDataFrame(texts, "session long, text string")
    chunks = B.chunked(df)
    tokens = B.chunk_tokens(chunks)
    fix = spark.createDataFrame([("teh", "the", None), ("Teh", None, "The")], "word string, corrected string, at_start string")
    v = judged(spark, tokens, 0.5, exceptions=spark.createDataFrame([("htlrj",)], "token string"), spelled=fix)
    rows = B.replay(chunks, tokens, v).orderBy("session", "seq").collect()
    got = {s: [(r.replacement, r.changed, r.erased) for r in rows if r.session == s] for s in range(2, 9)}
    assert got[2] == [("не.", True, 0), ("привет", True, 0)] and got[3] == [("не", True, 0), ("", False, 0), ("привет", True, 0)]
    assert got[4] == [("мир", True, 0), ("привет", True, 0), ("", False, 0), ("мир", True, 0)] and got[5] == [("the", True, 0), ("ghbdtn@x", False, 0), ("Teh", False, 0)]
    assert got[8] == [("Привет", True, 0), ("htlrj,", False, 0), ("rfr", False, 0)] and got[6] == got[7] == []
    out = {r.session: r.text for r in B.retyped(chunks, tokens, v).where("session <> 1").collect()}
    assert out == {2: "не. привет", 3: "не  привет", 4: "мир привет!\nмир", 5: "the ghbdtn@x Teh", 7: "", 8: "Привет htlrj, rfr"}
    # without a model short words wait for the word after them
    late = {(r.session, r.seq): (r.original, r.replacement, r.erased, r.reason) for r in B.replay(chunks, tokens, judged(spark, tokens.where("token <> 'ghbdtn'"), None)).collect()}
    assert late[(2, 0)] == ("yt.", "yt.", 0, "model-below-threshold") and late[(4, 1)] == ("ghbdtn", "ghbdtn", 0, "not-judged")


def test_short_words_are_repaired():
    at = lambda *v: "\x1e".join("\x1f".join(x) for x in v)
    yt = (1, True, at(*[("yt", "model-below-threshold", "0001")] * 2, *[("не", "context-short-word", "1102")] * 2, ("yt", "model-below-threshold", "0001")))
    ghbdtn = (1, False, at(*[("привет", "trained-model", "1102")] * 5))
    w = B.Walk()
    assert w.step("yt", " ", yt)[1:4] == ("yt", False, 0) and w.step("ghbdtn", " ", ghbdtn) == ("yt ghbdtn", "не привет", True, 3, "trained-model")
    assert w.last == (2, 2) and w.step("yt", " ", yt)[1] == "не"
    for between in ("", None):
        w = B.Walk()
        w.step("yt", " ", yt)
        w.step(*(("", " ", None) if between == "" else ("???", " ", None)))
        assert w.step("ghbdtn", " ", ghbdtn)[3] == 0
    w = B.Walk()
    w.step("yt", "\n", yt)
    assert w.step("ghbdtn", " ", ghbdtn)[3] == 0 and B.rebuilt([("yt", " ", "yt", "yt", False, 0, ""), ("ghbdtn", " ", "yt ghbdtn", "не привет", True, 3, "")]) == "не привет "


def test_streams(spark, tmp_path):
    tokens = spark.createDataFrame([(1, 0, "yt", " "), (1, 1, "ghbdtn", " "), (2, 0, "hello", " "), (2, 1, None, None), (1, 2, "vbh", "\n"), (2, 2, "qq", " ")], "session long, seq int, token string, separator string")
    v = written(judged(spark, tokens.where("token <> 'qq'"), 0.5), "judged")
    for i in (0, 1, 2):  # one token of a session a batch: context lives in the state
        tokens.where(F.col("seq") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    got = {(r.session, r.seq): (r.replacement, r.reason) for r in run(replay_stream(src, v), "sessions").collect()}
    assert got == {(1, 0): ("не", "trained-model"), (1, 1): ("привет", "trained-model"), (1, 2): ("мир", "context-short-word"), (2, 0): ("hello", "known-original"), (2, 1): ("", "empty"), (2, 2): ("qq", "not-judged")}
    calls = spark.sql("select 1L as user_id, id as event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, id * 2) as ts, 10 as size, 'x' as event_type from range(4)")
    calls.write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))
    assert {r.event_id: r.accepted for r in run(rate_limited_stream(stream), "limits").collect()} == {0: True, 1: False, 2: False, 3: True}
    assert run(counted_stream(stream), "counts", "complete").collect()[0].n == 4


def test_grouped_sessions_keep_their_walks(spark, tmp_path):
    """A state for many sessions: a walk goes on in the next batch, null is a session, and large ids stay as they are."""
    verdict = lambda text: "\x1e".join(f"{text}{k}\x1f{text}\x1f0001" for k in range(5))
    judged = spark.createDataFrame([(t, b, False, verdict(t)) for t, b in (("aa", 1), ("бб", 2))], "token string, bits int, brief boolean, verdicts string")
    tokens = "session long, seq int, token string, separator string"
    big = 2**60 + 1
    for batch in ([(big, 1, "бб", " "), (big, 0, "aa", " "), (None, 0, "aa", " ")], [(big, 2, "aa", " "), (None, 1, "бб", " "), (big + 1, 0, "aa", " ")]):
        spark.createDataFrame(batch, tokens).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(name, **more):
        src = spark.readStream.schema(tokens).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        replay_stream(src, judged, **more).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return {(r.session, r.seq): r.replacement for r in spark.table(name).collect()}

    want = {(big, 0): "aa4", (big, 1): "бб1", (big, 2): "aa1", (None, 0): "aa4", (None, 1): "бб1", (big + 1, 0): "aa4"}
    assert run("grouped", groups=1) == want
    with pytest.raises(ValueError, match="one by one"):
        replay_stream(spark.createDataFrame([], tokens), judged, at="ts", groups=1)


def test_stream_equals_batch(spark):
    from typeloom.plans import judged as P

    order = lambda d: sorted(tuple(r) for r in d.collect())
    assert order(P.boundary_stream(spark, "/root/testdata/sf0.001")) == order(P.boundary_replay(spark, "/root/testdata/sf0.001"))


def test_manifest_covers_every_rank(spark, monkeypatch):
    from typeloom.plans import corpus as P

    rows = [("en", f"w{i}", 2, i) for i in range(1, 1102)] + [("ru", "да", 9, 1)]

    def digests(rows):
        monkeypatch.setattr(P, "lex", lambda *_: spark.createDataFrame(rows, "lang string, word string, cnt long, rank int"))
        return {r.lang: (r.n_rows, r.digest) for r in P.manifest(spark, "").collect()}

    first = digests(rows)
    assert first == digests(rows[::-1]) and first["en"][0] == 1101
    for changed in (("en", "w1101", 1, 1101), ("en", "x1101", 2, 1101), ("en", "w1101", 2, 1102)):
        got = digests([r for r in rows if r[1] != "w1101"] + [changed])
        assert got["en"] != first["en"] and got["ru"] == first["ru"]


def test_training_rows(spark):
    """Four words a sentence, the script most words are in, and five shapes of every tenth first word; expected by hand."""
    rows = [(1, "Красивый дом word стоит у реки давно"), (2, "one два"), (3, "one two слово три four"), (4, None), (5, "..."), (6, "да нет yes no и"), (7, "x" * 36 + " one two three"), (8, "a " * 3 + "y" * 30)]
    got = M.training_rows(spark.createDataFrame(rows, "sent_id long, sentence string")).collect()
    right = [(r.token, tuple(r.previous)) for r in got if r.kind == "right"]
    assert sorted(right) == sorted([
        ("Красивый", ()), ("стоит", ("Красивый", "дом")), ("реки", ("стоит", "у")), ("давно", ("у", "реки")),
        ("one", ()), ("two", ("one",)), ("four", ("one", "two")),
        ("да", ()), ("нет", ("да",)), ("и", ("да", "нет")),
        ("one", ()), ("two", ("one",)), ("three", ("one", "two")),
        ("a", ()), ("a", ("a",)), ("a", ("a", "a")),
    ])
    assert {r.token for r in got if r.label == 1} >= {"Rhfcbdsq", "cnjbn", "htrb", "щту", "ецщ", "lf", "ytn"}
    firsts = [(i, f"{w} второе третье четвёртое") for i, w in enumerate(f"слово{x}{y}" for x in "абвгдежз" for y in "абвгдежз")]
    shapes = [r.token for r in M.training_rows(spark.createDataFrame(firsts, "sent_id long, sentence string")).where("kind = 'structured'").collect()]
    kept = {t.removesuffix("42") for t in shapes if t.endswith("42")}
    assert kept and set(shapes) == {x for w in kept for x in (w + "42", w + "_id", w + ".com", "https://" + w + ".org", w + "En")}


def test_training_rows_cut_a_sentence_once(spark):
    """Neither filters nor the words of a sentence make its tokens be cut again."""
    rows = M.training_rows(spark.createDataFrame([(1, "one two three")], "sent_id long, sentence string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_layout_model_sees_protected_shapes(spark, monkeypatch):
    from typeloom.plans import sessions as P

    ru = [f"{a}{b}{c}" for a in "бвгджз" for b in "аеиоу" for c in "клмнп"]
    rows = [(i, " ".join(ru[i : i + 4])) for i in range(len(ru) - 3)]
    frame = spark.createDataFrame(rows, "sent_id long, sentence string")
    seen = []
    vectors = M.vectors
    monkeypatch.setattr(P, "sentences", lambda *_: frame)
    monkeypatch.setattr(M, "vectors", lambda d: seen.append(d) or vectors(d))
    P.layout_model(spark, "").collect()
    assert {r.token for r in seen[0].collect()} == {r.token for r in M.training_rows(frame).collect()}


def test_domain_texts(spark, tmp_path):
    deep = {"a": [{"b": {"c": [{"d": {"Text": "One two three. Four five six!", "other": "no no no. no no no"}}]}}]}
    (tmp_path / "a.json").write_text(json.dumps(deep))
    (tmp_path / "b.md").write_text("Раз два три. ```код код код. код код код.``` Один https://x.yz/a.b два <b>три</b>\nпять")
    (tmp_path / "c.txt").write_text("Only one sentence here. no")
    (tmp_path / "d.json").write_text("{broken")
    got = [(r.file.rsplit("/", 1)[1], r.at, " ".join(r.sentence.split())) for r in R.domain_texts(spark, str(tmp_path)).orderBy("file", "at").collect()]
    assert got == [("a.json", 0, "One two three"), ("a.json", 1, "Four five six"), ("b.md", 0, "Раз два три"), ("b.md", 1, "Один два три")]


def test_written_tables_are_removed(spark):
    from typeloom import tables

    kept = tables._WRITTEN[:]
    tables._WRITTEN.clear()
    path = Path(tables.shared_dir(spark).removeprefix("file://"))
    assert written(spark.range(3), "removable").count() == 3 and list(path.glob("typeloom-removable-*"))
    assert tables.removed() == 1 and not list(path.glob("typeloom-removable-*")) and tables.removed() == 0
    tables._WRITTEN.extend(kept)


def test_artifacts_tell_damage(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5)], "word string, cnt int, w double")
    A.write_artifact(df, str(tmp_path / "x"), "counts", ["word"])
    assert sorted(map(tuple, A.read_artifact(spark, str(tmp_path / "x"), "counts").collect())) == [("a", 1, None), ("b", 2, 0.5)]
    with pytest.raises(ValueError, match="holds no weights"):
        A.read_artifact(spark, str(tmp_path / "x"), "weights")
    spark.createDataFrame([("a", 1, None), ("b", 3, 0.5)], df.schema).write.mode("overwrite").parquet(str(tmp_path / "x" / "data"))
    with pytest.raises(ValueError, match="is not what was written"):
        A.read_artifact(spark, str(tmp_path / "x"), "counts")


def test_suggestions_buffers_and_stale_results(spark):
    rows = [(1, "Я бду там", '{"matches":[{"offset":2,"length":3,"replacements":[{"value":"буду"},{"value":"бду"}]},{"offset":0,"length":1,"replacements":[]},{"offset":90,"length":1,"replacements":[{"value":"x"}]}]}'), (2, "ok", "no json"), (3, "ok", None)]
    df = spark.createDataFrame(rows, "id long, t string, answer string")
    assert {r.id: r.edited for r in G.edited(G.with_suggestions(df, "answer"), "t", "edits").collect()} == {1: "Я буду там", 2: "ok", 3: "ok"}
    w = G.WordBuffer(longest=5)
    feed = lambda *steps: [w.feed(*s) for s in steps][-1]
    assert feed(("text", "ghbx"), ("back",), ("text", "d"), ("end",)) == "ghbd" and feed(("text", "a"), ("move",), ("end",)) is None
    assert feed(("text", "abcdef"), ("back",), ("end",)) is None and feed(("text", "/"), ("text", "x"), ("end",)) is None and feed(("text", "ok"), ("end",)) == "ok"
    res = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 5, "x"), (3, 1, "y")], "session long, revision long, r string")
    assert {r.r for r in G.current(res, spark.createDataFrame([(1, 2), (1, 1), (2, 6)], "session long, revision long")).collect()} == {"new"}


def test_entry_lists_queries():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "layout_decide" in q and len(q) > 60


def test_queries_over_empty_tables(spark, tmp_path):
    """Every query of the core runs over tables without rows; only totals give a row."""
    import pyarrow.parquet as pq

    import __spark_entry__ as e

    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        pq.write_table(pq.read_table(f).slice(0, 0), tmp_path / f.name)
    for name, query in e.queries().items():
        if name.startswith(("p1_", "token", "ranked", "pair_", "typo_best", "layout_eval", "misspelling", "offered", "layout_model", "manual_options", "layout_decide", "typo_decide", "boundary_replay", "reviewed", "list_lines", "suggestion")):
            assert query(spark, str(tmp_path)).count() <= 1, name
