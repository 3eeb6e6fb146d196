"""Queries that judge layouts and spellings, and measure the judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.functions import edits as E
from typeloom.functions import layout as Y
from typeloom.functions import text as T
from typeloom.operators import correct as C
from typeloom.operators import decide as D
from typeloom.operators import lexicon as L
from typeloom.plans.corpus import LEX, TOK, lex, sentences, tok
from typeloom.tables import load, written

_q = lambda s: s.replace("'", "''")
_CONV = lambda c: f"translate({c}, '{_q(Y.FROM)}', '{_q(Y.TO)}')"
_SCRIPT = lambda c: f"CASE WHEN regexp_matches({c}, '[A-Za-z]') AND NOT regexp_matches({c}, '[А-Яа-яЁё]') THEN 'en' WHEN regexp_matches({c}, '[А-Яа-яЁё]') AND NOT regexp_matches({c}, '[A-Za-z]') THEN 'ru' ELSE 'other' END"


def layout_convert(spark, sf_dir):  # noqa: ANN001, ANN201
    w = tok(spark, sf_dir).select("word").distinct()
    c = Y.convert(F.col("word"))
    return w.select("word", c.alias("converted"), Y.convert_letters(F.col("word")).alias("letters_converted"), Y.script(F.col("word")).alias("script"), Y.script(c).alias("target_script"), (Y.convert(c) == F.col("word")).alias("reversible"))


def _letters_sql(c: str) -> str:
    pairs = [(a, b) for a, b in zip(Y.FROM, Y.TO, strict=True) if a.isalpha()]
    return f"translate({c}, '{_q(''.join(a for a, _ in pairs))}', '{_q(''.join(b for _, b in pairs))}')"


def structured_tokens(spark, sf_dir):  # noqa: ANN001, ANN201
    """Why shape alone keeps tokens, over every distinct white-space token."""
    w = sentences(spark, sf_dir).select(F.explode(T.white_space_tokens(F.col("sentence"))).alias("token"))
    w = w.groupBy("token").agg(F.count("*").alias("n")).withColumn("reason", F.coalesce(T.shape_reason(F.col("token")), F.lit("open")))
    return w.groupBy("reason").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"))


_ENDINGS = ", ".join(f"'{x}'" for x in Y.DOMAIN_ENDINGS)


def _shape_sql(t: str) -> str:
    caps = rf"NOT regexp_matches(regexp_replace({t}, '[^\p{{L}}]', '', 'g'), '[^\p{{Lu}}]')"
    ending = f"lower(string_split({t}, '.')[-1])"
    both = lambda c: f"regexp_matches({c}, '[A-Za-z]') = regexp_matches({c}, '[А-Яа-яЁё]')"
    return rf"""CASE WHEN length({t}) < 1 OR length({t}) > 64 THEN 'length'
      WHEN regexp_matches({t}, '[\p{{Nd}}\s@/\\_\-+=#]') OR contains({t}, '://') OR contains({t}, '..') THEN 'structured-token'
      WHEN regexp_full_match({t}, '.+\.[^.]+') AND ({ending} IN ({_ENDINGS}) OR {_CONV(ending)} IN ({_ENDINGS})) THEN 'domain-or-dot'
      WHEN {both(t)} THEN 'mixed-or-unsupported-script'
      WHEN {both(_CONV(t))} THEN 'mixed-target'
      WHEN regexp_matches({t}, '^.[^\p{{Lu}}]*\p{{Lu}}') AND NOT ({caps}) THEN 'identifier'
      WHEN length({t}) BETWEEN 2 AND 4 AND {caps} THEN 'abbreviation'
      WHEN NOT regexp_full_match({t}, '[\p{{L}}`\[\];'',.~{{}}:"<>]*') THEN 'symbols'
      WHEN length(regexp_replace({t}, '[^.]', '', 'g')) > 1 THEN 'domain-or-dot' END"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex(spark, sf_dir).where("cnt >= 2")


def _typed(words: DataFrame) -> DataFrame:
    """Every known word as it is and as typed in the wrong layout; one row per distinct token."""
    right = words.select(F.col("word").alias("token"), F.lit(False).alias("wrong"))
    wrong = words.select(Y.convert(F.col("word")).alias("token"), F.lit(True).alias("wrong"))
    return right.unionByName(wrong).groupBy("token").agg(F.min("wrong").alias("wrong"))


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = written(lex(spark, sf_dir), "lexicon")
    known = words.where("cnt >= 2")
    typed = _typed(words)
    model = L.trigram_model(known, "^^", F.ln(1 + F.col("cnt")))
    return D.legacy_decisions(typed.select("token"), known, model).join(typed, "token")


def layout_detect_legacy(spark, sf_dir):  # noqa: ANN001, ANN201
    d = _legacy(spark, sf_dir)
    return d.groupBy("wrong", "reason").agg(F.count("*").alias("n"), F.sum(F.col("should_convert").cast("int")).alias("n_convert"))


def layout_decisions_legacy(spark, sf_dir):  # noqa: ANN001, ANN201
    return _legacy(spark, sf_dir).select("token", "converted", "should_convert", "reason", F.round("margin", 5).alias("margin"))


def layout_eval(spark, sf_dir):  # noqa: ANN001, ANN201
    """Recall, precision and false share per direction and in all."""
    d = _legacy(spark, sf_dir).withColumn("direction", F.when(Y.has_latin(F.col("token")), "en").otherwise("ru"))
    c = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    g = d.rollup("direction").agg(c(F.col("wrong")).alias("n_wrong"), c(~F.col("wrong")).alias("n_right"), c(F.col("wrong") & F.col("should_convert")).alias("fixed"), c(~F.col("wrong") & F.col("should_convert")).alias("false"))
    r = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return g.select(F.coalesce("direction", F.lit("all")).alias("direction"), "n_wrong", "n_right", "fixed", "false", r(F.col("fixed"), F.col("n_wrong")).alias("recall"), r(F.col("fixed"), F.col("fixed") + F.col("false")).alias("precision"), r(F.col("false"), F.col("n_right")).alias("false_share"))


_LEGACY = rf"""WITH {LEX},
kn AS (SELECT * FROM lex WHERE cnt >= 2),
g AS (SELECT lang, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS gram, ln(1 + cnt) AS w FROM (SELECT *, '^^' || word || '$' AS p FROM kn)),
m AS (SELECT lang, gram, sum(w) AS weight FROM g GROUP BY ALL),
tt AS (SELECT lang, sum(weight) AS total, count(*) AS kinds FROM m GROUP BY lang),
ty AS (SELECT token, min(wrong) AS wrong FROM (SELECT word AS token, false AS wrong FROM lex UNION ALL SELECT {_CONV("word")}, true FROM lex) GROUP BY token),
w0 AS (SELECT token, wrong, {_CONV("token")} AS converted, lower(token) AS lo, lower({_CONV("token")}) AS target, CASE WHEN regexp_matches(token, '[A-Za-z]') THEN 'en' ELSE 'ru' END AS fl, CASE WHEN regexp_matches(token, '[A-Za-z]') THEN 'ru' ELSE 'en' END AS tl FROM ty),
sc AS (SELECT x.lang, x.word, avg(ln((coalesce(m.weight, 0) + 0.1) / (tt.total + 0.1 * tt.kinds))) AS score FROM
  (SELECT lang, word, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS gram FROM (SELECT DISTINCT lang, word, '^^' || word || '$' AS p FROM (SELECT fl AS lang, lo AS word FROM w0 UNION SELECT tl, target FROM w0))) x
  LEFT JOIN m USING (lang, gram) JOIN tt ON tt.lang = x.lang GROUP BY x.lang, x.word),
w1 AS (SELECT w0.*, a.word IS NOT NULL AS fk, b.word IS NOT NULL AS tk, c.word IS NOT NULL AS lk, s1.score AS ss, s2.score AS ts, s2.score - s1.score AS margin, length(token) AS n
  FROM w0 LEFT JOIN kn a ON a.lang = fl AND a.word = lo LEFT JOIN kn b ON b.lang = tl AND b.word = target LEFT JOIN kn c ON c.lang = tl AND c.word = lo
  LEFT JOIN sc s1 ON s1.lang = fl AND s1.word = lo LEFT JOIN sc s2 ON s2.lang = tl AND s2.word = target),
d AS (SELECT *, CASE
  WHEN n < 1 OR n > 64 THEN 'length'
  WHEN regexp_matches(token, '[\p{{Nd}}\s@/\\_\-:+=#]') THEN 'structured-token'
  WHEN regexp_matches(token, '[A-Za-z]') = regexp_matches(token, '[А-Яа-яЁё]') THEN 'mixed-or-unsupported-script'
  WHEN regexp_matches(token, '^.[^\p{{Lu}}]*\p{{Lu}}') AND regexp_matches(regexp_replace(token, '[^\p{{L}}]', '', 'g'), '[^\p{{Lu}}]') THEN 'identifier'
  WHEN n <= 4 AND NOT regexp_matches(regexp_replace(token, '[^\p{{L}}]', '', 'g'), '[^\p{{Lu}}]') THEN 'abbreviation'
  WHEN NOT regexp_full_match(token, '[\p{{L}}`\[\];'',.]*') THEN 'symbols'
  WHEN length(regexp_replace(token, '[^.]', '', 'g')) > 1 OR contains(token, '.') AND NOT regexp_full_match(token, '[^.]*\.') THEN 'domain-or-dot'
  WHEN NOT regexp_full_match(converted, '[\p{{L}}'']*') THEN 'unsupported-target'
  WHEN fk THEN 'known-original'
  WHEN n = 1 THEN 'length'
  WHEN n <= 3 AND (fk OR lk) THEN 'ambiguous-short'
  WHEN tk THEN CASE WHEN margin >= 0.25 THEN 'known-target-and-language-margin' ELSE 'ambiguous-score' END
  WHEN n >= 4 AND ss <= -10.0 AND ts >= -9.1 AND margin >= 2.6 THEN 'trigram-unknown-target'
  ELSE 'insufficient-language-evidence' END AS reason FROM w1),
r AS (SELECT *, reason IN ('known-target-and-language-margin', 'trigram-unknown-target') AS should_convert FROM d)
"""


# --- spelling


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sent_id, split, lang, pos, previous, intended, typed``: a slip in the first word of at least four letters of every sentence, and the word before it."""
    s = sentences(spark, sf_dir).select("sent_id", "split", L.language(F.col("source")).alias("lang"), T.letter_runs(F.col("sentence")).alias("ws"))
    each = F.transform("ws", lambda w, i: F.struct(i.alias("pos"), F.when(i > 0, F.get("ws", i - 1)).alias("previous"), w.alias("intended")))
    first = F.slice(F.filter(each, lambda x: (F.length(x["intended"]) >= 4) & L.pure(F.col("lang"), x["intended"])), 1, 1)
    # by a generator, below which no filter on what it gives is pushed
    s = s.select("sent_id", "split", "lang", F.inline(first))
    return s.withColumn("typed", E.make_typo(F.col("intended"), F.col("sent_id"))).where("typed <> intended")


def _injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(spark, sf_dir).select("sent_id", "lang", "intended", "typed")


def inject_typos(spark, sf_dir):  # noqa: ANN001, ANN201
    return _injected(spark, sf_dir).select("sent_id", "lang", "intended", "typed", E.confusion(F.col("typed"), F.col("intended")).alias("kind"))


def _ranked(words: DataFrame) -> DataFrame:
    """The words that spellings are taken from: those seen three times."""
    return words.where("cnt >= 3")


def _typos(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    return _injected(spark, sf_dir).select("lang", "typed").distinct().join(words.select("lang", F.col("word").alias("typed")), ["lang", "typed"], "left_anti")


def deletes_index(spark, sf_dir):  # noqa: ANN001, ANN201
    return C.delete_index(lex(spark, sf_dir), 2_000).groupBy("lang", "del_key").agg(F.count("*").alias("n_words"), F.min("rank").alias("best_rank")).where("n_words > 1")


def single_edits(spark, sf_dir):  # noqa: ANN001, ANN201
    """Words of either language one edit apart, over the whole lexicon."""
    return C.one_edit_pairs(lex(spark, sf_dir)).select("word", "other")


def typo_candidates(spark, sf_dir):  # noqa: ANN001, ANN201
    words = written(lex(spark, sf_dir), "lexicon")
    return C.candidates(_typos(spark, sf_dir, words), _ranked(words))


def edit_costs(spark, sf_dir):  # noqa: ANN001, ANN201
    words = written(lex(spark, sf_dir), "lexicon")
    return C.scored(C.candidates(_typos(spark, sf_dir, words), _ranked(words))).select("lang", "typed", "word", F.round("cost", 4).alias("cost"), F.round("score", 6).alias("score"), E.confusion(F.col("typed"), F.col("word")).alias("kind"))


def typo_best(spark, sf_dir):  # noqa: ANN001, ANN201
    words = written(lex(spark, sf_dir), "lexicon")
    return C.best(C.scored(C.candidates(_typos(spark, sf_dir, words), _ranked(words)))).select("lang", "typed", "word", F.round("margin", 6).alias("margin"))


def alternatives(spark, sf_dir):  # noqa: ANN001, ANN201
    words = written(lex(spark, sf_dir), "lexicon")
    return C.alternatives(C.scored(C.candidates(_typos(spark, sf_dir, words), _ranked(words))))


def _misspellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed misspellings: the reviewer's word where one is given; one spelling per word."""
    r = load(spark, sf_dir, "known_misspellings_review").where("word is not null and verdict in ('misspelling', 'misspelling-other')")
    right = F.when((F.col("verdict") == "misspelling-other") & F.col("intended").isNotNull(), F.col("intended")).otherwise(F.col("proposed"))
    return r.groupBy(F.lower("word").alias("word")).agg(F.min(F.lower(right)).alias("spelled")).where("spelled is not null")


def misspelling_export(spark, sf_dir):  # noqa: ANN001, ANN201
    return _misspellings(spark, sf_dir)


def misspelling_patterns(spark, sf_dir):  # noqa: ANN001, ANN201
    r = load(spark, sf_dir, "known_misspellings_review").where("word is not null and proposed is not null")
    return r.withColumn("found", E.misspelling_pattern(F.lower("word"), F.lower("proposed"))).groupBy("pattern", "found").agg(F.count("*").alias("n"))


def threshold_sweep(spark, sf_dir):  # noqa: ANN001, ANN201
    """Right and wrong corrections at or above each margin: margins are counted in steps, and only the counts are added up."""
    words = written(lex(spark, sf_dir), "lexicon")
    top = C.best(C.scored(C.candidates(_typos(spark, sf_dir, words), _ranked(words)))).select("lang", "typed", "word", "margin")
    step = F.least(F.lit(8), F.floor((F.col("margin") + 1e-9) / 0.5)).alias("step")
    n = _injected(spark, sf_dir).join(top, ["lang", "typed"]).groupBy("lang", step, (F.col("word") == F.col("intended")).alias("right")).agg(F.count("*").alias("n"))
    at = n.select("lang", "step", "right", "n", F.explode(F.array(*[F.lit(float(x)) for x in (0, 0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4)])).alias("threshold"))
    above = F.col("step") * 0.5 >= F.col("threshold")
    return at.groupBy("lang", "threshold").agg(F.sum(F.when(above & F.col("right"), F.col("n")).otherwise(0)).alias("n_right"), F.sum(F.when(above & ~F.col("right"), F.col("n")).otherwise(0)).alias("n_wrong"))


def outcome_by_distance(spark, sf_dir):  # noqa: ANN001, ANN201
    words = written(lex(spark, sf_dir), "lexicon")
    inj = _injected(spark, sf_dir)
    top = C.best(C.scored(C.candidates(_typos(spark, sf_dir, words), _ranked(words)))).select("lang", "typed", "word", "dist")
    j = inj.join(top, ["lang", "typed"]).withColumn("outcome", F.when(F.col("word") == F.col("intended"), "right").otherwise("wrong"))
    return j.groupBy("lang", F.least("dist", F.lit(3)).alias("distance")).pivot("outcome", ["right", "wrong"]).agg(F.count(F.lit(1))).na.fill(0, ["right", "wrong"])


def fixed_within_k(spark, sf_dir):  # noqa: ANN001, ANN201
    """How many slips are put right within k presses, one option a press."""
    words = written(lex(spark, sf_dir), "lexicon")
    inj = _injected(spark, sf_dir)
    w = Window.partitionBy("lang", "typed").orderBy(F.desc("score"), "rank", "word")
    opts = C.scored(C.candidates(_typos(spark, sf_dir, words), _ranked(words))).withColumn("press", F.row_number().over(w)).where("press <= 5")
    hit = inj.join(opts.select("lang", "typed", F.col("word").alias("intended"), "press"), ["lang", "typed", "intended"]).groupBy("lang", "press").agg(F.count("*").alias("n"))
    return hit.withColumn("fixed", F.sum("n").over(Window.partitionBy("lang").orderBy("press"))).select("lang", "press", "fixed")


def kwic_context(spark, sf_dir):  # noqa: ANN001, ANN201
    """The judged word of each context and its surroundings cut to 40 characters."""
    r = load(spark, sf_dir, "dev_label_review").where("context is not null")
    start = F.instr("context", "[[")
    end = F.instr("context", "]]")
    clean = F.replace(F.replace("context", F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))
    r = r.where((start > 0) & (end > start)).withColumns({"clean": clean, "at": start, "n": end - start - 2})
    return r.select("review_id", F.col("clean").substr(F.col("at"), F.col("n")).alias("judged"), T.kwic(F.col("clean"), F.col("at"), F.col("n"), 40).alias("snippet"))


# SQL of the spelling queries; letters are mapped to single bytes because the oracle's distance counts bytes
_RU33, _ASC33 = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456"
_B = lambda c: f"translate({c}, '{_RU33}', '{_ASC33}')"
_I = "(2 + sent_id % greatest(length(w) - 2, 1))::INT"
_DEL = lambda w: f"list_distinct(list_prepend({w}, list_transform(range(1, length({w}) + 1), lambda i: substr({w}, 1, i - 1) || substr({w}, i + 1))))"
_DEL2 = lambda w: f"list_distinct(flatten(list_transform({_DEL(w)}, lambda v: list_prepend(v, list_transform(range(1, length(v) + 1), lambda i: substr(v, 1, i - 1) || substr(v, i + 1))))))"
_MIS = lambda a, b: f"coalesce(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1))[1], least(length({a}), length({b})) + 1)"
_SWAP = lambda a, b, i: f"(length({a}) = length({b}) AND {a} <> {b} AND substr({a}, {i}, 1) = substr({b}, {i} + 1, 1) AND substr({a}, {i} + 1, 1) = substr({b}, {i}, 1) AND substr({a}, {i} + 2) = substr({b}, {i} + 2))"
_ADJ = ", ".join(f"'{x}'" for k in ("en", "ru") for x in Y.ADJACENT[k])
_TYPOS = rf"""WITH {LEX},
f1 AS (SELECT sent_id, lang, min({{'p': pos, 'w': word}}).w AS w FROM tok WHERE length(word) >= 4 AND (lang = 'en' AND regexp_full_match(word, '[a-z]{{2,32}}') OR lang = 'ru' AND regexp_full_match(word, '[а-яё]{{2,32}}')) GROUP BY sent_id, lang),
f2 AS (SELECT sent_id, lang, w AS intended, CASE
  WHEN sent_id % 3 = 0 OR sent_id % 3 = 1 AND substr(w, {_I}, 1) = substr(w, {_I} + 1, 1) THEN substr(w, 1, {_I} - 1) || substr(w, {_I} + 1)
  WHEN sent_id % 3 = 1 THEN substr(w, 1, {_I} - 1) || substr(w, {_I} + 1, 1) || substr(w, {_I}, 1) || substr(w, {_I} + 2)
  ELSE substr(w, 1, {_I} - 1) || translate(substr(w, {_I}, 1), '{"".join(E.NEXT_KEY)}', '{"".join(E.NEXT_KEY.values())}') || substr(w, {_I} + 1) END AS typed FROM f1),
inj AS (SELECT * FROM f2 WHERE typed <> intended),
ty AS (SELECT DISTINCT lang, typed FROM inj ANTI JOIN (SELECT lang, word AS typed FROM lex) USING (lang, typed)),
ix AS (SELECT lang, word, rank, unnest(CASE WHEN rank <= 15000 THEN {_DEL2("word")} ELSE {_DEL("word")} END) AS k FROM lex WHERE cnt >= 3),
qx AS (SELECT lang, typed, unnest(CASE WHEN length(typed) >= 8 AND lang IN ('en') THEN {_DEL2("typed")} ELSE {_DEL("typed")} END) AS k FROM ty),
c1 AS (SELECT DISTINCT lang, typed, word, rank FROM qx JOIN ix USING (lang, k)),
c2 AS (SELECT *, {_MIS("typed", "word")} AS i FROM c1),
c3 AS (SELECT *, CASE WHEN {_SWAP("typed", "word", "i")} THEN 1 ELSE levenshtein({_B("typed")}, {_B("word")}) END AS dist FROM c2),
cand AS (SELECT * FROM c3 WHERE dist = 1 OR dist = 2 AND lang IN ('en') AND length(typed) >= 8 AND rank <= 10000),
c4 AS (SELECT *, CASE WHEN lang = 'ru' AND i = 1 THEN 0.5 ELSE 0 END AS ini, substr(CASE WHEN length(typed) > length(word) THEN typed ELSE word END, i, 1) IN ('ь', 'ъ') AS sgn FROM cand),
c5 AS (SELECT *, CAST(CASE WHEN dist = 2 THEN 3.2
  WHEN {_SWAP("typed", "word", "i")} THEN 0.55 + ini
  WHEN abs(length(typed) - length(word)) = 1 AND lang = 'ru' AND sgn THEN CASE WHEN length(word) > length(typed) AND i > 1 AND substr(word, i - 1, 1) = 'ш' AND substr(word, i + 1) IN ('', 'ся') THEN 0 ELSE 0.3 END
  WHEN abs(length(typed) - length(word)) = 1 THEN 0.75 + ini
  WHEN substr(typed, i + 1) = substr(word, i + 1) AND substr(typed, i, 1) || substr(word, i, 1) IN ({_ADJ}) THEN 0.65 + ini
  ELSE 1.0 + ini END AS DOUBLE) AS cost FROM c4),
scd AS (SELECT *, -ln(rank + 15) - 1.5 * cost AS score FROM c5),
bst AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM scd WINDOW w AS (PARTITION BY lang, typed ORDER BY score DESC, rank, word)),
top AS (SELECT *, CASE WHEN second IS NULL THEN 4.0 ELSE score - second END AS margin FROM bst WHERE place = 1)
"""
_ENDS = lambda a, b, x, y: f"(ends_with({a}, '{x}') AND ends_with({b}, '{y}') AND substr({a}, 1, length({a}) - {len(x)}) = substr({b}, 1, length({b}) - {len(y)}))"


def _kind_sql(a: str, b: str) -> str:
    i = _MIS(a, b)
    d = f"CASE WHEN {_SWAP(a, b, i)} THEN 1 ELSE levenshtein({_B(a)}, {_B(b)}) END"
    return f"CASE WHEN {a} = {b} OR {d} <> 1 THEN 0 WHEN {_ENDS(a, b, 'тся', 'ться')} OR {_ENDS(a, b, 'ться', 'тся')} THEN 1 WHEN length({a}) > 4 AND ({_ENDS(a, b, 'ете', 'ите')} OR {_ENDS(a, b, 'ите', 'ете')}) THEN 2 ELSE 4 END"


_MISSP = "mis AS (SELECT lower(word) AS typed, min(lower(CASE WHEN verdict = 'misspelling-other' AND intended IS NOT NULL THEN intended ELSE proposed END)) AS spelled FROM known_misspellings_review WHERE word IS NOT NULL AND verdict IN ('misspelling', 'misspelling-other') GROUP BY 1 HAVING spelled IS NOT NULL)"
QUERIES = {
    f.__name__: f
    for f in (layout_convert, structured_tokens, layout_detect_legacy, layout_decisions_legacy, layout_eval, inject_typos, deletes_index, single_edits, typo_candidates, edit_costs, typo_best, alternatives, misspelling_export, misspelling_patterns, threshold_sweep, outcome_by_distance, fixed_within_k, kwic_context)
}
ORACLE = {
    "layout_convert": f"WITH {TOK} SELECT word, {_CONV('word')} AS converted, {_letters_sql('word')} AS letters_converted, {_SCRIPT('word')} AS script, {_SCRIPT(_CONV('word'))} AS target_script, {_CONV(_CONV('word'))} = word AS reversible FROM (SELECT DISTINCT word FROM tok)",
    "structured_tokens": rf"WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(trim(sentence, ' '), '\s+'), lambda x: x <> '')) AS token FROM sentence_corpus), c AS (SELECT token, count(*) AS n FROM w GROUP BY token) SELECT coalesce({_shape_sql('token')}, 'open') AS reason, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_distinct FROM c GROUP BY 1",
    "layout_detect_legacy": _LEGACY + "SELECT wrong, reason, count(*) AS n, CAST(sum(should_convert::INT) AS BIGINT) AS n_convert FROM r GROUP BY ALL",
    "layout_decisions_legacy": _LEGACY + "SELECT token, converted, should_convert, reason, round(margin, 5) AS margin FROM r",
    "layout_eval": _LEGACY
    + """, x AS (SELECT CASE WHEN regexp_matches(token, '[A-Za-z]') THEN 'en' ELSE 'ru' END AS direction, wrong, should_convert FROM r),
    gg AS (SELECT coalesce(direction, 'all') AS direction, CAST(sum(wrong::INT) AS BIGINT) AS n_wrong, CAST(sum((NOT wrong)::INT) AS BIGINT) AS n_right, CAST(sum((wrong AND should_convert)::INT) AS BIGINT) AS fixed, CAST(sum((NOT wrong AND should_convert)::INT) AS BIGINT) AS "false" FROM x GROUP BY ROLLUP (x.direction))
    SELECT *, round(coalesce(fixed / nullif(n_wrong, 0), 0), 6) AS recall, round(coalesce(fixed / nullif(fixed + "false", 0), 0), 6) AS "precision", round(coalesce("false" / nullif(n_right, 0), 0), 6) AS false_share FROM gg""",
    "inject_typos": _TYPOS + f"SELECT sent_id, lang, intended, typed, {_kind_sql('typed', 'intended')} AS kind FROM inj",
    "deletes_index": f"WITH {LEX}, x AS (SELECT lang, rank, unnest(CASE WHEN rank <= 2000 THEN {_DEL2('word')} ELSE {_DEL('word')} END) AS del_key FROM lex) SELECT lang, del_key, count(*) AS n_words, min(rank) AS best_rank FROM x GROUP BY ALL HAVING count(*) > 1",
    "single_edits": f"WITH {LEX}, x AS (SELECT lang, word, unnest({_DEL('word')}) AS k FROM lex), y AS (SELECT DISTINCT a.word, b.word AS other FROM x a JOIN x b ON a.lang = b.lang AND a.k = b.k AND a.word <> b.word) SELECT word, other FROM y WHERE levenshtein({_B('word')}, {_B('other')}) = 1 OR {_SWAP('word', 'other', _MIS('word', 'other'))}",
    "typo_candidates": _TYPOS + "SELECT lang, typed, word, rank, CAST(dist AS INT) AS dist FROM cand",
    "edit_costs": _TYPOS + f"SELECT lang, typed, word, round(cost, 4) AS cost, round(score, 6) AS score, {_kind_sql('typed', 'word')} AS kind FROM scd",
    "typo_best": _TYPOS + "SELECT lang, typed, word, round(margin, 6) AS margin FROM top",
    "alternatives": _TYPOS + "SELECT lang, typed, string_agg(word, ',' ORDER BY place) AS options FROM (SELECT *, max(score) OVER (PARTITION BY lang, typed) AS best FROM bst) WHERE place <= 2 AND best - score <= 6.0 GROUP BY lang, typed",
    "misspelling_export": f"WITH {_MISSP} SELECT typed AS word, spelled FROM mis",
    "threshold_sweep": _TYPOS
    + "SELECT lang, threshold, CAST(sum((margin >= threshold - 1e-9 AND word = intended)::INT) AS BIGINT) AS n_right, CAST(sum((margin >= threshold - 1e-9 AND word <> intended)::INT) AS BIGINT) AS n_wrong FROM (SELECT inj.lang, intended, top.word, margin, unnest([0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0])::DOUBLE AS threshold FROM inj JOIN top USING (lang, typed)) GROUP BY ALL",
    "outcome_by_distance": _TYPOS + 'SELECT lang, CAST(least(dist, 3) AS INT) AS distance, count(*) FILTER (word = intended) AS "right", count(*) FILTER (word <> intended) AS wrong FROM inj JOIN top USING (lang, typed) GROUP BY ALL',
    "fixed_within_k": _TYPOS + "SELECT lang, press, CAST(sum(n) OVER (PARTITION BY lang ORDER BY press) AS BIGINT) AS fixed FROM (SELECT inj.lang, place AS press, count(*) AS n FROM inj JOIN bst ON bst.lang = inj.lang AND bst.typed = inj.typed AND bst.word = inj.intended WHERE place <= 5 GROUP BY ALL)",
}
