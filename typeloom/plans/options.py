"""Queries of the choices offered for words and of mined misspellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from typeloom.functions.text import letter_runs
from typeloom.operators import lexicon as L
from typeloom.operators import options as O
from typeloom.plans.corpus import _KNOWN, _PAIR_KNOWN, _PAIRS, LEX, TOK, _distinct_known, known_forms, lex, word_arrays
from typeloom.plans.decisions import _CONV, _DEL, _MIS, _SCRIPT, _TYPOS, _B, _kind_sql, _ranked, _typos
from typeloom.plans.judged import _CANDS
from typeloom.tables import load, written


def two_edit_options(spark, sf_dir):  # noqa: ANN001, ANN201
    """For the unknown words of the pairs' typed side."""
    words = written(lex(spark, sf_dir), "lexicon")
    typed = load(spark, sf_dir, "correction_pairs").select(F.explode(letter_runs(F.col("source"))).alias("typed")).distinct()
    typed = typed.withColumn("lang", F.when(F.col("typed").rlike("^[a-z]{2,32}$"), "en").when(F.col("typed").rlike("^[а-яё]{2,32}$"), "ru")).where("lang is not null")
    return O.two_edit_fill(typed.join(words.select("lang", F.col("word").alias("typed")), ["lang", "typed"], "left_anti").select("lang", "typed"), _ranked(words))


def unlisted_rivals(spark, sf_dir):  # noqa: ANN001, ANN201
    words = written(lex(spark, sf_dir), "lexicon")
    return O.unlisted_rivals(_typos(spark, sf_dir, words), _ranked(words), _distinct_known(spark, sf_dir)).select("lang", "typed", F.round("rival_score", 6).alias("rival_score"))


def manual_options(spark, sf_dir):  # noqa: ANN001, ANN201
    words = written(lex(spark, sf_dir), "lexicon")
    return O.manual_options(_typos(spark, sf_dir, words), _ranked(words))


def manual_presses(spark, sf_dir):  # noqa: ANN001, ANN201
    """How many words show what after two presses."""
    words = written(lex(spark, sf_dir), "lexicon")
    p = O.pressed(O.manual_options(_typos(spark, sf_dir, words), _ranked(words)), 2)
    return p.groupBy("lang", "kind").agg(F.count("*").alias("n"), F.sum((F.col("shown") == F.col("typed")).cast("int")).alias("n_restored"))


def real_word_fix(spark, sf_dir):  # noqa: ANN001, ANN201
    words = lex(spark, sf_dir)
    return O.real_word_fixes(L.pair_counts(word_arrays(spark, sf_dir), words), words).withColumn("margin", F.round("margin", 6))


def misspelling_mine(spark, sf_dir):  # noqa: ANN001, ANN201
    return O.mined_misspellings(lex(spark, sf_dir), known_forms(spark, sf_dir))


def _pattern_sql(w: str, r: str) -> str:
    i = _MIS(w, r)
    return f"""(SELECT CASE
      WHEN ends_with(w, 'тся') AND r = substr(w, 1, length(w) - 3) || 'ться' OR ends_with(r, 'тся') AND w = substr(r, 1, length(r) - 3) || 'ться' THEN 'tsya'
      WHEN length(w) = length(r) AND w <> r AND substr(w, i + 1) = substr(r, i + 1) THEN CASE
        WHEN a || b IN ('ьъ', 'ъь') THEN 'soft_hard_sign' WHEN a || b = 'зс' AND (i = 1 OR substr(w, 1, i) IN ('раз', 'без', 'из', 'воз', 'низ', 'через')) THEN 'z_s_prefix'
        WHEN a || b IN ('ао', 'оа', 'еи', 'ие') AND i < length(w) THEN 'unstressed_vowel' WHEN a || b IN ('шщ', 'щш', 'чщ', 'щч') THEN 'sh_shch' END
      WHEN length(g) = length(k) + 1 AND substr(g, i + 1) = substr(k, i) THEN CASE
        WHEN substr(g, i, 1) IN ('ь', 'ъ') THEN 'soft_hard_sign' WHEN i > 1 AND substr(g, i, 1) = substr(g, i - 1, 1) OR substr(g, i, 1) = substr(g, i + 1, 1) THEN 'double_letter' WHEN i > 1 AND i < length(g) THEN 'missing_letter' END END
      FROM (SELECT *, substr(w, i, 1) AS a, substr(r, i, 1) AS b, CASE WHEN length(w) > length(r) THEN w ELSE r END AS g, CASE WHEN length(w) > length(r) THEN r ELSE w END AS k FROM (SELECT {w} AS w, {r} AS r, {i} AS i)))"""


_ALTS = """, al AS (SELECT lang, typed, list(word ORDER BY place) AS alts FROM (SELECT *, max(score) OVER (PARTITION BY lang, typed) AS best FROM bst) WHERE place <= 2 AND best - score <= 6.0 GROUP BY lang, typed),
mo AS (SELECT ty.lang, ty.typed, {conv} AS conv, o.word IS NOT NULL AS lk, top.word AS fix, coalesce(top.margin >= 2.5 AND top.rank <= CASE WHEN ty.lang = 'ru' THEN 200000 ELSE 12000 END AND length(ty.typed) >= 4, false) AS sure, list_filter(coalesce(alts, []), lambda x: x <> {conv}) AS sp
  FROM ty LEFT JOIN (SELECT * FROM lex WHERE cnt >= 3) o ON o.lang <> ty.lang AND o.word = {conv} LEFT JOIN top ON top.lang = ty.lang AND top.typed = ty.typed LEFT JOIN al ON al.lang = ty.lang AND al.typed = ty.typed),
opt AS (SELECT lang, typed, CASE WHEN lk THEN 'layout-known' WHEN sure THEN 'spelling-certain' WHEN len(sp) > 0 THEN 'spelling' ELSE 'layout' END AS kind,
  CASE WHEN lk THEN list_concat([conv], sp) WHEN sure THEN list_concat([fix], list_filter(sp, lambda x: x <> fix)) WHEN len(sp) > 0 THEN list_concat(sp, [conv]) ELSE [conv] END AS o FROM mo)
""".replace("{conv}", _CONV("ty.typed"))
_WIDE = _TYPOS.replace("rank <= 15000", "rank <= 50000").replace("length(typed) >= 8", "length(typed) >= 6").replace("rank <= 10000", "rank <= 50000").replace("lang IN ('en')", "lang IN ('en', 'ru')")
_WIDE = _WIDE.replace(
    "ty AS (SELECT DISTINCT lang, typed FROM inj ANTI",
    r"sw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(source), '\p{L}+')) AS typed FROM correction_pairs), sl AS (SELECT typed, CASE WHEN regexp_full_match(typed, '[a-z]{2,32}') THEN 'en' WHEN regexp_full_match(typed, '[а-яё]{2,32}') THEN 'ru' END AS lang FROM sw), ty AS (SELECT DISTINCT lang, typed FROM (SELECT * FROM sl WHERE lang IS NOT NULL) ANTI",
)
_MASK = lambda w: f"list_reduce(list_prepend(0::UBIGINT, list_transform(range(1, length({w}) + 1), lambda i: (1::UBIGINT << (unicode(substr({w}, i, 1)) % 64)))), lambda a, b: a | b)"

QUERIES = {f.__name__: f for f in (two_edit_options, unlisted_rivals, manual_options, manual_presses, real_word_fix, misspelling_mine)}
ORACLE = {
    "two_edit_options": _WIDE
    + f"SELECT lang, typed, word, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY lang, typed ORDER BY rank, word) AS place FROM (SELECT * FROM cand WHERE dist = 2 AND bit_count(xor({_MASK('typed')}, {_MASK('word')})) <= 4) ANTI JOIN (SELECT lang, typed FROM cand WHERE dist = 1) USING (lang, typed)) WHERE place <= 2",
    "unlisted_rivals": _TYPOS
    + f"{_PAIR_KNOWN}, rq AS (SELECT * FROM lex WHERE cnt >= 3), fo AS (SELECT lang, word, rank, 0.0 AS bonus FROM (SELECT * FROM pk ANTI JOIN rq USING (lang, word)) JOIN (SELECT lang, max(rank) + 1 AS rank FROM rq GROUP BY lang) USING (lang)) "
    + f"SELECT lang, typed, round(max(score), 6) AS rival_score FROM {_CANDS('fo', 'ty', '')} WHERE dist = 1 GROUP BY ALL",
    "manual_options": _TYPOS + _ALTS + "SELECT lang, typed, kind, array_to_string(o, '|') AS options FROM opt",
    "manual_presses": _TYPOS + _ALTS + "SELECT lang, kind, count(*) AS n, CAST(sum((CASE WHEN 2 % (len(o) + 1) = 0 THEN typed ELSE o[2 % (len(o) + 1)] END = typed)::INT) AS BIGINT) AS n_restored FROM opt GROUP BY ALL",
    "real_word_fix": f"WITH {LEX}{_PAIRS}, dk AS (SELECT lang, word, cnt, unnest({_DEL('word')}) AS k FROM lex), nr AS (SELECT DISTINCT x.lang, x.word AS a, y.word AS b, x.cnt AS ac, y.cnt AS bc FROM dk x JOIN dk y ON x.lang = y.lang AND x.k = y.k AND x.word <> y.word), nk AS (SELECT *, {_kind_sql('a', 'b')} AS kind FROM nr), "
    + "nf AS (SELECT * FROM nk WHERE kind <> 0 AND (kind <> 4 OR bc >= 10 * ac)), j AS (SELECT p.lang, p.prev, a, b, kind, p.cnt AS tc, q.cnt AS cc FROM pr p JOIN nf ON nf.lang = p.lang AND nf.a = p.next JOIN pr q ON q.lang = p.lang AND q.prev = p.prev AND q.next = nf.b WHERE q.cnt >= 3), "
    + "k AS (SELECT *, row_number() OVER w AS place, coalesce(lead(cc) OVER w, 0) AS second FROM j WINDOW w AS (PARTITION BY lang, prev, a ORDER BY cc DESC, b)) SELECT lang, prev, a AS word, b AS fixed, kind, round(ln((cc + 0.5) / (greatest(tc, second) + 0.5)), 6) AS margin FROM k WHERE place = 1 AND ln((cc + 0.5) / (greatest(tc, second) + 0.5)) >= 1.0",
    "misspelling_mine": f"WITH {LEX}{_KNOWN}, od AS (SELECT lang, word AS w, CASE WHEN cnt >= 3 THEN rank END AS wr, unnest({_DEL('word')}) AS k FROM lex ANTI JOIN known USING (lang, word) WHERE len >= 5 AND lang = 'ru'), ri AS (SELECT lang, word AS r, rank AS rr, unnest({_DEL('word')}) AS k FROM lex SEMI JOIN known USING (lang, word) WHERE rank <= 50000 AND cnt >= 3 AND lang = 'ru'), "
    + f"nr AS (SELECT DISTINCT od.lang, w, wr, r, rr FROM od JOIN ri ON od.lang = ri.lang AND od.k = ri.k WHERE w <> r AND (wr IS NULL OR wr >= 20 * rr) AND levenshtein({_B('w')}, {_B('r')}) = 1), np AS (SELECT *, {_pattern_sql('nr.w', 'nr.r')} AS pattern FROM nr), "
    + "nb AS (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY list_position(['soft_hard_sign', 'tsya', 'double_letter', 'z_s_prefix', 'unstressed_vowel', 'sh_shch', 'missing_letter'], pattern), rr, r) AS place FROM np WHERE pattern IS NOT NULL AND (pattern <> 'missing_letter' OR rr <= 20000 AND wr IS NULL)) SELECT lang, w AS word, r AS \"right\", pattern FROM nb WHERE place = 1",
    "misspelling_patterns": f"SELECT pattern, found, count(*) AS n FROM (SELECT r0.pattern, {_pattern_sql('lower(r0.word)', 'lower(r0.proposed)')} AS found FROM known_misspellings_review r0 WHERE r0.word IS NOT NULL AND r0.proposed IS NOT NULL) GROUP BY ALL",
    "training_rows": rf"""WITH a AS (SELECT sent_id, list_filter(regexp_extract_all(sentence, '[A-Za-zА-Яа-яЁё]+(?:[,.;''\[\]][A-Za-zА-Яа-яЁё]+)*'), lambda w: length(w) <= 35 AND {_SCRIPT('w')} <> 'other') AS ws FROM sentence_corpus WHERE sentence IS NOT NULL),
b AS (SELECT *, len(list_filter(ws, lambda w: {_SCRIPT('w')} = 'en')) * 2 AS e FROM a),
c AS (SELECT CASE WHEN e > len(ws) OR e = len(ws) AND {_SCRIPT('ws[1]')} = 'en' THEN 'en' ELSE 'ru' END AS lang, ws FROM b WHERE len(ws) > 0),
d AS (SELECT lang, list_filter(ws, lambda w: {_SCRIPT('w')} = lang) AS ws FROM c),
p AS (SELECT lang, ws, unnest(list_distinct([0, len(ws) // 3, 2 * len(ws) // 3, len(ws) - 1])) AS pos FROM d WHERE len(ws) >= 3),
w AS (SELECT lang, pos, ws[pos + 1] AS word, {_CONV('ws[pos + 1]')} AS conv FROM p WHERE length(ws[pos + 1]) <= 25),
r AS (SELECT word AS token, 0 AS label, 'right' AS kind, pos FROM w UNION ALL SELECT conv, 1, 'wrong', pos FROM w WHERE conv <> word AND {_SCRIPT('conv')} <> {_SCRIPT('word')}
  UNION ALL SELECT unnest([word || '42', word || '_id', word || '.com', 'https://' || word || '.org', word || CASE WHEN lang = 'en' THEN 'Ру' ELSE 'En' END]), 0, 'structured', pos FROM w
  WHERE pos = 0 AND ('0x' || substr(sha256(word), 3, 2) || substr(sha256(word), 1, 2))::BIGINT % 10 = 0)
SELECT kind, label, count(*) AS n, CAST(sum(length(token)) AS BIGINT) AS n_chars, CAST(sum(least(pos, 2)) AS BIGINT) AS n_context FROM r GROUP BY ALL""",
    "kwic_context": r"""WITH c AS (SELECT review_id, replace(replace(context, '[[', ''), ']]', '') AS t, instr(context, '[[') AS a, instr(context, ']]') AS b FROM dev_label_review WHERE context IS NOT NULL),
      d AS (SELECT *, b - a - 2 AS n, greatest(1, a - 40) AS lo, least(length(t) + 1, a + b - a - 2 + 40) AS hi FROM c WHERE a > 0 AND b > a)
      SELECT review_id, substr(t, a, n) AS judged, regexp_replace(CASE WHEN lo > 1 THEN '…' ELSE '' END || substr(t, lo, a - lo) || '[[' || substr(t, a, n) || ']]' || substr(t, a + n, hi - a - n) || CASE WHEN hi <= length(t) THEN '…' ELSE '' END, '\s+', ' ', 'g') AS snippet FROM d""",
}
