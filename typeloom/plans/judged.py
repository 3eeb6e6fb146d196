"""Queries of the current layout and spelling decisions, held out from what they are learnt from, and of the sequential policy over both.

Word lists, models and thresholds come from the sentences of the splits train and
calibration; words and sentences of all other splits are judged.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions import layout as Y
from typeloom.functions import text as T
from typeloom.operators import boundary as B
from typeloom.operators import correct as C
from typeloom.operators import decide as D
from typeloom.operators import gestures as G
from typeloom.operators import lexicon as L
from typeloom.operators import model as M
from typeloom.plans.corpus import _PAIR_KNOWN, LEX, _distinct_known, sentences
from typeloom.plans.decisions import _ADJ, _CONV, _DEL, _DEL2, _I, _LEGACY, _MIS, _MISSP, _SCRIPT, _SWAP, _B, _misspellings, _shape_sql, injected
from typeloom.functions.edits import NEXT_KEY
from typeloom.streaming.sessions import replay_stream
from typeloom.tables import load, shared_dir, ship, written

#: Negatives of the calibration split that may score above the threshold.
ALLOWED = 0.002


@dataclass
class Learnt:
    """What is taken from the train and calibration splits; each table is made once."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def lexicon(self) -> DataFrame:
        train = sentences(self.spark, self.sf_dir).where("split = 'train'")
        return written(L.ranked(L.tokens(train)), "lexicon")

    @property
    def listed(self) -> DataFrame:
        return self.lexicon.where("cnt >= 2")

    @cached_property
    def model(self) -> DataFrame:
        return written(L.trigram_model(self.listed, "^^", F.ln(1 + F.col("cnt"))), "trigrams")

    @cached_property
    def exceptions(self) -> DataFrame:
        """Words whose proposed change reviewers found wrong at least twice."""
        return G.learned_exceptions(load(self.spark, self.sf_dir, "dev_label_review").where("verdict = 'correct'"), "gold_word").select("token")

    @cached_property
    def threshold(self) -> float | None:
        """So that few words of the calibration split, typed right, score above it."""
        s = L.tokens(sentences(self.spark, self.sf_dir).where("split = 'calibration'"))
        words = s.where(L.pure(F.col("lang"), F.col("word"))).select(F.col("word").alias("token"))
        scores = D.trigram_logits(D.looked_up(words, self.listed, self.model)).select(F.lit(0).alias("label"), F.col("logit").alias("score"))
        return M.calibrated(written(scores, "scores"), ALLOWED).first()["threshold"]

    @cached_property
    def ranked(self) -> DataFrame:
        """Words seen three times, without ё, with what their letters add to a score."""
        r = self.lexicon.where("cnt >= 3").select("lang", F.col("key").alias("word"), F.col("word").alias("shown"), "rank")
        letters = F.when(F.col("lang") == "ru", 33).otherwise(26)
        language = L.language_scores(r, L.trigram_model(r, "^", 1 / F.sqrt("rank")), "^", 0.05, letters).select("lang", "word", F.col("score").alias("language"))
        logits = D.trigram_logits(D.looked_up(r.select(F.col("word").alias("token")), self.listed, self.model)).select(F.col("token").alias("word"), "logit")
        bonus = C.letter_bonus(F.col("language"), F.coalesce("logit", F.lit(0.0)), self.threshold or 0.0)
        return written(r.join(language, ["lang", "word"]).join(logits, "word", "left").withColumn("bonus", F.round(bonus, D.PLACES)).select("lang", "word", "shown", "rank", "bonus"), "ranked")

    @cached_property
    def known(self) -> DataFrame:
        """Words of the lexicon seen twice, and those of the corrected sides of the pairs."""
        return written(self.listed.select("lang", F.col("key").alias("word")).unionByName(_distinct_known(self.spark, self.sf_dir).select("lang", T.plain(F.col("word")).alias("word"))).distinct(), "known")

    def evidence(self, pairs: bool = True) -> C.Evidence:
        """What spellings are judged by; without ``pairs`` whatever the word before."""
        keep = load(self.spark, self.sf_dir, "known_misspellings_review").where("verdict = 'keep' and word is not null").select("word")
        seen = self.lexicon.where("lang = 'ru' and cnt >= 5 and len >= 5").select("lang", F.col("key").alias("word")).join(self.known, ["lang", "word"], "left_anti").select("word")
        spelled = _misspellings(self.spark, self.sf_dir).groupBy(T.plain(F.col("word")).alias("word")).agg(F.min("spelled").alias("spelled"))
        e = C.Evidence(self.ranked, self.known, spelled, seen, keep, self.exceptions)
        if not pairs:
            return e
        ru = self.lexicon.where("lang = 'ru'").select(F.col("key").alias("word"), "cnt", "rank")
        texts = L.word_arrays(sentences(self.spark, self.sf_dir).where("split = 'train'")).where("lang = 'ru'").select("lang", F.transform("ws", T.plain).alias("ws"))
        found = written(L.neighbours(texts).where("cnt >= 3").select("prev", "next", "cnt"), "pairs")
        total = ru.agg(F.sum("cnt")).first()[0] or 1
        return replace(e, pairs=found, contexts=ru.where("rank <= 16383").select("word", "cnt"), counts=ru.select("word", "cnt"), total=int(total))


# --- layout


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token, near, n``: every token of the texts as typed, and whether one of the two before it is in the script it would be converted to."""
    s = sentences(spark, sf_dir).select(F.transform(T.boundary_tokens(F.col("sentence")), B.token_of).alias("ts"))
    at = lambda i: F.when(i >= 0, F.get("ts", i))
    t = s.select(F.inline(F.transform("ts", lambda t, i: F.struct(t.alias("token"), at(i - 1).alias("p1"), at(i - 2).alias("p2"))))).where("token <> ''")
    t = t.groupBy("token", Y.script(F.col("p1")).alias("s1"), Y.script(F.col("p2")).alias("s2")).agg(F.count("*").alias("n"))
    to = Y.script(Y.convert(F.col("token")))
    return t.groupBy("token", ((to != "other") & ((F.col("s1") == to) | (F.col("s2") == to))).alias("near")).agg(F.sum("n").alias("n"))


def layout_decide(spark, sf_dir):  # noqa: ANN001, ANN201
    """The current layout decision for every token of the texts, with and without words of the other script before it."""
    k = Learnt(spark, sf_dir)
    seen = _contexts(spark, sf_dir)
    d = D.layout_decisions(seen, k.listed, k.model, k.threshold, k.exceptions)
    return d.join(seen, ["token", "near"]).select("token", "near", "should_convert", "reason", "logit", "n")


def layout_compare(spark, sf_dir):  # noqa: ANN001, ANN201
    """Both cascades on the words of the splits held out, typed right and in the wrong layout: how often each converts."""
    k = Learnt(spark, sf_dir)
    s = L.tokens(sentences(spark, sf_dir).where("split in ('dev', 'final')"))
    words = s.where(L.pure(F.col("lang"), F.col("word"))).groupBy("lang", "word").agg(F.count("*").alias("n"))
    each = words.select("lang", "n", F.inline(F.array(F.struct(F.col("word").alias("token"), F.lit(False).alias("wrong")), F.struct(Y.convert(F.col("word")).alias("token"), F.lit(True).alias("wrong")))))
    found = each.select("token").withColumn("near", F.lit(False)).distinct()
    now = D.layout_decisions(found, k.listed, k.model, k.threshold, k.exceptions).select("token", F.col("should_convert").alias("current"))
    before = D.legacy_decisions(found.select("token"), k.listed, k.model).select("token", F.col("should_convert").alias("legacy"))
    return each.join(now, "token").join(before, "token").groupBy("lang", "wrong", "current", "legacy").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_tokens"))


# --- spelling


def _held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The injected slips of the splits held out; the first word of a sentence has a capital."""
    capital = F.concat(F.upper(F.substring("typed", 1, 1)), F.substr("typed", F.lit(2)))
    return injected(spark, sf_dir).where("split in ('dev', 'final')").withColumn("at_start", F.col("pos") == 0).withColumn("word", F.when(F.col("at_start"), capital).otherwise(F.col("typed")))


def typo_decide(spark, sf_dir):  # noqa: ANN001, ANN201
    """The spelling decision for each slip with the word before it."""
    words = _held_out(spark, sf_dir).select("word", "previous", "at_start")
    return C.decisions(words, Learnt(spark, sf_dir).evidence()).select("word", "previous", "at_start", "corrected", "reason", F.round("margin", 5).alias("margin"))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the sentences held out, as they are."""
    s = L.word_arrays(sentences(spark, sf_dir).where("split in ('dev', 'final')")).select("lang", "sent_id", F.inline(F.transform("ws", lambda w, i: F.struct(w.alias("word"), F.when(i > 0, F.get("ws", i - 1)).alias("previous")))))
    return s.where(L.pure(F.col("lang"), F.col("word")) & (F.length("word") >= 4))


def typo_eval(spark, sf_dir):  # noqa: ANN001, ANN201
    """Slips put right, turned into something else or left, and right words changed, per language."""
    e = Learnt(spark, sf_dir).evidence()
    inj = written(_held_out(spark, sf_dir).select("lang", "word", T.context_normal(F.col("previous")).alias("previous"), "at_start", "intended"), "slips")
    clean = written(_clean(spark, sf_dir).select("lang", "word", T.context_normal(F.col("previous")).alias("previous")), "clean")
    both = inj.select("word", "previous", "at_start").unionByName(clean.select("word", "previous", F.lit(False).alias("at_start")))
    d = written(C.decisions(both, e).select("word", F.coalesce("previous", F.lit("")).alias("p"), "at_start", "corrected"), "verdicts")
    c = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    same = T.plain(F.lower("corrected")) == T.plain(F.col("intended"))
    a = inj.withColumn("p", F.coalesce("previous", F.lit(""))).join(d, ["word", "p", "at_start"]).groupBy("lang").agg(F.count("*").alias("n_typos"), c(same).alias("fixed"), c(~same).alias("wrong"))
    b = clean.withColumns({"p": F.coalesce("previous", F.lit("")), "at_start": F.lit(False)}).join(d, ["word", "p", "at_start"]).groupBy("lang").agg(F.count("*").alias("n_clean"), F.count("corrected").alias("false"))
    g = a.join(b, "lang")
    r = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    return g.withColumns({"recall": r(F.col("fixed"), F.col("n_typos")), "precision": r(F.col("fixed"), F.col("fixed") + F.col("wrong")), "false_share": r(F.col("false"), F.col("n_clean"))})


# --- both, in order


def _judged(spark: SparkSession, sf_dir: str, tokens: DataFrame) -> DataFrame:
    """Verdicts of tokens, with spellings of the words in them; only words with a capital are judged as the first of a sentence."""
    k = Learnt(spark, sf_dir)
    facts = written(B.form_facts(tokens, k.listed, k.model, k.threshold, k.exceptions), "facts")
    words = B.spelling_words(tokens, facts).select("word", F.lit(None).cast("string").alias("previous"), T.is_capitalized(F.col("word")).alias("at_start"))
    fixes = C.decisions(words, k.evidence(pairs=False)).where("corrected is not null")
    fixes = fixes.select("word", F.when(~F.col("at_start"), F.col("corrected")).alias("corrected"), F.when(F.col("at_start"), F.col("corrected")).alias("at_start"))
    return B.verdicts(tokens, facts, written(fixes, "fixes"))


def _walkable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = B.chunked(sentences(spark, sf_dir).select("sent_id", "sentence"), "sent_id", "sentence")
    tokens = written(B.chunk_tokens(chunks), "chunk-tokens")
    return chunks, tokens, written(_judged(spark, sf_dir, tokens.select("token").distinct()), "judged")


def _by_reason(results: DataFrame) -> DataFrame:
    return results.groupBy("reason", "changed").agg(F.count("*").alias("n"), F.sum((F.col("erased") > 0).cast("int")).alias("n_repaired"))


def boundary_replay(spark, sf_dir):  # noqa: ANN001, ANN201
    """Every sentence typed anew under the sequential policy: its boundaries and what was put right."""
    return _by_reason(B.replay(*_walkable(spark, sf_dir)))


def boundary_text(spark, sf_dir):  # noqa: ANN001, ANN201
    """The sentences that come out changed, as they then stand."""
    return B.retyped(*_walkable(spark, sf_dir)).where("n_changed > 0").select(F.col("session").alias("sent_id"), "text", "n_changed")


def boundary_stream(spark, sf_dir):  # noqa: ANN001, ANN201
    """The same boundaries as a stream, with a state for each group of sessions; the result equals that of the batch."""
    ship(spark)
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    pieces = sentences(spark, sf_dir).where("sentence is not null").select(F.col("sent_id").alias("session"), F.posexplode(T.boundary_tokens(F.col("sentence"))).alias("seq", "piece"))
    token = B.token_of(F.col("piece"))
    separator = F.when(F.length("piece") > F.length(token), F.right("piece", F.lit(1))).otherwise(" ")
    rows = pieces.select("session", "seq", token.alias("token"), separator.alias("separator"))
    rows.write.parquet(f"{base}/in")
    typed = spark.read.schema(rows.schema).parquet(f"{base}/in")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), typed.count() // 20_000)  # some 20,000 tokens each
    judged = written(_judged(spark, sf_dir, typed.where("token <> ''").select("token").distinct()), "judged")
    out = replay_stream(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), judged, groups=groups)
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return _by_reason(spark.read.schema(out.schema).parquet(f"{base}/out"))


QUERIES = {f.__name__: f for f in (layout_decide, layout_compare, typo_decide, typo_eval, boundary_replay, boundary_text, boundary_stream)}

# --- SQL

_TC = T.TOKEN_CLASS.replace("'", "''")
_PURE = lambda lang, word: f"({lang} = 'en' AND regexp_full_match({word}, '[a-z]{{2,32}}') OR {lang} = 'ru' AND regexp_full_match({word}, '[а-яё]{{2,32}}'))"
_FREQUENT = ", ".join(f"'{w}'" for w in Y.FREQUENT)
_WORDS = r"(SELECT sent_id, split, CASE WHEN starts_with(source, 'rus_') THEN 'ru' WHEN starts_with(source, 'eng_') THEN 'en' END AS lang, regexp_extract_all(lower(sentence), '\p{L}+') AS ws FROM sentence_corpus WHERE sentence IS NOT NULL)"


def _grams(p: str, weight: str, of: str) -> str:
    return f"(SELECT lang, gram, sum(w) AS weight FROM (SELECT lang, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS gram, {weight} AS w FROM (SELECT *, '{p}' || word || '$' AS p FROM {of})) GROUP BY ALL)"


def _found(of: str) -> str:
    """Both readings of the tokens of a table: known or not, excepted or not, and the log odds of their trigrams."""
    return f"""(SELECT r.token, coalesce(bool_or(kn.word IS NOT NULL) FILTER (side = 'f'), false) AS fk, coalesce(bool_or(kn.word IS NOT NULL) FILTER (side = 't'), false) AS tk, bool_or(exc.token IS NOT NULL) AS ex,
      round(max(sc.score) FILTER (side = 't') - max(sc.score) FILTER (side = 'f'), 6) AS logit FROM {of} r
      LEFT JOIN (SELECT lang, word, avg(ln((coalesce(weight, 0) + 0.1) / (total + 0.1 * kinds))) AS score FROM (SELECT lang, word, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS gram FROM (SELECT DISTINCT lang, word, '^^' || word || '$' AS p FROM {of}))
        LEFT JOIN m USING (lang, gram) JOIN tt USING (lang) GROUP BY lang, word) sc ON sc.lang = r.lang AND sc.word = r.word
      LEFT JOIN (SELECT DISTINCT lang, word FROM kn) kn ON kn.lang = r.lang AND kn.word = r.word LEFT JOIN exc ON exc.token = r.word GROUP BY r.token)"""


def _readings(of: str) -> str:
    latin = "regexp_matches(token, '[A-Za-z]')"
    return f"(SELECT token, 'f' AS side, CASE WHEN {latin} THEN 'en' ELSE 'ru' END AS lang, lower(token) AS word FROM {of} UNION ALL SELECT token, 't', CASE WHEN {latin} THEN 'ru' ELSE 'en' END, lower({_CONV('token')}) FROM {of})"


_LEARNT = rf"""WITH {LEX.replace("WHERE sentence IS NOT NULL)", "WHERE sentence IS NOT NULL AND split = 'train')")},
kn AS MATERIALIZED (SELECT * FROM lex WHERE cnt >= 2),
m AS MATERIALIZED {_grams("^^", "ln(1 + cnt)", "kn")},
tt AS (SELECT lang, sum(weight) AS total, count(*) AS kinds FROM m GROUP BY lang),
exc AS (SELECT lower(gold_word) AS token FROM dev_label_review WHERE verdict = 'correct' AND gold_word IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
ca AS (SELECT DISTINCT word AS token FROM (SELECT lang, unnest(ws) AS word FROM {_WORDS} WHERE split = 'calibration') WHERE {_PURE("lang", "word")}),
cr AS MATERIALIZED {_readings("ca")}, cf AS {_found("cr")},
thr AS (SELECT max(logit) AS t FROM (SELECT logit, row_number() OVER (ORDER BY logit DESC) AS k, count(*) OVER () AS n FROM cf WHERE logit IS NOT NULL) WHERE k > floor(n * {ALLOWED}))"""


def _reason(near: str) -> str:
    return f"""CASE WHEN length(token) < 1 OR length(token) > 64 THEN 'length' WHEN ex THEN 'exception' WHEN {_shape_sql("token")} IS NOT NULL THEN {_shape_sql("token")}
  WHEN length(token) <= 3 AND {near} AND tk AND lower(token) NOT IN ({_FREQUENT}) THEN 'context-short-word' WHEN length(token) = 1 THEN 'length' WHEN lower(token) IN ({_FREQUENT}) OR fk THEN 'known-original'
  WHEN coalesce(logit > (SELECT t FROM thr), false) THEN 'trained-model' ELSE 'model-below-threshold' END"""


_LAYOUT = (
    _LEARNT
    + rf""", pc AS (SELECT sent_id, unnest(range(len(ps))) AS pos, regexp_replace(unnest(ps), '[^{_TC}]$', '') AS token FROM (SELECT sent_id, regexp_extract_all(sentence, '[{_TC}]*[^{_TC}]|[{_TC}]+$') AS ps FROM sentence_corpus WHERE sentence IS NOT NULL)),
pp AS (SELECT token, lag(token, 1) OVER w AS p1, lag(token, 2) OVER w AS p2 FROM pc WINDOW w AS (PARTITION BY sent_id ORDER BY pos)),
sp AS (SELECT token, {_SCRIPT(_CONV("token"))} AS dest, {_SCRIPT("coalesce(p1, '')")} AS s1, {_SCRIPT("coalesce(p2, '')")} AS s2 FROM pp WHERE token <> ''),
cx AS MATERIALIZED (SELECT token, dest <> 'other' AND (s1 = dest OR s2 = dest) AS near, count(*) AS n FROM sp GROUP BY ALL),
dt AS (SELECT DISTINCT token FROM cx), rd AS MATERIALIZED {_readings("dt")}, fd AS {_found("rd")},
dc AS (SELECT token, near, {_reason("near")} AS reason, logit, n FROM cx JOIN fd USING (token))
SELECT token, near, reason IN ('context-short-word', 'trained-model') AS should_convert, reason, logit, n FROM dc"""
)
_K = "".join(NEXT_KEY), "".join(NEXT_KEY.values())
_ENDED = lambda a, b: f"CASE WHEN ends_with(typed, '{a}') THEN substr(typed, 1, length(typed) - {len(a)}) || '{b}' END"
_NEAR = lambda: f"CASE WHEN {_SWAP('typed', 'word', 'i')} THEN 1 ELSE levenshtein({_B('typed')}, {_B('word')}) END"
_COST = f"""CAST(CASE WHEN dist = 2 THEN 3.2 WHEN {_SWAP('typed', 'word', 'i')} THEN 0.55 + ini
  WHEN abs(length(typed) - length(word)) = 1 AND lang = 'ru' AND substr(CASE WHEN length(typed) > length(word) THEN typed ELSE word END, i, 1) IN ('ь', 'ъ') THEN CASE WHEN length(word) > length(typed) AND i > 1 AND substr(word, i - 1, 1) = 'ш' AND substr(word, i + 1) IN ('', 'ся') THEN 0 ELSE 0.3 END
  WHEN abs(length(typed) - length(word)) = 1 THEN 0.75 + ini WHEN substr(typed, i + 1) = substr(word, i + 1) AND substr(typed, i, 1) || substr(word, i, 1) IN ({_ADJ}) THEN 0.65 + ini ELSE 1.0 + ini END AS DOUBLE)"""
_CANDS = lambda words, typed, more: f"""(SELECT *, -ln(rank + 15) - 1.5 * {_COST} + bonus AS score FROM (SELECT *, {_NEAR()} AS dist, CASE WHEN lang = 'ru' AND i = 1 THEN 0.5 ELSE 0 END AS ini FROM (SELECT *, {_MIS('typed', 'word')} AS i FROM (SELECT DISTINCT lang, typed, word, rank, bonus{more} FROM
  (SELECT lang, typed, unnest(CASE WHEN length(typed) >= 8 AND lang = 'en' THEN {_DEL2('typed')} ELSE {_DEL('typed')} END) AS k FROM {typed}) JOIN (SELECT *, unnest(CASE WHEN rank <= 15000 AND lang = 'en' THEN {_DEL2('word')} ELSE {_DEL('word')} END) AS k FROM {words}) USING (lang, k))))
  WHERE dist = 1 OR dist = 2 AND lang = 'en' AND length(typed) >= 8 AND rank <= 10000)"""  # noqa: E731
_SPELLING = (
    _LEARNT
    + rf"""{_PAIR_KNOWN}, {_MISSP.replace("mis AS (", "mi AS (")},
mis AS (SELECT translate(typed, 'ё', 'е') AS word, min(spelled) AS spelled FROM mi GROUP BY 1),
kw AS MATERIALIZED (SELECT lang, key AS word FROM kn UNION SELECT lang, translate(word, 'ё', 'е') FROM pk),
r0 AS (SELECT lang, key AS word, word AS shown, rank FROM lex WHERE cnt >= 3), m1 AS MATERIALIZED {_grams("^", "1 / sqrt(rank)", "r0")}, t1 AS (SELECT lang, sum(weight) AS total FROM m1 GROUP BY lang),
ls AS (SELECT lang, word, avg(ln((weight + 0.05) / (total + 0.05 * CASE WHEN lang = 'ru' THEN 33 * 33 * 33 ELSE 26 * 26 * 26 END))) AS language FROM (SELECT lang, word, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS gram FROM (SELECT *, '^' || word || '$' AS p FROM r0)) JOIN m1 USING (lang, gram) JOIN t1 USING (lang) GROUP BY lang, word),
rt AS (SELECT DISTINCT word AS token FROM r0), rr AS MATERIALIZED {_readings("rt")}, rf AS {_found("rr")},
rk AS MATERIALIZED (SELECT r0.*, round(0.65 * language + 0.3 * ln(greatest(1e-6, 1 / (1 + exp(-greatest(-30, least(30, coalesce((SELECT t FROM thr), 0) - coalesce(logit, 0))))))), 6) AS bonus FROM r0 JOIN ls USING (lang, word) LEFT JOIN rf ON rf.token = r0.word),
s0 AS (SELECT sent_id, lang, ws, list_filter(range(1, len(ws) + 1), lambda i: length(ws[i]) >= 4 AND CASE WHEN lang = 'en' THEN regexp_full_match(ws[i], '[a-z]{{2,32}}') WHEN lang = 'ru' THEN regexp_full_match(ws[i], '[а-яё]{{2,32}}') ELSE false END)[1] AS p FROM {_WORDS} WHERE split IN ('dev', 'final')),
s1 AS (SELECT sent_id, lang, ws[p] AS w, CASE WHEN p > 1 THEN translate(ws[p - 1], 'ё', 'е') END AS previous, p = 1 AS at_start FROM s0 WHERE p IS NOT NULL),
s2 AS (SELECT *, CASE WHEN sent_id % 3 = 0 OR sent_id % 3 = 1 AND substr(w, {_I}, 1) = substr(w, {_I} + 1, 1) THEN substr(w, 1, {_I} - 1) || substr(w, {_I} + 1)
  WHEN sent_id % 3 = 1 THEN substr(w, 1, {_I} - 1) || substr(w, {_I} + 1, 1) || substr(w, {_I}, 1) || substr(w, {_I} + 2) ELSE substr(w, 1, {_I} - 1) || translate(substr(w, {_I}, 1), '{_K[0]}', '{_K[1]}') || substr(w, {_I} + 1) END AS slip FROM s1),
w0 AS (SELECT DISTINCT CASE WHEN at_start THEN upper(substr(slip, 1, 1)) || substr(slip, 2) ELSE slip END AS word, previous, at_start FROM s2 WHERE slip <> w),
w1 AS (SELECT *, at_start AND regexp_full_match(word, '[А-Яа-яЁё]+') AND regexp_full_match(word, '\p{{Lu}}[^\p{{Lu}}]+') AS capital FROM w0),
w2 AS (SELECT *, translate(CASE WHEN capital THEN lower(substr(word, 1, 1)) || substr(word, 2) ELSE word END, 'ё', 'е') AS typed FROM w1),
w3 AS (SELECT *, CASE WHEN regexp_full_match(typed, '[а-я]+') THEN 'ru' WHEN regexp_full_match(typed, '[a-z]+') THEN 'en' END AS lang FROM w2),
sn AS (SELECT key AS word FROM lex WHERE lang = 'ru' AND cnt >= 5 AND len >= 5 AND key NOT IN (SELECT word FROM kw WHERE lang = 'ru')),
co AS (SELECT DISTINCT translate(lower(word), 'ё', 'е') AS word FROM known_misspellings_review WHERE verdict = 'keep' AND word IS NOT NULL),
w4 AS MATERIALIZED (SELECT w3.*, spelled, CASE WHEN NOT regexp_full_match(typed, '\p{{L}}{{4,32}}') THEN 'protected-shape' WHEN regexp_matches(typed, '\p{{Lu}}') THEN 'protected-case' WHEN w3.lang IS NOT NULL AND typed IN (SELECT translate(token, 'ё', 'е') FROM exc) THEN 'exception' WHEN w3.lang IS NULL THEN 'protected-script'
  WHEN w3.lang = 'ru' AND length(typed) < 5 THEN 'protected-shape' WHEN spelled IS NOT NULL THEN 'typo-known-misspelling' WHEN kw.word IS NOT NULL THEN 'known-original' WHEN w3.lang = 'ru' AND typed IN (SELECT word FROM sn) THEN 'known-corpus' WHEN w3.lang = 'ru' AND typed IN (SELECT word FROM co) THEN 'colloquial' END AS early
  FROM w3 LEFT JOIN mis ON w3.lang = 'ru' AND mis.word = typed LEFT JOIN kw ON kw.lang = w3.lang AND kw.word = typed),
ru AS (SELECT key AS word, cnt, rank FROM lex WHERE lang = 'ru'), tot AS (SELECT sum(cnt) AS n FROM ru), cxw AS (SELECT word, cnt FROM ru WHERE rank <= 16383),
nb AS (SELECT prev, next, count(*) AS cnt FROM (SELECT translate(word, 'ё', 'е') AS prev, translate(lead(word) OVER (PARTITION BY sent_id ORDER BY pos), 'ё', 'е') AS next FROM tok WHERE lang = 'ru') WHERE next IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
rw0 AS (SELECT typed, previous, coalesce({_ENDED("ться", "тся")}, {_ENDED("тся", "ться")}) AS other FROM (SELECT DISTINCT typed, previous FROM w4 WHERE lang = 'ru' AND early = 'known-original' AND previous IS NOT NULL AND length(typed) >= 5)),
rw AS (SELECT typed, rw0.previous, other AS fixed, ln((coalesce(a.cnt, 0) + 0.5) / (coalesce(b.cnt, 0) + 0.5)) AS fm FROM rw0 JOIN rk ON rk.lang = 'ru' AND rk.word = other AND rk.rank <= 50000 JOIN cxw ON cxw.word = rw0.previous LEFT JOIN nb a ON a.prev = rw0.previous AND a.next = other LEFT JOIN nb b ON b.prev = rw0.previous AND b.next = typed WHERE other NOT IN (SELECT word FROM mis) AND coalesce(a.cnt, 0) >= 20),
op AS (SELECT DISTINCT lang, typed, previous FROM w4 WHERE early IS NULL), ot AS (SELECT DISTINCT lang, typed FROM op),
cd AS (SELECT * FROM {_CANDS("rk", "ot", ", shown")} WHERE lang <> 'ru' OR word NOT IN (SELECT word FROM mis)),
sd AS (SELECT op.lang, op.typed, op.previous, cd.word, shown, cd.rank, CASE WHEN op.lang = 'ru' AND cxw.word IS NOT NULL AND ru.word IS NOT NULL THEN ln((coalesce(nb.cnt, 0) + 2.0) / (cxw.cnt * ru.cnt / (SELECT n FROM tot) + 2.0)) ELSE 0.0 END AS lift, score AS base
  FROM op JOIN cd ON cd.lang = op.lang AND cd.typed = op.typed LEFT JOIN cxw ON cxw.word = op.previous LEFT JOIN ru ON ru.word = cd.word LEFT JOIN nb ON nb.prev = op.previous AND nb.next = cd.word),
bs AS (SELECT *, base + 0.5 * lift AS score, row_number() OVER w AS place, lead(base + 0.5 * lift) OVER w AS second FROM sd WINDOW w AS (PARTITION BY lang, typed, previous ORDER BY base + 0.5 * lift DESC, rank, word)),
fo AS (SELECT k.lang, k.word, r.rank, 0.0 AS bonus FROM kw k JOIN (SELECT lang, max(rank) + 1 AS rank FROM rk GROUP BY lang) r USING (lang) WHERE k.lang = 'ru' AND k.word NOT IN (SELECT word FROM rk WHERE lang = 'ru') AND k.word NOT IN (SELECT word FROM mis)),
bt AS (SELECT DISTINCT lang, typed FROM bs WHERE lang = 'ru'), rv AS (SELECT lang, typed, max(score) AS rival FROM {_CANDS("fo", "bt", "")} GROUP BY ALL),
jn AS (SELECT w4.*, fixed, fm, shown, rank, score, CASE WHEN second IS NULL THEN 4.0 ELSE score - second END AS lead0, lift, rival FROM w4 LEFT JOIN rw ON rw.typed = w4.typed AND rw.previous = w4.previous AND w4.lang = 'ru' AND fm >= 3.0
  LEFT JOIN (SELECT * FROM bs WHERE place = 1) b ON b.lang = w4.lang AND b.typed = w4.typed AND b.previous IS NOT DISTINCT FROM w4.previous LEFT JOIN rv ON rv.lang = w4.lang AND rv.typed = w4.typed),
ld AS (SELECT *, CASE WHEN lang = 'ru' AND rival IS NOT NULL THEN least(lead0, score - rival) ELSE lead0 END AS ld FROM jn),
rs AS (SELECT *, CASE WHEN fixed IS NOT NULL THEN 'typo-context-tsya' WHEN early IS NOT NULL THEN early WHEN shown IS NULL THEN 'no-candidate' WHEN lead0 < 2.2 OR rank > CASE WHEN lang = 'ru' THEN 50000 ELSE 12000 END THEN 'ambiguous-candidate'
  WHEN lang = 'ru' AND rival IS NOT NULL AND score - rival < 2.2 THEN 'ambiguous-form' WHEN lang = 'ru' AND ld < 4.0 THEN 'ambiguous-candidate' ELSE 'typo' END AS reason FROM ld),
fx AS (SELECT *, CASE reason WHEN 'typo-context-tsya' THEN fixed WHEN 'typo-known-misspelling' THEN spelled WHEN 'typo' THEN shown END AS rgt, CASE reason WHEN 'typo-context-tsya' THEN fm WHEN 'typo-known-misspelling' THEN 5.0 WHEN 'typo' THEN ld END AS sure FROM rs),
fin AS (SELECT *, capital AND rgt IS NOT NULL AND sure < 4.0 AS weak FROM fx)
SELECT word, previous, at_start, CASE WHEN weak THEN NULL WHEN capital THEN upper(substr(rgt, 1, 1)) || substr(rgt, 2) ELSE rgt END AS corrected, CASE WHEN weak THEN 'ambiguous-capital' ELSE reason END AS reason, CASE WHEN NOT weak THEN round(sure, 5) END AS margin FROM fin"""
)
_COMPARE = (
    _LEARNT
    + rf""", hw AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(ws) AS word FROM {_WORDS} WHERE split IN ('dev', 'final')) WHERE {_PURE("lang", "word")} GROUP BY ALL),
ea AS (SELECT lang, n, word AS token, false AS wrong FROM hw UNION ALL SELECT lang, n, {_CONV("word")}, true FROM hw), ty AS (SELECT DISTINCT token, false AS wrong FROM ea),
{_LEGACY[_LEGACY.index("w0 AS") :]}, dt AS (SELECT token FROM ty), rd AS MATERIALIZED {_readings("dt")}, fd AS {_found("rd")}, cu AS (SELECT token, {_reason("false")} = 'trained-model' AS now FROM fd)
SELECT ea.lang, ea.wrong, now AS current, should_convert AS legacy, count(*) AS n_words, CAST(sum(ea.n) AS BIGINT) AS n_tokens FROM ea JOIN r ON r.token = ea.token JOIN cu ON cu.token = ea.token GROUP BY ALL"""
)
_EVAL = _SPELLING.replace(
    "FROM s2 WHERE slip <> w),",
    "FROM s2 WHERE slip <> w UNION SELECT word, previous, false FROM cl),",
).replace(
    "w0 AS (SELECT DISTINCT CASE",
    f"cl AS MATERIALIZED (SELECT lang, word, previous FROM (SELECT lang, unnest(ws) AS word, unnest(list_prepend(NULL, list_transform(ws[1:len(ws) - 1], lambda x: translate(x, 'ё', 'е')))) AS previous FROM {_WORDS} WHERE split IN ('dev', 'final') AND len(ws) > 0) WHERE {_PURE('lang', 'word')} AND length(word) >= 4),\nw0 AS (SELECT DISTINCT CASE",
)
_EVAL = (
    _EVAL.replace("SELECT word, previous, at_start, CASE WHEN weak", ", dd AS (SELECT word, previous, at_start, CASE WHEN weak")
    + """),
sl AS (SELECT lang, CASE WHEN at_start THEN upper(substr(slip, 1, 1)) || substr(slip, 2) ELSE slip END AS word, previous, at_start, translate(w, 'ё', 'е') AS intended FROM s2 WHERE slip <> w),
ta AS (SELECT sl.lang, count(*) AS n_typos, CAST(sum(CASE WHEN translate(lower(corrected), 'ё', 'е') = intended THEN 1 ELSE 0 END) AS BIGINT) AS fixed, CAST(sum(CASE WHEN translate(lower(corrected), 'ё', 'е') <> intended THEN 1 ELSE 0 END) AS BIGINT) AS wrong
  FROM sl JOIN dd ON dd.word = sl.word AND dd.previous IS NOT DISTINCT FROM sl.previous AND dd.at_start = sl.at_start GROUP BY sl.lang),
tb AS (SELECT cl.lang, count(*) AS n_clean, count(corrected) AS "false" FROM cl JOIN dd ON dd.word = cl.word AND dd.previous IS NOT DISTINCT FROM cl.previous AND NOT dd.at_start GROUP BY cl.lang)
SELECT *, round(coalesce(fixed / nullif(n_typos, 0), 0), 6) AS recall, round(coalesce(fixed / nullif(fixed + wrong, 0), 0), 6) AS "precision", round(coalesce("false" / nullif(n_clean, 0), 0), 6) AS false_share FROM ta JOIN tb USING (lang)"""
)
ORACLE = {"layout_decide": _LAYOUT, "layout_compare": _COMPARE, "typo_decide": _SPELLING, "typo_eval": _EVAL}
