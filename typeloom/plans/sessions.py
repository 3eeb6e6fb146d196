"""Queries of sequential policies, events, aligned corrections and the layout model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.functions import edits as E
from typeloom.functions import text as T
from typeloom.functions.hashing import split_bucket
from typeloom.operators import gestures as G
from typeloom.operators import model as M
from typeloom.plans.corpus import TOK, lex, sentences, tok, word_arrays
from typeloom.plans.parsing import _PARSED
from typeloom.sources.damaged_lines import loaded
from typeloom.tables import load, written


def offered_load(spark, sf_dir):  # noqa: ANN001, ANN201
    e = load(spark, sf_dir, "events")
    return G.offered_load(e).groupBy("user_id").agg(F.max("n_before").alias("most"), F.sum((F.col("n_before") > 17).cast("int")).alias("n_over"))


def double_taps(spark, sf_dir):  # noqa: ANN001, ANN201
    return G.double_taps(load(spark, sf_dir, "events"), gap=3600.0).select("event_id", "user_id", "event_type")


def rate_limited(spark, sf_dir):  # noqa: ANN001, ANN201
    e = load(spark, sf_dir, "events").withColumn("size", F.length("props"))
    return G.accepted(e).groupBy("accepted").agg(F.count("*").alias("n"))


def learned_exceptions(spark, sf_dir):  # noqa: ANN001, ANN201
    """Words whose proposed change reviewers found wrong at least twice."""
    return G.learned_exceptions(load(spark, sf_dir, "dev_label_review").where("verdict = 'correct'"), "gold_word")


def event_fields(spark, sf_dir):  # noqa: ANN001, ANN201
    """Fields of the events' JSON, taken by a fixed schema."""
    e = load(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select(F.explode("m").alias("field", "value")).groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def misspelling_map(spark, sf_dir):  # noqa: ANN001, ANN201
    """The mapping of the lines ``wrong → right``; a word's last line counts, in the order of files and lines."""
    p = loaded(load(spark, sf_dir, "raw_words")).where("layout = 'pairs'")
    last = F.max_by(F.lower("spelled"), F.struct(F.coalesce("file_name", F.lit("")), F.coalesce("line_no", F.lit(0)), "raw_id"))
    return p.groupBy(T.plain(F.lower("word")).alias("word")).agg(last.alias("spelled"), F.count("*").alias("n"))


def ranked_list(spark, sf_dir):  # noqa: ANN001, ANN201
    """Words of the lists in the order of their lines: letters only, the first of each form, numbered by file."""
    w = loaded(load(spark, sf_dir, "raw_words")).where("layout = 'words'").select("file_name", "line_no", "raw_id", F.lower("word").alias("word")).where(F.col("word").rlike(r"^\p{L}{2,32}$"))
    w = w.withColumn("key", T.plain(F.col("word")))
    first = w.groupBy("file_name", "key").agg(F.min(F.struct("line_no", "raw_id", "word")).alias("x")).select("file_name", "key", "x.*")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("file_name").orderBy("line_no", "raw_id"))).select("file_name", "word", "key", "rank")


def pair_eval(spark, sf_dir):  # noqa: ANN001, ANN201
    """Typed and corrected sentences aligned word by word, and the words that differ by their distance."""
    p = load(spark, sf_dir, "correction_pairs").dropDuplicates(["pair_id"]).where("source is not null and correction is not null")
    a = p.select("set_name", F.explode(E.aligned_words(T.letter_runs(F.col("source")), T.letter_runs(F.col("correction")))).alias("x")).select("set_name", "x.*")
    kind = F.when(F.col("intended").isNull(), "unaligned").when(F.col("typed") == F.col("intended"), "same").when(T.plain(F.col("typed")) == T.plain(F.col("intended")), "ignored").otherwise("typo")
    a = a.withColumn("outcome", kind)
    d = a.where("outcome = 'typo'").select("typed", "intended").distinct().withColumn("distance", F.least(E.osa_distance("typed", "intended"), F.lit(3)))
    return a.join(d, ["typed", "intended"], "left").groupBy("set_name", "outcome", "distance").agg(F.count("*").alias("n"))


def positional_eval(spark, sf_dir):  # noqa: ANN001, ANN201
    """The i-th typed word against the i-th corrected one; sentences of unequal length are counted as misaligned."""
    p = load(spark, sf_dir, "correction_pairs").where("source is not null and correction is not null").groupBy("pair_id").agg(F.min("set_name").alias("set_name"), F.min("source").alias("a"), F.min("correction").alias("b"))
    p = p.withColumns({"x": T.white_space_tokens(F.col("a")), "y": T.white_space_tokens(F.col("b"))})
    same = F.size(F.filter(F.zip_with("x", "y", lambda s, t: F.coalesce(s, F.lit("")) == F.coalesce(t, F.lit(""))), lambda v: v))
    return p.groupBy("set_name").agg(F.sum(F.greatest(F.size("x"), F.size("y"))).alias("n_words"), F.sum(same).alias("n_same"), F.sum((F.size("x") != F.size("y")).cast("int")).alias("n_misaligned"))


def script_changes(spark, sf_dir):  # noqa: ANN001, ANN201
    """Short words whose successor is of the other script: those a look-ahead would repair."""
    n = F.size("ws")
    each = F.arrays_zip(F.slice("ws", 1, n - 1).alias("word"), F.slice("ws", 2, n - 1).alias("next"))
    t = word_arrays(spark, sf_dir).where(n > 1).select(F.inline(each))
    latin, cyr = (lambda c: F.col(c).rlike("^[a-z]+$")), (lambda c: F.col(c).rlike("^[а-яё]+$"))
    return t.where((F.length("word") <= 3) & ((latin("word") & cyr("next")) | (cyr("word") & latin("next")))).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("next").alias("n_next"))


def training_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    """The training rows by kind, with their characters and the words before them."""
    return M.training_rows(sentences(spark, sf_dir)).groupBy("kind", "label").agg(F.count("*").alias("n"), F.sum(F.length("token")).alias("n_chars"), F.sum(F.size("previous")).alias("n_context"))


def training_positions(spark, sf_dir):  # noqa: ANN001, ANN201
    """The first, last and two inner words of each sentence, as the model is trained on."""
    n = F.size("ws")
    s = sentences(spark, sf_dir).select("sent_id", T.letter_runs(F.col("sentence")).alias("ws")).where(n > 0)
    at = F.array_distinct(F.array(F.lit(0), F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int"), n - 1))
    return s.select(F.explode(at).alias("pos"), "ws").select(F.get("ws", F.col("pos")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def layout_model(spark, sf_dir):  # noqa: ANN001, ANN201
    """A hashed logistic regression trained, calibrated and measured on disjoint tokens, protected shapes among them; without words of both kinds nothing is measured."""
    rows = M.training_rows(sentences(spark, sf_dir)).select("token", "previous", "label").distinct().withColumn("bucket", split_bucket(F.col("token")) % 10)
    f = M.vectors(written(rows, "rows"))  # rows and scores are read several times
    if f.where("bucket < 6").select("label").distinct().count() < 2:  # nothing to tell apart
        return M.measured(f.select("label", F.lit(0.0).alias("score")).limit(0), 0.0)
    fit = M.fitted(f.where("bucket < 6").select("label", "features"))
    from pyspark.ml.functions import vector_to_array

    scores = written(fit.transform(f.where("bucket >= 6")).select("label", "bucket", vector_to_array("rawPrediction")[1].alias("score")), "scores")
    threshold = M.calibrated(scores.where("bucket < 8")).first()["threshold"]
    return M.measured(scores.where("bucket >= 8"), 0.0 if threshold is None else threshold)


def _lead_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "dev_label_review").where("lead_score is not null and verdict is not null").select(F.col("lead_score").alias("score"), (F.col("verdict") != "correct").cast("int").alias("label"))


def calibrate_threshold(spark, sf_dir):  # noqa: ANN001, ANN201
    return M.calibrated(_lead_scores(spark, sf_dir), 0.05).select(F.round("threshold", 6).alias("threshold"))


def confusion_matrix(spark, sf_dir):  # noqa: ANN001, ANN201
    return M.measured(_lead_scores(spark, sf_dir), 4.0)


def majority_language(spark, sf_dir):  # noqa: ANN001, ANN201
    """The language most words of each sentence are written in; of equals the one in front of the alphabet."""
    t = tok(spark, sf_dir).withColumn("own", F.when(F.col("word").rlike("[a-z]"), "en").when(F.col("word").rlike("[а-яё]"), "ru").otherwise("other"))
    n = t.groupBy("sent_id", "lang", "own").agg(F.count("*").alias("n"))
    best = n.groupBy("sent_id", "lang").agg(F.min(F.struct(-F.col("n"), "own")).alias("x")).select("lang", F.col("x.own").alias("majority"))
    return best.groupBy("lang", "majority").agg(F.count("*").alias("n_sentences"))


QUERIES = {
    f.__name__: f
    for f in (offered_load, double_taps, rate_limited, learned_exceptions, event_fields, misspelling_map, ranked_list, pair_eval, positional_eval, script_changes, training_rows, training_positions, layout_model, calibrate_threshold, confusion_matrix, majority_language)
}
_LEADS = "s AS (SELECT lead_score AS score, (verdict <> 'correct')::INT AS label FROM dev_label_review WHERE lead_score IS NOT NULL AND verdict IS NOT NULL)"
_WS = r"list_filter(regexp_split_to_array(trim({0}, ' '), '\s+'), lambda x: x <> '')"
ORACLE = {
    "offered_load": "SELECT user_id, max(n) AS most, CAST(sum((n > 17)::INT) AS BIGINT) AS n_over FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY user_id",
    "double_taps": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS k, lag(epoch_us(ts)) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k = event_type AND epoch_us(ts) - t <= 3600000000",
    "learned_exceptions": "SELECT lower(gold_word) AS token, count(*) AS n FROM dev_label_review WHERE verdict = 'correct' AND gold_word IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "event_fields": "WITH k AS (SELECT props, unnest(json_keys(props)) AS field FROM events) SELECT field, count(*) AS n, count(DISTINCT json_extract_string(props, '$.\"' || field || '\"')) AS n_values FROM k GROUP BY field",
    "misspelling_map": _PARSED + "SELECT translate(lower(cols[1]), 'ё', 'е') AS word, (max({'f': coalesce(file_name, ''), 'l': coalesce(line_no, 0), 'r': raw_id, 's': lower(cols[2])})).s AS spelled, count(*) AS n FROM c WHERE reason IS NULL AND layout = 'pairs' GROUP BY 1",
    "ranked_list": _PARSED
    + r", w AS (SELECT file_name, line_no, raw_id, lower(cols[2]) AS word, translate(lower(cols[2]), 'ё', 'е') AS key FROM c WHERE reason IS NULL AND layout = 'words' AND regexp_full_match(lower(cols[2]), '\p{L}{2,32}')), f AS (SELECT *, row_number() OVER (PARTITION BY file_name, key ORDER BY line_no, raw_id) AS k FROM w) SELECT file_name, word, key, row_number() OVER (PARTITION BY file_name ORDER BY line_no, raw_id) AS rank FROM f WHERE k = 1",
    "positional_eval": f"WITH p AS (SELECT pair_id, min(set_name) AS set_name, min(source) AS a, min(correction) AS b FROM correction_pairs WHERE source IS NOT NULL AND correction IS NOT NULL GROUP BY pair_id), w AS (SELECT set_name, {_WS.format('a')} AS x, {_WS.format('b')} AS y FROM p) SELECT set_name, CAST(sum(greatest(len(x), len(y))) AS BIGINT) AS n_words, CAST(sum(len(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda i: coalesce(x[i], '') = coalesce(y[i], '')))) AS BIGINT) AS n_same, CAST(sum((len(x) <> len(y))::INT) AS BIGINT) AS n_misaligned FROM w GROUP BY set_name",
    "script_changes": f"WITH {TOK}, n AS (SELECT word, lead(word) OVER (PARTITION BY sent_id ORDER BY pos) AS next FROM tok) SELECT word, count(*) AS n, count(DISTINCT next) AS n_next FROM n WHERE length(word) <= 3 AND (regexp_full_match(word, '[a-z]+') AND regexp_full_match(next, '[а-яё]+') OR regexp_full_match(word, '[а-яё]+') AND regexp_full_match(next, '[a-z]+')) GROUP BY word",
    "training_positions": r"WITH s AS (SELECT regexp_extract_all(lower(sentence), '\p{L}+') AS ws FROM sentence_corpus WHERE sentence IS NOT NULL), p AS (SELECT ws, unnest(list_distinct([0, len(ws) // 3, 2 * len(ws) // 3, len(ws) - 1])) AS pos FROM s WHERE len(ws) > 0) SELECT ws[pos + 1] AS word, count(*) AS n FROM p GROUP BY 1",
    "calibrate_threshold": f"WITH {_LEADS}, n AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS k, count(*) OVER () AS total FROM s WHERE label = 0) SELECT round(max(score), 6) AS threshold FROM n WHERE k > floor(total * 0.05)",
    "confusion_matrix": f"WITH {_LEADS}, g AS (SELECT CAST(sum((label = 1 AND score > 4)::INT) AS BIGINT) AS tp, CAST(sum((label = 0 AND score > 4)::INT) AS BIGINT) AS fp, CAST(sum((label = 1 AND score <= 4)::INT) AS BIGINT) AS fn, CAST(sum((label = 0 AND score <= 4)::INT) AS BIGINT) AS tn FROM s) SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS \"precision\", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_share FROM g",
    "majority_language": rf"WITH {TOK}, t AS (SELECT sent_id, lang, CASE WHEN regexp_matches(word, '[a-z]') THEN 'en' WHEN regexp_matches(word, '[а-яё]') THEN 'ru' ELSE 'other' END AS own FROM tok), n AS (SELECT sent_id, lang, own, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT lang, own, row_number() OVER (PARTITION BY sent_id, lang ORDER BY n DESC, own) AS k FROM n) SELECT lang, own AS majority, count(*) AS n_sentences FROM b WHERE k = 1 GROUP BY ALL",
}
