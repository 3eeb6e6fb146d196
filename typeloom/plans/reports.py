"""Queries of selections, lists, sentence starts, examples, applied suggestions and reviewed changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.functions import layout as Y
from typeloom.functions import text as T
from typeloom.operators import gestures as G
from typeloom.operators import lexicon as L
from typeloom.plans.corpus import LEX, lex, sentences
from typeloom.plans.decisions import _CONV, _shape_sql
from typeloom.plans.judged import ORACLE as _JUDGED
from typeloom.plans.judged import typo_decide
from typeloom.tables import load

#: Sources that are left out, whatever their case.
EXCLUDED = ("rus_chat_2024_1M", "ENG_notes_2023_100k")


def selection_convert(spark, sf_dir):  # noqa: ANN001, ANN201
    """Whole texts converted to the other layout, of 1 to 100,000 characters and only where that changes something."""
    s = sentences(spark, sf_dir).where(F.length("sentence").between(1, 100_000)).withColumn("converted", Y.convert(F.col("sentence")))
    return s.where("converted <> sentence").select("sent_id", "converted")


def list_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    """Lines of a text as a list: without spaces around, without empty ones, each once whatever its case, the first spelling kept."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    first = lines.groupBy("doc_id", F.lower("line").alias("low")).agg(F.min(F.struct("at", "line")).alias("x"))
    return first.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("x.line")).alias("n_chars"), F.min("x").getField("line").alias("first_line"))


def ranked_sentences(spark, sf_dir):  # noqa: ANN001, ANN201
    """The 50,000 most frequent words of 2 to 25 letters of each language in fours, as sentences to train on."""
    w = L.with_rank(lex(spark, sf_dir).where("rank <= 50000 and len between 2 and 25").select("lang", "word", "cnt"), "place")
    four = w.groupBy("lang", F.floor((F.col("place") - 1) / 4).alias("four")).agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("x"))
    return four.where(F.size("x") == 4).select("lang", "four", F.array_join(F.col("x.word"), " ").alias("sentence"))


def first_sentences(spark, sf_dir):  # noqa: ANN001, ANN201
    """The first thousand sentences of each language."""
    s = sentences(spark, sf_dir).where("sentence is not null").select(L.language(F.col("source")).alias("lang"), "sent_id")
    a, b = (s.where(F.col("lang") == x).orderBy("sent_id").limit(1000) for x in ("ru", "en"))
    return a.unionByName(b)


def sentence_starts(spark, sf_dir):  # noqa: ANN001, ANN201
    """How often a word begins a sentence, and how often it follows another within one; words before do not reach across its start."""
    d = load(spark, sf_dir, "documents").select("lang", F.explode(T.sentences(F.col("text"))).alias("s")).select("lang", F.posexplode(T.letter_runs(F.col("s"))).alias("pos", "word"))
    return d.groupBy("lang", "word").agg(F.sum((F.col("pos") == 0).cast("int")).alias("n_start"), F.sum((F.col("pos") > 0).cast("int")).alias("n_after"))


def excluded_sources(spark, sf_dir):  # noqa: ANN001, ANN201
    """Documents of sources that are not left out; a null source is none of them."""
    d = load(spark, sf_dir, "documents").where(~F.coalesce(F.lower("source").isin(*[x.lower() for x in EXCLUDED]), F.lit(False)))
    return d.groupBy("source").agg(F.count("*").alias("n_docs"))


def shape_examples(spark, sf_dir):  # noqa: ANN001, ANN201
    """The first twenty tokens, in their order, that each rule of shape keeps."""
    w = sentences(spark, sf_dir).select(F.explode(T.white_space_tokens(F.col("sentence"))).alias("token")).distinct()
    w = w.withColumn("reason", F.coalesce(T.shape_reason(F.col("token")), F.lit("open")))
    return w.withColumn("place", F.row_number().over(Window.partitionBy("reason").orderBy("token"))).where("place <= 20").select("reason", "place", "token")


def typo_misses(spark, sf_dir):  # noqa: ANN001, ANN201
    """Why slips are left as they are."""
    return typo_decide(spark, sf_dir).where("corrected is null").groupBy("reason").agg(F.count("*").alias("n"))


_MATCHES = "array<struct<offset:int,length:int,replacements:array<struct<value:string>>>>"


def suggestion_edits(spark, sf_dir):  # noqa: ANN001, ANN201
    """A checker's answer for each reviewed passage, read from JSON and applied: the first replacement of every match, none where it is empty or out of range."""
    r = load(spark, sf_dir, "dev_label_review").where("context is not null").withColumns({"a": F.instr("context", "[["), "b": F.instr("context", "]]")}).where("a > 0 and b > a")
    clean = F.concat(F.substr("context", F.lit(1), F.col("a") - 1), F.substr("context", F.col("a") + 2, F.col("b") - F.col("a") - 2), F.substr("context", F.col("b") + 2))
    answer = F.to_json(F.struct(F.array(F.struct((F.col("a") - 1).alias("offset"), (F.col("b") - F.col("a") - 2).alias("length"), F.array(F.struct(F.coalesce("proposed", F.lit("")).alias("value"))).alias("replacements"))).alias("matches")))
    r = r.select("review_id", clean.alias("clean"), answer.alias("answer"))
    return G.edited(G.with_suggestions(r, "answer"), "clean", "edits").select("review_id", "edited")


def reviewed_metrics(spark, sf_dir):  # noqa: ANN001, ANN201
    """Proposed changes with the reviewers' verdicts on the same word and passage; changes not reviewed count for nothing."""
    r = load(spark, sf_dir, "dev_label_review").where("context is not null and gold_word is not null and proposed is not null")
    changes = r.select("set_name", "context", "gold_word", "proposed").distinct()
    labels = r.where("verdict is not null").groupBy("set_name", "context", "gold_word").agg(F.max("verdict").alias("verdict"))
    j = changes.join(labels, ["set_name", "context", "gold_word"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("")))
    kind = F.when(F.col("verdict").isin("typo", "typo-other", "correct"), F.col("verdict")).otherwise("unreviewed")
    c = lambda x: F.sum((kind == x).cast("int"))
    g = j.groupBy("set_name").agg(F.count("*").alias("n_changes"), c("typo").alias("n_right"), c("typo-other").alias("n_other"), c("correct").alias("n_false"), c("unreviewed").alias("n_unreviewed"))
    return g.withColumn("precision", F.round(F.coalesce(F.try_divide(F.col("n_right"), F.col("n_changes") - F.col("n_unreviewed")), F.lit(0.0)), 6))


def all_exceptions(spark, sf_dir):  # noqa: ANN001, ANN201
    """Words that are never changed: those learnt from reverts and those reviewers keep, once each with where they are from."""
    learnt = G.learned_exceptions(load(spark, sf_dir, "dev_label_review").where("verdict = 'correct'"), "gold_word").select("token", F.lit("learnt").alias("origin"))
    kept = load(spark, sf_dir, "known_misspellings_review").where("verdict = 'keep' and word is not null").select(F.lower("word").alias("token"), F.lit("kept").alias("origin"))
    return learnt.unionByName(kept).groupBy("token").agg(F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"))


QUERIES = {f.__name__: f for f in (selection_convert, list_lines, ranked_sentences, first_sentences, sentence_starts, excluded_sources, shape_examples, typo_misses, suggestion_edits, reviewed_metrics, all_exceptions)}
_DROP = ", ".join(f"'{x.lower()}'" for x in EXCLUDED)
ORACLE = {
    "selection_convert": f"SELECT sent_id, {_CONV('sentence')} AS converted FROM sentence_corpus WHERE length(sentence) BETWEEN 1 AND 100000 AND {_CONV('sentence')} <> sentence",
    "list_lines": r"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, trim(unnest(ls), ' ') AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM documents)),
      f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) AS k FROM l WHERE line <> '') SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, arg_min(line, pos) AS first_line FROM f WHERE k = 1 GROUP BY doc_id""",
    "ranked_sentences": f"WITH {LEX}, w AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word) AS place FROM lex WHERE rank <= 50000 AND len BETWEEN 2 AND 25) SELECT lang, CAST((place - 1) // 4 AS BIGINT) AS four, string_agg(word, ' ' ORDER BY place) AS sentence FROM w GROUP BY lang, four HAVING count(*) = 4",
    "first_sentences": "SELECT lang, sent_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sent_id) AS k FROM (SELECT CASE WHEN starts_with(source, 'rus_') THEN 'ru' WHEN starts_with(source, 'eng_') THEN 'en' END AS lang, sent_id FROM sentence_corpus WHERE sentence IS NOT NULL) WHERE lang IS NOT NULL) WHERE k <= 1000",
    "sentence_starts": r"""WITH s AS (SELECT lang, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS s FROM documents),
      w AS (SELECT lang, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM (SELECT lang, regexp_extract_all(lower(s), '\p{L}+') AS ws FROM s)) SELECT lang, word, CAST(sum((pos = 0)::INT) AS BIGINT) AS n_start, CAST(sum((pos > 0)::INT) AS BIGINT) AS n_after FROM w GROUP BY lang, word""",
    "excluded_sources": f"SELECT source, count(*) AS n_docs FROM documents WHERE NOT coalesce(lower(source) IN ({_DROP}), false) GROUP BY source",
    "shape_examples": rf"WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(trim(sentence, ' '), '\s+'), lambda x: x <> '')) AS token FROM sentence_corpus), r AS (SELECT token, coalesce({_shape_sql('token')}, 'open') AS reason FROM w) SELECT * FROM (SELECT reason, row_number() OVER (PARTITION BY reason ORDER BY token) AS place, token FROM r) WHERE place <= 20",
    "typo_misses": f"SELECT reason, count(*) AS n FROM ({_JUDGED['typo_decide']}) WHERE corrected IS NULL GROUP BY reason",
    "suggestion_edits": "SELECT review_id, substr(context, 1, a - 1) || CASE WHEN coalesce(proposed, '') = '' THEN substr(context, a + 2, b - a - 2) ELSE proposed END || substr(context, b + 2) AS edited FROM (SELECT *, instr(context, '[[') AS a, instr(context, ']]') AS b FROM dev_label_review WHERE context IS NOT NULL) WHERE a > 0 AND b > a",
    "reviewed_metrics": """WITH r AS (SELECT * FROM dev_label_review WHERE context IS NOT NULL AND gold_word IS NOT NULL AND proposed IS NOT NULL), c AS (SELECT DISTINCT set_name, context, gold_word, proposed FROM r),
      l AS (SELECT set_name, context, gold_word, max(verdict) AS verdict FROM r WHERE verdict IS NOT NULL GROUP BY ALL), j AS (SELECT c.set_name, coalesce(verdict, '') AS v FROM c LEFT JOIN l ON l.set_name = c.set_name AND l.context = c.context AND l.gold_word = c.gold_word),
      g AS (SELECT set_name, count(*) AS n_changes, CAST(sum((v = 'typo')::INT) AS BIGINT) AS n_right, CAST(sum((v = 'typo-other')::INT) AS BIGINT) AS n_other, CAST(sum((v = 'correct')::INT) AS BIGINT) AS n_false, CAST(sum((v NOT IN ('typo', 'typo-other', 'correct'))::INT) AS BIGINT) AS n_unreviewed FROM j GROUP BY set_name)
      SELECT *, round(coalesce(n_right / nullif(n_changes - n_unreviewed, 0), 0), 6) AS "precision" FROM g""",
    "all_exceptions": "SELECT token, array_to_string(list_sort(list_distinct(list(origin))), ',') AS origins FROM (SELECT lower(gold_word) AS token, 'learnt' AS origin FROM dev_label_review WHERE verdict = 'correct' AND gold_word IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 UNION ALL SELECT lower(word), 'kept' FROM known_misspellings_review WHERE verdict = 'keep' AND word IS NOT NULL) GROUP BY token",
}
