"""Queries that build tokens, lexicons, models and pair tables from the sentence corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions import hashing as H
from typeloom.functions import text as T
from typeloom.operators import lexicon as L
from typeloom.tables import load


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "sentence_corpus").select("sent_id", "source", "split", "sentence")


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tokens(sentences(spark, sf_dir))


def lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ranked(tok(spark, sf_dir))


def word_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.word_arrays(sentences(spark, sf_dir))


#: Tokens and ranked lexicon in SQL.
TOK = r"""
t0 AS (SELECT sent_id, CASE WHEN starts_with(source, 'rus_') THEN 'ru' WHEN starts_with(source, 'eng_') THEN 'en' END AS lang, regexp_extract_all(lower(sentence), '\p{L}+') AS ws FROM sentence_corpus WHERE sentence IS NOT NULL),
tok AS (SELECT sent_id, lang, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM t0)"""
LEX = (
    TOK
    + r""",
cnt AS (SELECT lang, word, count(*) AS cnt FROM tok WHERE lang = 'en' AND regexp_full_match(word, '[a-z]{2,32}') OR lang = 'ru' AND regexp_full_match(word, '[а-яё]{2,32}') GROUP BY ALL),
mrg AS (SELECT lang, (max({'c': cnt, 'w': word})).w AS word, translate(word, 'ё', 'е') AS key, CAST(sum(cnt) AS BIGINT) AS cnt FROM cnt GROUP BY lang, translate(word, 'ё', 'е')),
lex AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word) AS rank, length(word) AS len FROM mrg)"""
)


def token_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return tok(spark, sf_dir).groupBy("lang", "word").agg(F.count("*").alias("cnt"))


def token_profile(spark, sf_dir):  # noqa: ANN001, ANN201
    t = tok(spark, sf_dir)
    return t.groupBy("lang").agg(F.count("*").alias("n_tokens"), F.countDistinct("word").alias("n_words"), F.countDistinct("sent_id").alias("n_sentences"), F.max(F.length("word")).alias("longest"), F.round(F.avg(F.length("word")), 6).alias("mean_length"))


def boundary_tokens(spark, sf_dir):  # noqa: ANN001, ANN201
    s = sentences(spark, sf_dir).select("sent_id", F.explode(T.boundary_tokens(F.col("sentence"))).alias("piece"))
    end = F.when(s.piece.rlike(rf"[^{T.TOKEN_CLASS}]$"), F.substring("piece", -1, 1)).otherwise("")
    s = s.withColumn("separator", end).withColumn("token", F.col("piece").substr(F.lit(1), F.length("piece") - F.length("separator")))
    return s.groupBy("token", "separator").agg(F.count("*").alias("n"), F.countDistinct("sent_id").alias("n_sentences"))


_TC = T.TOKEN_CLASS.replace('"', '"').replace("'", "''")
_BOUNDARY = rf"""
WITH p AS (SELECT sent_id, unnest(regexp_extract_all(sentence, '[{_TC}]*[^{_TC}]|[{_TC}]+$')) AS piece FROM sentence_corpus),
q AS (SELECT *, CASE WHEN regexp_matches(piece, '[^{_TC}]$') THEN right(piece, 1) ELSE '' END AS separator FROM p)
SELECT substr(piece, 1, length(piece) - length(separator)) AS token, separator, count(*) AS n, count(DISTINCT sent_id) AS n_sentences FROM q GROUP BY ALL"""


def sentence_split(spark, sf_dir):  # noqa: ANN001, ANN201
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.size(T.letter_runs(F.col("sentence")))).alias("n_words"), F.max(F.length("sentence")).alias("longest"))


def sentence_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    """Sentences of at least three words of which four fifths are of the expected script."""
    s = sentences(spark, sf_dir).withColumn("lang", L.language(F.col("source"))).withColumn("ws", T.letter_runs(F.col("sentence")))
    own = F.size(F.filter("ws", lambda w: F.when(F.col("lang") == "ru", w.rlike("[а-яё]") & ~w.rlike("[a-z]")).otherwise(w.rlike("[a-z]") & ~w.rlike("[а-яё]"))))
    return s.where(F.col("lang").isNotNull() & (F.size("ws") >= 3) & (own * 10 >= F.size("ws") * 8)).groupBy("source", "split").agg(F.count("*").alias("n_kept"), F.sum(F.size("ws")).alias("n_words"))


def split_buckets(spark, sf_dir):  # noqa: ANN001, ANN201
    s = sentences(spark, sf_dir).where("sentence is not null").withColumn("bucket", H.split_bucket(T.sentence_normal(F.col("sentence"))))
    return s.select("sent_id", "bucket", H.split_of(F.col("bucket")).alias("new_split"))


def sentence_dedup(spark, sf_dir):  # noqa: ANN001, ANN201
    """The first of the sentences with equal normal form, and per source and split how many are left."""
    s = sentences(spark, sf_dir).where("sentence is not null").withColumn("digest", F.sha2(T.sentence_normal(F.col("sentence")), 256))
    first = s.groupBy("digest").agg(F.min(F.struct("sent_id", "source", "split")).alias("x"))
    return first.groupBy("x.source", "x.split").agg(F.count("*").alias("n_sentences"))


_NORMAL = r"regexp_replace(trim(lower(sentence), e' \t\n\r'), '\s+', ' ', 'g')"
_BUCKET = f"(('0x' || substr(sha256({_NORMAL}), 7, 2) || substr(sha256({_NORMAL}), 5, 2) || substr(sha256({_NORMAL}), 3, 2) || substr(sha256({_NORMAL}), 1, 2))::BIGINT % 1000)"


def ranked_lexicon(spark, sf_dir):  # noqa: ANN001, ANN201
    return lex(spark, sf_dir).select("lang", "word", "key", "cnt", "rank", "len")


def known_forms(spark, sf_dir):  # noqa: ANN001, ANN201
    """Words in at least two sentences: the known forms."""
    return tok(spark, sf_dir).where(L.pure(F.col("lang"), F.col("word"))).select("lang", "word", "sent_id").distinct().groupBy("lang", "word").agg(F.count("*").alias("n")).where("n >= 2").select("lang", "word")


_KNOWN = r", known AS (SELECT lang, word FROM (SELECT DISTINCT lang, word, sent_id FROM tok WHERE lang = 'en' AND regexp_full_match(word, '[a-z]{2,32}') OR lang = 'ru' AND regexp_full_match(word, '[а-яё]{2,32}')) GROUP BY ALL HAVING count(*) >= 2)"


def _distinct_known(spark, sf_dir):  # noqa: ANN001, ANN202
    """Known forms by a second corpus: those of the corrected sides of the pairs."""
    c = load(spark, sf_dir, "correction_pairs").select(F.explode(T.letter_runs(F.col("correction"))).alias("word"))
    return c.select(F.when(F.col("word").rlike("^[a-z]{2,32}$"), "en").when(F.col("word").rlike("^[а-яё]{2,32}$"), "ru").alias("lang"), "word").where("lang is not null").distinct()


_PAIR_KNOWN = r", pk AS (SELECT DISTINCT CASE WHEN regexp_full_match(word, '[a-z]{2,32}') THEN 'en' WHEN regexp_full_match(word, '[а-яё]{2,32}') THEN 'ru' END AS lang, word FROM (SELECT unnest(regexp_extract_all(lower(correction), '\p{L}+')) AS word FROM correction_pairs) WHERE regexp_full_match(word, '[a-z]{2,32}|[а-яё]{2,32}'))"


def form_list(spark, sf_dir):  # noqa: ANN001, ANN201
    return L.form_list(lex(spark, sf_dir), _distinct_known(spark, sf_dir))


def seen_forms(spark, sf_dir):  # noqa: ANN001, ANN201
    return L.seen_forms(lex(spark, sf_dir), _distinct_known(spark, sf_dir))


def lexicon_union(spark, sf_dir):  # noqa: ANN001, ANN201
    """All known forms of both corpora with the number of corpora they are in."""
    a = known_forms(spark, sf_dir).withColumn("origin", F.lit("sentences"))
    b = _distinct_known(spark, sf_dir).withColumn("origin", F.lit("pairs"))
    return a.unionByName(b).groupBy("lang", "word").agg(F.countDistinct("origin").alias("n_origins"))


def lexicon_by_length(spark, sf_dir):  # noqa: ANN001, ANN201
    return lex(spark, sf_dir).groupBy("lang", "len").agg(F.count("*").alias("n_words"), F.sum("cnt").alias("n_tokens"), F.min("rank").alias("best_rank"))


def forms_common(spark, sf_dir):  # noqa: ANN001, ANN201
    return known_forms(spark, sf_dir).intersect(_distinct_known(spark, sf_dir)).groupBy("lang").agg(F.count("*").alias("n_words"))


def forms_missing(spark, sf_dir):  # noqa: ANN001, ANN201
    return _distinct_known(spark, sf_dir).exceptAll(known_forms(spark, sf_dir))


def trigram_model(spark, sf_dir):  # noqa: ANN001, ANN201
    return L.trigram_model(lex(spark, sf_dir), "^", 1 / F.sqrt("rank")).withColumn("weight", F.round("weight", 4))


def trigram_model_legacy(spark, sf_dir):  # noqa: ANN001, ANN201
    return L.trigram_model(lex(spark, sf_dir), "^^", F.ln(1 + F.col("cnt"))).withColumn("weight", F.round("weight", 4))


def language_score(spark, sf_dir):  # noqa: ANN001, ANN201
    words = lex(spark, sf_dir)
    letters = F.when(F.col("lang") == "ru", 33).otherwise(26)
    return L.language_scores(words, L.trigram_model(words, "^", 1 / F.sqrt("rank")), "^", 0.05, letters).withColumn("score", F.round("score", 6))


def _grams_sql(pad: str, weight: str) -> str:
    return f", g AS (SELECT lang, word, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS gram, {weight} AS w FROM (SELECT *, '{pad}' || word || '$' AS p FROM lex)), m AS (SELECT lang, gram, sum(w) AS weight FROM g GROUP BY ALL)"


def feature_hash(spark, sf_dir):  # noqa: ANN001, ANN201
    """Hashed n-gram counts of all words of the lexicon."""
    f = L.fanned(lex(spark, sf_dir)).select("lang", F.explode(H.feature_names(F.col("word"), "o", 3)).alias("name"))
    return f.groupBy("lang", "name").agg(F.count("*").alias("n")).withColumn("idx", H.fnv16(F.col("name"))).groupBy("lang", "idx").agg(F.sum("n").alias("n"), F.count("*").alias("n_names"))


_FEATURES = r"""
, f AS (SELECT lang, unnest(flatten([list_transform(range(1, length(p) - n + 2), lambda i: 'o' || n || ':' || substr(p, i, n)) for n in [1, 2, 3]])) AS name FROM (SELECT lang, '^' || word || '$' AS p FROM lex)),
c AS (SELECT lang, name, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT *, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, octet_length(encode(name)) + 1), lambda i: ('0x' || substr(hex(encode(name)), 2 * i - 1, 2))::HUGEINT)), lambda a, b: (xor(a::BIGINT, b::BIGINT)::HUGEINT * 16777619) % 4294967296) % 65536 AS idx FROM c)
SELECT lang, CAST(idx AS BIGINT) AS idx, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_names FROM h GROUP BY lang, idx"""


def bloom_probes(spark, sf_dir):  # noqa: ANN001, ANN201
    """How often each probe position of the known forms is hit, by blocks of positions."""
    p = L.fanned(lex(spark, sf_dir)).select("lang", F.explode(H.bloom_probes(1 << 23)(T.plain(F.lower("word")))).alias("at"))
    return p.groupBy("lang", F.shiftright("at", 13).alias("block")).agg(F.count("*").alias("n"), F.countDistinct("at").alias("n_bits"))


_U = "18446744073709551616::UHUGEINT"


def _fnv_sql(start: int, prime: int) -> str:
    # a product of two 64-bit numbers fits the 128-bit type
    return f"list_reduce(list_prepend({start}::UHUGEINT, bs), lambda a, b: (xor(a::UBIGINT, b::UBIGINT)::UHUGEINT * {prime}::UHUGEINT) % {_U})"


_BLOOM = rf"""
, b AS (SELECT lang, list_transform(range(1, octet_length(encode(key)) + 1), lambda i: ('0x' || substr(hex(encode(key)), 2 * i - 1, 2))::UHUGEINT) AS bs FROM lex),
h AS (SELECT lang, {_fnv_sql(H.FNV64_START, H.FNV64_PRIME)} AS a, {_fnv_sql(H.SECOND_START, H.SECOND_PRIME)} AS c FROM b),
o AS (SELECT lang, a, CASE WHEN c % 2 = 0 THEN c + 1 ELSE c END AS c FROM h),
p AS (SELECT lang, unnest(list_transform(range(7), lambda i: ((a + i::UHUGEINT * c) % {1 << 23}::UHUGEINT)::BIGINT)) AS pos FROM o)
SELECT lang, pos // 8192 AS block, count(*) AS n, count(DISTINCT pos) AS n_bits FROM p GROUP BY ALL"""


def pair_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return L.pair_counts(word_arrays(spark, sf_dir), lex(spark, sf_dir)).where("cnt >= 2").select("lang", "prev", "next", "cnt", H.quantised(F.col("cnt")).alias("q"), F.round(H.dequantised(H.quantised(F.col("cnt"))), 6).alias("decoded"))


def pair_survival(spark, sf_dir):  # noqa: ANN001, ANN201
    by = L.pair_counts(word_arrays(spark, sf_dir), lex(spark, sf_dir)).groupBy("lang", "cnt").agg(F.count("*").alias("k"))
    return by.select("lang", "cnt", "k", F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 10)))).alias("least")).groupBy("lang", "least").agg(F.sum(F.when(F.col("cnt") >= F.col("least"), F.col("k")).otherwise(0)).alias("n_pairs"))


def pair_lift(spark, sf_dir):  # noqa: ANN001, ANN201
    words = lex(spark, sf_dir)
    totals = words.groupBy("lang").agg(F.sum("cnt").alias("total"))
    return L.pair_lift(L.pair_counts(word_arrays(spark, sf_dir), words).where("cnt >= 2"), totals).select("lang", "prev", "next", F.round("lift", 6).alias("lift"))


_PAIRS = """
, n AS (SELECT lang, word AS prev, lead(word) OVER (PARTITION BY sent_id ORDER BY pos) AS next FROM tok),
c2 AS (SELECT lang, prev, next, count(*) AS cnt FROM n WHERE next IS NOT NULL GROUP BY ALL),
pr AS (SELECT c2.*, a.cnt AS prev_cnt, b.cnt AS next_cnt FROM c2 JOIN lex a ON a.lang = c2.lang AND a.word = c2.prev AND a.rank <= 16383 JOIN lex b ON b.lang = c2.lang AND b.word = c2.next AND b.rank <= 200000)
"""
_Q = "least(255, 1 + CAST(round_even(10 * log2(cnt), 0) AS INT))"


def context_words(spark, sf_dir):  # noqa: ANN001, ANN201
    """How often a word follows each context of one and two words; contexts do not cross sentences."""
    at = lambda i: F.when(i >= 0, F.get("ws", i))
    each = F.transform("ws", lambda w, i: F.struct(w.alias("word"), at(i - 1).alias("prev"), at(i - 2).alias("prev2")))
    # contexts are counted once each, then those of two words make those of one: no distinct count is expanded
    two = word_arrays(spark, sf_dir).select("lang", F.inline(each)).groupBy("lang", "word", "prev", "prev2").agg(F.count("*").alias("n"))
    one = two.groupBy("lang", "word", "prev").agg(F.sum("n").alias("n"), F.count("prev2").alias("k"))
    first = F.sum(F.when(F.col("prev").isNull(), F.col("n")).otherwise(0))
    return one.groupBy("lang", "word").agg(first.alias("n_first"), F.count("prev").alias("n_prev"), F.sum("k").alias("n_prev2"))


def text_cleanup(spark, sf_dir):  # noqa: ANN001, ANN201
    """Sentences without markup, addresses and outer punctuation, with the size gate."""
    s = sentences(spark, sf_dir).where("sentence is not null")
    c = T.stripped_markup(F.col("sentence"))
    return s.select("sent_id", T.without_tail(T.without_head(c)).alias("inner_text"), T.octets_within(c).alias("fits"), F.size(T.white_space_tokens(c)).alias("n_tokens"))


def guarded_words(spark, sf_dir):  # noqa: ANN001, ANN201
    return sentences(spark, sf_dir).select(F.explode(T.guarded_words(F.col("sentence"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def context_normal(spark, sf_dir):  # noqa: ANN001, ANN201
    s = sentences(spark, sf_dir).select(F.explode(T.white_space_tokens(F.col("sentence"))).alias("w"))
    return s.select(T.context_normal(F.col("w")).alias("word"), T.is_capitalized(F.col("w")).cast("int").alias("cap")).groupBy("word").agg(F.count("*").alias("n"), F.sum("cap").alias("n_capitalized"))


def ngram_mask(spark, sf_dir):  # noqa: ANN001, ANN201
    return lex(spark, sf_dir).select("lang", "word", F.bit_count(H.letter_mask(F.col("word"))).alias("n_letters"))


def manifest(spark, sf_dir):  # noqa: ANN001, ANN201
    """Row counts and an order-free digest of every word with its count and rank.

    The digest is the sum of eight 32-bit parts of each row's SHA-256, so rows are never collected.
    """
    row = F.sha2(F.concat_ws(":", "lang", "word", F.col("cnt").cast("string"), F.col("rank").cast("string")), 256)
    part = lambda i: F.conv(F.substring("_row", 8 * i + 1, 8), 16, 10).cast("decimal(10,0)")
    sums = [F.sum(part(i)).cast("string") for i in range(8)]
    return lex(spark, sf_dir).withColumn("_row", row).groupBy("lang").agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(":", *sums), 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (token_counts, token_profile, boundary_tokens, sentence_split, sentence_filter, split_buckets, sentence_dedup, ranked_lexicon, known_forms, form_list, seen_forms, lexicon_union, lexicon_by_length, forms_common, forms_missing, trigram_model, trigram_model_legacy, language_score, feature_hash, bloom_probes, pair_counts, pair_survival, pair_lift, context_words, text_cleanup, guarded_words, context_normal, ngram_mask, manifest)
}
ORACLE = {
    "token_counts": f"WITH {TOK} SELECT lang, word, count(*) AS cnt FROM tok GROUP BY ALL",
    "token_profile": f"WITH {TOK} SELECT lang, count(*) AS n_tokens, count(DISTINCT word) AS n_words, count(DISTINCT sent_id) AS n_sentences, max(length(word)) AS longest, round(avg(length(word)), 6) AS mean_length FROM tok GROUP BY lang",
    "boundary_tokens": _BOUNDARY,
    "sentence_split": r"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS sentence FROM documents)
      SELECT doc_id, count(*) AS n_sentences, CAST(sum(len(regexp_extract_all(lower(sentence), '\p{L}+'))) AS BIGINT) AS n_words, max(length(sentence)) AS longest FROM s GROUP BY doc_id""",
    "sentence_filter": r"""WITH s AS (SELECT *, CASE WHEN starts_with(source, 'rus_') THEN 'ru' WHEN starts_with(source, 'eng_') THEN 'en' END AS lang, regexp_extract_all(lower(sentence), '\p{L}+') AS ws FROM sentence_corpus)
      SELECT source, split, count(*) AS n_kept, CAST(sum(len(ws)) AS BIGINT) AS n_words FROM s WHERE lang IS NOT NULL AND len(ws) >= 3
      AND len(list_filter(ws, lambda w: CASE WHEN lang = 'ru' THEN regexp_matches(w, '[а-яё]') AND NOT regexp_matches(w, '[a-z]') ELSE regexp_matches(w, '[a-z]') AND NOT regexp_matches(w, '[а-яё]') END)) * 10 >= len(ws) * 8 GROUP BY ALL""",
    "split_buckets": f"SELECT sent_id, {_BUCKET} AS bucket, CASE WHEN {_BUCKET} < 20 THEN 'train' WHEN {_BUCKET} < 22 THEN 'calibration' WHEN {_BUCKET} < 24 THEN 'dev' WHEN {_BUCKET} < 26 THEN 'final' ELSE 'unused' END AS new_split FROM sentence_corpus WHERE sentence IS NOT NULL",
    "sentence_dedup": f"SELECT source, split, count(*) AS n_sentences FROM (SELECT *, row_number() OVER (PARTITION BY {_NORMAL} ORDER BY sent_id) AS k FROM sentence_corpus WHERE sentence IS NOT NULL) WHERE k = 1 GROUP BY ALL",
    "ranked_lexicon": f"WITH {LEX} SELECT lang, word, key, cnt, rank, len FROM lex",
    "known_forms": f"WITH {TOK}{_KNOWN} SELECT lang, word FROM known",
    "form_list": f"WITH {LEX}{_PAIR_KNOWN} SELECT * FROM (SELECT lang, word, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word) AS form_rank FROM lex SEMI JOIN pk USING (lang, word) WHERE cnt >= 3) WHERE form_rank <= 200000",
    "seen_forms": f"WITH {LEX}{_PAIR_KNOWN} SELECT lang, word, cnt FROM lex ANTI JOIN pk USING (lang, word) WHERE cnt >= 5 AND len >= 5",
    "lexicon_union": f"WITH {TOK}{_KNOWN}{_PAIR_KNOWN} SELECT lang, word, count(DISTINCT o) AS n_origins FROM (SELECT *, 1 AS o FROM known UNION ALL SELECT *, 2 FROM pk) GROUP BY lang, word",
    "lexicon_by_length": f"WITH {LEX} SELECT lang, len, count(*) AS n_words, CAST(sum(cnt) AS BIGINT) AS n_tokens, min(rank) AS best_rank FROM lex GROUP BY lang, len",
    "forms_common": f"WITH {TOK}{_KNOWN}{_PAIR_KNOWN} SELECT lang, count(*) AS n_words FROM (SELECT * FROM known INTERSECT SELECT * FROM pk) GROUP BY lang",
    "forms_missing": f"WITH {TOK}{_KNOWN}{_PAIR_KNOWN} SELECT lang, word FROM pk EXCEPT ALL SELECT lang, word FROM known",
    "trigram_model": f"WITH {LEX}{_grams_sql('^', '1 / sqrt(rank)')} SELECT lang, gram, round(weight, 4) AS weight FROM m",
    "trigram_model_legacy": f"WITH {LEX}{_grams_sql('^^', 'ln(1 + cnt)')} SELECT lang, gram, round(weight, 4) AS weight FROM m",
    "language_score": f"WITH {LEX}{_grams_sql('^', '1 / sqrt(rank)')}, t AS (SELECT lang, sum(weight) AS total FROM m GROUP BY lang) SELECT lang, word, round(avg(ln((weight + 0.05) / (total + 0.05 * CASE WHEN lang = 'ru' THEN 33 * 33 * 33 ELSE 26 * 26 * 26 END))), 6) AS score FROM g JOIN m USING (lang, gram) JOIN t USING (lang) GROUP BY lang, word",
    "feature_hash": f"WITH {LEX}{_FEATURES}",
    "bloom_probes": f"WITH {LEX}{_BLOOM}",
    "pair_counts": f"WITH {LEX}{_PAIRS} SELECT lang, prev, next, cnt, {_Q} AS q, round(pow(2.0, ({_Q} - 1) / 10.0), 6) AS decoded FROM pr WHERE cnt >= 2",
    "pair_survival": f"WITH {LEX}{_PAIRS} , pk2 AS MATERIALIZED (SELECT c2.lang, c2.cnt, count(*) AS k FROM c2 SEMI JOIN lex a ON a.lang = c2.lang AND a.word = c2.prev AND a.rank <= 16383 SEMI JOIN lex b ON b.lang = c2.lang AND b.word = c2.next AND b.rank <= 200000 GROUP BY c2.lang, c2.cnt) SELECT lang, least, CAST(sum(CASE WHEN cnt >= least THEN k ELSE 0 END) AS BIGINT) AS n_pairs FROM (SELECT *, unnest([1, 2, 3, 5, 10]) AS least FROM pk2) GROUP BY ALL",
    "pair_lift": f"WITH {LEX}{_PAIRS}, t AS (SELECT lang, sum(cnt) AS total FROM lex GROUP BY lang) SELECT lang, prev, next, round(ln((cnt + 2.0) / (prev_cnt * next_cnt / total + 2.0)), 6) AS lift FROM pr JOIN t USING (lang) WHERE cnt >= 2",
    "context_words": f"WITH {TOK}, c AS (SELECT *, lag(word, 1) OVER w AS prev, lag(word, 2) OVER w AS prev2 FROM tok WINDOW w AS (PARTITION BY sent_id ORDER BY pos)) SELECT lang, word, CAST(sum(CASE WHEN prev IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_first, count(DISTINCT prev) AS n_prev, count(DISTINCT CASE WHEN prev2 IS NOT NULL THEN prev || ' ' || prev2 END) AS n_prev2 FROM c GROUP BY lang, word",
    "text_cleanup": r"""WITH c AS (SELECT sent_id, trim(regexp_replace(regexp_replace(regexp_replace(sentence, '(?s)```.*?```', ' ', 'g'), 'https?://\S+|www\.\S+|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS t FROM sentence_corpus WHERE sentence IS NOT NULL)
      SELECT sent_id, rtrim(ltrim(t, '"''[{<'), ',.;:!?"''»)]}') AS inner_text, octet_length(encode(t)) BETWEEN 1 AND 20000 AS fits, len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS n_tokens FROM c""",
    "context_normal": r"""WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(trim(sentence, ' '), '\s+'), lambda x: x <> '')) AS w FROM sentence_corpus)
      SELECT translate(lower(trim(trim(w, ' '), '"''«»„“()[]{}<>')), 'ё', 'е') AS word, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(w, '^\p{Lu}[^\p{Lu}]+$') THEN 1 ELSE 0 END) AS BIGINT) AS n_capitalized FROM w GROUP BY 1""",
    "ngram_mask": f"WITH {LEX} SELECT lang, word, len(list_distinct(list_transform(range(1, length(word) + 1), lambda i: unicode(substr(word, i, 1)) % 64))) AS n_letters FROM lex",
    "manifest": f"WITH {LEX}, h AS (SELECT lang, sha256(concat_ws(':', lang, word, cnt, rank)) AS h FROM lex) SELECT lang, count(*) AS n_rows, sha256(concat_ws(':', "
    + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8))
    + ")) AS digest FROM h GROUP BY lang",
    "guarded_words": r"WITH w AS (SELECT unnest(regexp_extract_all(sentence, '[\p{L}''’@/._\-]+')) AS word FROM sentence_corpus) SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '\p{L}{4,32}') GROUP BY word",
}
