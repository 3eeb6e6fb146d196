"""Training rows, hashed logistic regression, its calibration and use."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.functions.hashing import feature_names, sampled_tenth
from typeloom.functions.layout import convert, script
from typeloom.functions.text import training_tokens

DIM = 1 << 16
__all__ = ["DIM", "calibrated", "fitted", "measured", "names", "training_rows", "vectors"]


def training_rows(sentences: DataFrame, longest: int = 25) -> DataFrame:
    """``token, previous, label, kind`` from ``sent_id, sentence``; ``previous`` are up to two words before it.

    A sentence counts by its words in the script that most of them have (of equals that of the first word), if
    these are three or more. Taken are its first and last word and two between: as they are (0), in the wrong
    layout where that turns the script (1), and for a tenth of the first words five
    protected shapes of them (0), one of mixed script among them.
    """
    # each step stands behind a generator of one row: nothing is computed again for a filter or for each word
    once = lambda **cols: F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()])))
    short = F.filter(training_tokens(F.col("sentence")), lambda w: F.length(w) <= 35)
    s = sentences.select(once(all=F.transform(short, lambda w: F.struct(w.alias("w"), script(w).alias("k")))))
    s = s.select(once(ws=F.filter("all", lambda x: x["k"] != "other"))).where(F.size("ws") > 0)
    twice = 2 * F.size(F.filter("ws", lambda x: x["k"] == "en"))
    s = s.select("ws", once(lang=F.when((twice > F.size("ws")) | ((twice == F.size("ws")) & (F.col("ws")[0]["k"] == "en")), "en").otherwise("ru")))
    s = s.select("lang", once(own=F.filter("ws", lambda x: x["k"] == F.col("lang"))["w"])).withColumn("n", F.size("own")).where("n >= 3")
    at = F.array_distinct(F.array(F.lit(0), F.floor(F.col("n") / 3).cast("int"), F.floor(2 * F.col("n") / 3).cast("int"), F.col("n") - 1))
    each = s.select("lang", "own", F.explode(at).alias("pos")).select("lang", "pos", F.get("own", F.col("pos")).alias("word"), F.slice("own", F.greatest(F.lit(1), F.col("pos") - 1), F.least(F.col("pos"), F.lit(2))).alias("previous"))
    each = each.where(F.length("word") <= longest).select("*", once(converted=convert(F.col("word"))))
    w, c = F.col("word"), F.col("converted")
    row = lambda token, label, kind: F.struct(token.alias("token"), F.lit(label).alias("label"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<token:string,label:int,kind:string>>")
    shapes = [F.concat(w, F.lit("42")), F.concat(w, F.lit("_id")), F.concat(w, F.lit(".com")), F.concat(F.lit("https://"), w, F.lit(".org")), F.concat(w, F.when(F.col("lang") == "en", "Ру").otherwise("En"))]
    wrong = F.when((c != w) & (script(c) != script(w)), F.array(row(c, 1, "wrong"))).otherwise(none)
    protected = F.when((F.col("pos") == 0) & sampled_tenth(w), F.array(*[row(x, 0, "structured") for x in shapes])).otherwise(none)
    return each.select("previous", F.inline(F.concat(F.array(row(w, 0, "right")), wrong, protected))).select("token", "previous", "label", "kind")


def names(token: Column, previous: Column | None = None) -> Column:
    """Feature names of a token: n-grams of it and of its conversion, script and length, and script and ending of the words before it."""
    own = F.concat(
        feature_names(F.lower(token), "o"),
        feature_names(F.lower(convert(token)), "c"),
        F.array(F.concat(F.lit("script:"), script(token)), F.concat(F.lit("len:"), F.least(F.length(token), F.lit(16)).cast("string"))),
    )
    if previous is None:
        return own
    around = F.transform(previous, lambda p, i: F.array(F.concat(F.lit("ctx"), i.cast("string"), F.lit(":"), script(p)), F.concat(F.lit("ctx"), i.cast("string"), F.lit("last:"), F.right(F.lower(p), F.lit(2)))))
    return F.concat(own, F.flatten(around))


def vectors(rows: DataFrame) -> DataFrame:
    """Sparse vectors of ``token, previous``, hashed and built inside the JVM."""
    return HashingTF(numFeatures=DIM, inputCol="names", outputCol="features").transform(rows.withColumn("names", names(F.col("token"), F.col("previous")))).drop("names")


def fitted(vecs: DataFrame, reg: float = 2e-5, steps: int = 30):  # noqa: ANN201
    return LogisticRegression(regParam=reg, elasticNetParam=0.0, maxIter=steps, aggregationDepth=3).fit(vecs)


def calibrated(scores: DataFrame, allowed: float = 0.002, bins: int = 4096) -> DataFrame:
    """``threshold``: the smallest score of a negative above which no more than ``allowed`` of the negatives lie; null without negatives.

    Negatives are counted in ``bins`` classes of equal width first; only the scores of the
    class in which the threshold lies are put in order.
    """
    neg = scores.where("label = 0 and score is not null").select("score")
    lo, hi, n = neg.agg(F.min("score"), F.max("score"), F.count("*")).first()
    if not n:
        return scores.sparkSession.createDataFrame([(None,)], "threshold double")
    width = (hi - lo) / bins or 1.0
    most = int(n * allowed)
    at = F.least(F.lit(bins - 1), F.floor((F.col("score") - lo) / width))
    sizes = neg.groupBy(at.alias("b")).agg(F.count("*").alias("k")).orderBy(F.desc("b")).collect()  # at most ``bins`` rows
    above = 0
    for r in sizes:
        if above + r["k"] > most:
            break
        above += r["k"]
    w = Window.orderBy(F.desc("score"))
    inside = neg.where(at == r["b"]).groupBy("score").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(w))
    return inside.where(F.col("upto") + above > most).agg(F.max("score").alias("threshold"))


def measured(scores: DataFrame, threshold: float) -> DataFrame:
    at = F.col("score") > threshold
    c = lambda x: F.sum(F.when(x, 1).otherwise(0))
    g = scores.agg(c((F.col("label") == 1) & at).alias("tp"), c((F.col("label") == 0) & at).alias("fp"), c((F.col("label") == 1) & ~at).alias("fn"), c((F.col("label") == 0) & ~at).alias("tn"))
    r = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return g.withColumns({"precision": r(F.col("tp"), F.col("tp") + F.col("fp")), "recall": r(F.col("tp"), F.col("tp") + F.col("fn")), "false_share": r(F.col("fp"), F.col("fp") + F.col("tn"))})
