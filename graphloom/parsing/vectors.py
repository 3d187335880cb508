"""Sparse weight vectors as tables (x array<string>, y, w); a missing key reads 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["x", "y"]


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("w").alias("w"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sum(a.select(*KEY, "w").unionByName(b.select(*KEY, "w")))


def sub(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, neg(b))


def scale(a: DataFrame, k: float) -> DataFrame:
    return a.select(*KEY, (F.col("w") * k).alias("w"))


def div(a: DataFrame, k: float) -> DataFrame:
    """Raises for k = 0."""
    return scale(a, 1 / k)


def neg(a: DataFrame) -> DataFrame:
    return scale(a, -1.0)


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, `dot`; 0 where no key is shared."""
    other = b.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("w").alias("__w"))
    both = a.join(other, (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y")))
    return both.agg(F.coalesce(F.sum(F.col("w") * F.col("__w")), F.lit(0.0)).alias("dot"))


def lookup(keys: DataFrame, weights: DataFrame) -> DataFrame:
    """keys with their weight, 0 for a missing one."""
    return keys.join(weights.select(*KEY, "w"), KEY, "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def assign(a: DataFrame, new: DataFrame) -> DataFrame:
    """a with the keys of `new` overwritten."""
    return a.select(*KEY, "w").join(new.select(*KEY), KEY, "left_anti").unionByName(new.select(*KEY, "w"))


def save(a: DataFrame, path: str) -> None:
    a.select(*KEY, "w").write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*KEY, "w")


def probabilities(derivations: DataFrame, key: str = "qid", score: str = "score") -> DataFrame:
    """derivations with `p`, the score's share in its question's, and `status`: no_parse where all scores are 0.

    The sums are aggregated and joined back, so a question with a third of all derivations isn't one task.
    """
    z = derivations.groupBy(F.col(key).alias("__q")).agg(F.sum(score).alias("__z"))
    out = derivations.join(z, F.col(key) == F.col("__q"))
    return out.withColumn("p", F.coalesce(F.try_divide(score, "__z"), F.lit(0.0))).withColumn("status", F.when(F.col("__z") > 0, "ok").otherwise("no_parse")).drop("__q", "__z")


def gradient(derivations: DataFrame, features: DataFrame) -> DataFrame:
    """The step's direction: features of correct derivations less, for all, max(1, correct ones of the question) times their
    probability. derivations: (qid, deriv, p, correct); features: (qid, deriv, x, y, n)."""
    per = derivations.groupBy(F.col("qid").alias("__q")).agg(F.sum(F.col("correct").cast("int")).alias("__c"))
    coef = derivations.join(per, F.col("qid") == F.col("__q")).select("qid", "deriv", (F.col("correct").cast("double") - F.greatest(F.lit(1), F.col("__c")) * F.col("p")).alias("coef"))
    return features.join(coef, ["qid", "deriv"]).groupBy(*KEY).agg(F.sum(F.col("coef") * F.col("n")).alias("w"))


def step(weights: DataFrame, grad: DataFrame, rate: float) -> DataFrame:
    return add(weights, scale(grad, rate))


def log_likelihood(derivations: DataFrame) -> DataFrame:
    return derivations.filter("correct AND p > 0").agg(F.coalesce(F.sum(F.log("p")), F.lit(0.0)).alias("log_likelihood"))


def best(derivations: DataFrame, ties: Column | str = "deriv") -> DataFrame:
    """Each question's most probable derivation."""
    return derivations.groupBy("qid").agg(F.max_by(F.struct(*[c for c in derivations.columns if c != "qid"]), F.struct("p", -F.col(ties) if isinstance(ties, str) else ties)).alias("d")).select("qid", "d.*")


def accuracy(derivations: DataFrame, ties: Column | str = "deriv") -> DataFrame:
    return best(derivations, ties).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))


def beam_top(candidates: DataFrame, group: list[str], score: str, ties: str, k: int) -> DataFrame:
    """The k best of each group; Spark keeps only k rows a group in every task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), ties)
    return candidates.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
