"""Scorers over the features, with the learners that Spark has."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import features as X
from causeway.plans.registry import on_transfers
from causeway.sources import transfers as T

#: Never model inputs: identity, time and labels.
FORBIDDEN = {"row_id", "rank", "minute", "day", "ts", "split", "src", "dst", "is_laundering", "attempt_id", "typology"}


def assert_inputs(columns: list[str]) -> list[str]:
    if bad := FORBIDDEN & set(columns):
        raise ValueError(f"not model inputs: {sorted(bad)}")
    return columns


def vectors(tx):
    t = X.prepared(tx)
    s = X.of_ends(t, u=["out_cnt_s", "out_uniq_s", "out_sum_s", "out_cnt_l"], keep=["split", "l", "fmt", "in_band", "is_round"]).join(T.labels(tx), "row_id")
    s = s.withColumns({"in_band": F.col("in_band").cast("int"), "is_round": F.col("is_round").cast("int"), "label": F.col("is_laundering").cast("double")})
    inputs = assert_inputs(["u_out_cnt_s", "u_out_uniq_s", "u_out_sum_s", "u_out_cnt_l", "l", "fmt", "in_band", "is_round"])
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(s).select("row_id", "split", "label", "features")


@on_transfers()
def gbt_scores(tx):
    v = vectors(tx)
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(v.where("split = 'train'"))
    return model.transform(v.where("split = 'test'")).select("row_id", vector_to_array("probability")[1].alias("score"))


@on_transfers()
def typology_tree(tx):
    """A small tree that tells the typologies of labelled transfers apart, fitted on those of the train split: actual against predicted, in all others."""
    t = T.labels(tx).where("typology is not null").select("row_id", "typology")
    names = [r[0] for r in t.select("typology").distinct().orderBy("typology").limit(101).collect()]  # a closed list of kinds
    if len(names) > 100:
        raise ValueError("more than 100 typologies")
    v = vectors(tx).drop("label").join(t, "row_id").withColumn("label", S.code_in(F.col("typology"), names).cast("double"))
    model = DecisionTreeClassifier(maxDepth=4, seed=1).fit(v.where("split = 'train'"))
    name = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("prediction").cast("int") + 1)
    return model.transform(v.where("split <> 'train'")).groupBy(F.col("typology").alias("actual"), name.alias("predicted")).agg(F.count("*").alias("n"))


@on_transfers()
def isotonic_calibration(tx):
    s = tx.join(T.labels(tx), "row_id").select("row_id", "split", F.col("is_laundering").cast("double").alias("label"), T.score(F.col("row_id")).alias("score"))
    v = VectorAssembler(inputCols=["score"], outputCol="features").transform(s)
    model = IsotonicRegression().fit(v.where("split = 'val_late'"))
    return model.transform(v.where("split = 'test'")).select("row_id", F.col("prediction").alias("p"))
