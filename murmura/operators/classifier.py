"""A classifier's share of a text's sensitivity: hashed terms and a multinomial logistic fit.

It learns what the rules say of the texts that it is given: whether one holds a personal, a financial or a
corporate mark, else it is public. A text's score is the highest probability of the three sensitive kinds
less that of public, cut to [0, 1]; 0 for a blank text, for a text without terms, where the fit fails for
a row (no number), and for all texts if there are fewer than two kinds to learn.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions import sensitivity as S
from murmura.operators import chunking as C
from murmura.session import forget, materialize_at, scratch_folder

KINDS = ("public", "personal", "financial", "corporate")
FEATURES = 1 << 12


def kind_of(text: Column) -> Column:
    """The number of a text's kind by the rules: the first of the sensitive ones that it shows."""
    has = lambda *names: reduce(or_, [S.shows(text, n) for n in names])
    personal, financial, corporate = has("ID", "Phone", "Email", "PersonalStrong", "PersonalWeak"), has("Bank", "Money", "Finance"), has("CorporateStrong", "CorporateWeak")
    return F.when(personal, 1.0).when(financial, 2.0).when(corporate, 3.0).otherwise(0.0)


def score_of(probabilities: Column) -> Column:
    """max(sensitive) - public of an array of KINDS' probabilities; 0 where one isn't a number."""
    p = [F.get(probabilities, F.lit(i)) for i in range(len(KINDS))]
    value = S.clip(F.greatest(*p[1:]) - p[0], 0.0, 1.0)
    bad = F.coalesce(F.exists(probabilities, lambda x: x.isNull() | F.isnan(x)), F.lit(True))
    return F.when(bad, F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def _features(rows: DataFrame, text_col: str) -> DataFrame:
    terms = rows.withColumn("__terms", F.coalesce(C.distinct_terms(F.col(text_col)), F.array().cast("array<string>")))
    return HashingTF(numFeatures=FEATURES, inputCol="__terms", outputCol="__features").transform(terms)


@dataclass
class TermClassifier:
    """model None: too few kinds were there to learn."""

    model: LogisticRegressionModel | None

    @classmethod
    def fit(cls, rows: DataFrame, text_col: str = "text", kind: Column | None = None, rounds: int = 30) -> TermClassifier:
        """kind: a number of KINDS, the rules' by default."""
        rows = rows.where(F.col(text_col).isNotNull()).withColumn("__kind", kind_of(F.col(text_col)) if kind is None else kind)
        rows, known = materialize_at(_features(rows, text_col).select("__kind", "__features"), "features")  # texts are read once
        if rows.select("__kind").distinct().count() < 2:
            forget(rows.sparkSession, known)
            return cls(None)
        model = LogisticRegression(featuresCol="__features", labelCol="__kind", family="multinomial", regParam=0.01, maxIter=rounds).fit(rows)
        forget(rows.sparkSession, known)
        # read back, as the summary of its training can't be sent to tasks once the session has observed counts
        path = scratch_folder(rows.sparkSession, "classifier")
        model.write().save(path)
        model = LogisticRegressionModel.load(path)
        forget(rows.sparkSession, path)
        return cls(model)

    def scored(self, rows: DataFrame, text_col: str = "text", out_col: str = "nlp") -> DataFrame:
        """rows with the score; what sensitivity.fused_score() and profile() take as nlp."""
        if self.model is None:
            return rows.withColumn(out_col, F.lit(0.0))
        found = self.model.setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__label").transform(_features(rows, text_col))
        p = F.concat(vector_to_array("__p"), F.array(*[F.lit(0.0)] * len(KINDS)))  # kinds that weren't seen have none
        blank = F.col(text_col).isNull() | (C.strip(F.col(text_col)) == "") | (F.size("__terms") == 0)
        return found.withColumn(out_col, F.when(blank, F.lit(0.0)).otherwise(score_of(F.slice(p, 1, len(KINDS))))).drop("__terms", "__features", "__p", "__raw", "__label")
