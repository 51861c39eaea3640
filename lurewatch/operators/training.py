"""Threat classifier, BEC detector, training and batch prediction (I4-I7, I9, I10, G12) with Spark ML.

Text is weighted by TF-IDF over words and pairs of words, numbers are scaled;
term counts enter as they are (Spark ML has no sublinear stage), and solvers
differ from other libraries', so models are compared by metrics.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions import scoring as sc
from . import evaluation as ev
from .messages import ml_rows
from .tables import written

#: Terms kept, share of texts from which a term says nothing, and the BEC detector's columns and threshold.
TERMS, MOST_TEXTS = 3000, 0.95
BEC_FEATURES = ("display_name_privileged", "reply_to_mismatch", "return_path_mismatch", "header_risk_tally", "url_count", "financial_keyword_hits", "exclamation_count", "body_wire_transfer_mention", "body_gift_card_mention", "body_payroll_mention", "reply_to_different_domain")
BEC_THRESHOLD = 0.3


def balanced(rows: DataFrame, label: str, weight: str = "weight") -> tuple[DataFrame, int]:
    """``rows`` with n / (classes * n of the class) as weight, and the number of rows."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row a class
    n = sum(counts.values())
    scale = F.coalesce(*(F.when(F.col(label) == k, F.lit(n / (len(counts) * c))) for k, c in counts.items()))
    return rows.withColumn(weight, scale), n


@dataclass
class ThreatModel:
    """A fitted pipeline, its classes in the order of the probabilities, and its numeric columns."""

    pipeline: PipelineModel
    classes: list[str]
    numbers: list[str]

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``p_<class>`` for each class and ``guess``, the first most probable one; missing columns count as 0 or empty."""
        out = self.pipeline.transform(_filled(rows, self.numbers))
        p = vector_to_array("probability")
        kept = out.select(*rows.columns, *(p[i].alias(f"p_{c}") for i, c in enumerate(self.classes)))
        return kept.withColumn("guess", sc.best_label({c: F.col(f"p_{c}") for c in self.classes}))

    def save(self, path: str) -> None:
        """The pipeline and, beside it, its metadata as JSON."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        meta = json.dumps({"classes": self.classes, "numbers": self.numbers})
        spark.createDataFrame([(meta,)], "value string").write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ThreatModel:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        return ThreatModel(PipelineModel.load(f"{path}/pipeline"), meta["classes"], meta["numbers"])


def _filled(rows: DataFrame, numbers: list[str]) -> DataFrame:
    body = F.coalesce(F.col("body"), F.lit("")) if "body" in rows.columns else F.lit("")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
    return rows.withColumns({"body": body, **{c: number(c) for c in numbers}})


def vocabulary(terms: DataFrame, n: int) -> list[str]:
    """The ``TERMS`` terms that occur most often in ``n`` rows ``terms(terms ARRAY<STRING>)``, of equal ones the first; without those of over ``MOST_TEXTS`` of the rows."""
    occurrences = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(False).alias("first")))
    texts = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(True).alias("first")))
    each = terms.select(F.explode(F.concat(occurrences, texts)).alias("x")).select("x.*")
    counts = each.groupBy("term").agg(F.count_if(~F.col("first")).alias("n"), F.count_if("first").alias("df")).filter(F.col("df") <= MOST_TEXTS * n)
    return [r.term for r in counts.orderBy(F.desc("n"), "term").limit(TERMS).collect()]


def fit(rows: DataFrame, label: str = "label", numbers: list[str] | None = None) -> ThreatModel:
    """I4: train on ``rows(body, label, numeric features)``; ham counts as benign."""
    text = F.lower(F.trim(F.col(label).cast("string")))
    named = rows.withColumn("class", F.when(text == "ham", "benign").otherwise(text)).filter("class IS NOT NULL")
    weighted, n = balanced(named, "class")
    numbers = numbers if numbers is not None else [c for c, t in rows.dtypes if t in ("double", "int", "bigint", "float") and c != label]
    indexer = StringIndexer(inputCol="class", outputCol="class_index", stringOrderType="alphabetAsc").fit(weighted)
    if len(indexer.labels) < 2:
        raise ValueError(f"training needs two classes, got {indexer.labels}")
    given = indexer.transform(_filled(weighted, numbers)).select("body", "class_index", "weight", *numbers)
    words = [
        RegexTokenizer(inputCol="body", outputCol="tokens", pattern=r"\b\w\w+\b", gaps=False), StopWordsRemover(inputCol="tokens", outputCol="words"), NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
    ]
    terms = PipelineModel(words).transform(given)
    words.append(CountVectorizerModel.from_vocabulary(vocabulary(terms.select("terms"), n), inputCol="terms", outputCol="counts"))
    # what the other stages read, so that texts aren't taken apart again for each of them
    counted = written(words[-1].transform(terms).select("counts", "class_index", "weight", *numbers), "term-counts")
    stages = [IDF(inputCol="counts", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="text_vector")]
    if numbers:
        stages += [VectorAssembler(inputCols=numbers, outputCol="numbers", handleInvalid="keep"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True), VectorAssembler(inputCols=["text_vector", "scaled"], outputCol="features")]
    else:
        stages += [VectorAssembler(inputCols=["text_vector"], outputCol="features")]
    stages.append(LogisticRegression(featuresCol="features", labelCol="class_index", weightCol="weight", family="multinomial", maxIter=100, regParam=1.0 / max(n, 1), standardization=False))
    return ThreatModel(PipelineModel([*words, *Pipeline(stages=stages).fit(counted).stages]), list(indexer.labels), numbers)


@dataclass
class BecModel:
    """A fitted pipeline, or none if there was only one class."""

    pipeline: PipelineModel | None

    def probabilities(self, rows: DataFrame, threshold: float = BEC_THRESHOLD) -> DataFrame:
        """``rows`` with ``p_bec`` and ``is_bec``; untrained, every probability is 0."""
        if self.pipeline is None:
            return rows.withColumns({"p_bec": F.lit(0.0), "is_bec": F.lit(False)})
        out = self.pipeline.transform(_filled(rows, list(BEC_FEATURES))).select(*rows.columns, vector_to_array("probability")[1].alias("p_bec"))
        return out.withColumn("is_bec", F.col("p_bec") >= threshold)


def fit_bec(rows: DataFrame, target: str = "is_target") -> BecModel:
    """Logistic regression on eleven columns; ``target`` is 0 or 1."""
    weighted, n = balanced(rows, target)
    if weighted.select(target).distinct().count() < 2:
        return BecModel(None)
    stages = [VectorAssembler(inputCols=list(BEC_FEATURES), outputCol="features", handleInvalid="keep"), LogisticRegression(labelCol=target, weightCol="weight", maxIter=500, regParam=1.0 / max(n, 1), standardization=False)]
    return BecModel(Pipeline(stages=stages).fit(_filled(weighted, list(BEC_FEATURES)).withColumn(target, F.col(target).cast("double")).select(target, "weight", *BEC_FEATURES)))


def training_rows(mails: DataFrame, label: str = "label") -> DataFrame:
    """I1/H: cleaned mails with ``body``, ``label``, ``key`` and all features, as a written table."""
    clean = ev.cleaned(mails, label)
    key = F.sha2(F.to_json(F.struct(*clean.columns)), 256).alias("key")
    with_text = clean.withColumn("key", key)
    keep = ["key", "body", label]
    table = feat.extract(with_text, *keep)
    return written(table, "training-rows")


def run_training(mails: DataFrame, path: str, label: str = "label") -> tuple[ThreatModel, DataFrame]:
    """Clean, extract, split, fit, save to ``path``, and evaluate: a row (part, n, accuracy, macro_f1, weighted_f1, roc_auc) for validation and test."""
    rows = written(ev.stratified_split(training_rows(mails, label), "key", label), "split-rows")  # each stage reads them
    numbers = [c for c in rows.columns if c not in ("key", "body", label, "split")]
    model = fit(rows.filter("split = 'train'").drop("key", "split"), label, numbers)
    model.save(path)
    parts = None
    for part in ("validation", "test"):
        scored = written(model.probabilities(rows.filter(F.col("split") == part)).select(label, "guess", *(f"p_{c}" for c in model.classes)), f"scored-{part}")
        averages = ev.averages(ev.multiclass_metrics(scored, label, "guess"))
        auc = ev.one_vs_rest_auc(scored, label, model.classes).agg(F.avg("roc_auc").alias("roc_auc"))
        row = averages.withColumns({"part": F.lit(part), "n": F.lit(scored.count()), "roc_auc": F.lit(auc.first()[0])})
        parts = row if parts is None else parts.unionByName(row)
    return model, parts.select("part", "n", "accuracy", "macro_f1", "weighted_f1", "roc_auc")


def unreadable(mails: DataFrame) -> Column:
    """Why a mail can't be scored: a numeric field that isn't a number, or an error of its own; else null."""
    faults = [F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), F.lit(f"{c} is not a number")) for c in feat.NUMBERS if c in mails.columns]
    own = [F.col("error")] if "error" in mails.columns else []
    return F.coalesce(*own, *faults, F.lit(None).cast("string"))


def predict(mails: DataFrame, *keep: str, model: ThreatModel | None = None, intel: dict[str, Column] | None = None) -> DataFrame:
    """``keep``, error and, for readable mails, the assessment (label, confidence, score, level, reasons); without a model the heuristic speaks.

    A bad mail has an error and no assessment; the others aren't touched by it.
    """
    marked = mails.withColumn("fault", unreadable(mails))
    table = feat.extract(marked, *keep, "fault", *(["body"] if model else []))
    p = {c: F.col(f"p_{c}") for c in (model.classes if model else sc.CLASSES)}
    scored = model.probabilities(table) if model else table.withColumns({f"p_{c}": e for c, e in sc.heuristic().items()})
    full = {c: p.get(c, F.lit(0.0)) for c in sc.CLASSES}
    judged = scored.withColumn("a", F.when(F.col("fault").isNull(), sc.assessment(full, intel=intel)))
    return judged.select(*keep, F.col("fault").alias("error"), *(F.col("a")[c].alias(c) for c in ("label", "confidence", "score", "level", "reasons")))


__all__ = ["BecModel", "ThreatModel", "fit", "fit_bec", "ml_rows", "predict", "run_training", "training_rows", "unreadable"]
