"""Intent classifiers."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from math import ceil

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgtriage.functions.text import contains_any, explode_structs, let, normalize_text, sql_string, tokenize
from msgtriage.operators.labeling import heuristic_intent
from msgtriage.operators.tfidf import PRODUCTION_CLASSIFIER, SIMPLE_CLASSIFIER, TfidfConfig, TfidfModel
from msgtriage.session import materialize, work_dir

MAX_CLASSES = 1_000
ROWS_PER_PART = 20_000
#: Above that, so many rows a part while there are cores for them.
ROWS_PER_CORE = 5_000
#: The largest derivative of the penalised mean loss that a fitted model may have; before a fit it is about 0.1.
GRADIENT = 1e-3

# Fixed values
DAMPING = 0.75
UNFITTED_CONFIDENCE = 0.50
CONFIDENCE_DIGITS = 4


def class_weights(labelled: DataFrame, label: str = "intent") -> DataFrame:
    """Balanced weights, rows / (classes * rows of the class)."""
    counts = labelled.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    # Both totals come from the small count table.
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    weight = totals.select(F.col("total") / F.col("classes")).scalar() / F.col("n")
    return counts.select(label, "n", weight.alias("weight"))


def majority_class(labelled: DataFrame, label: str = "intent") -> DataFrame:
    """The most frequent label; equal counts in label order."""
    counts = labelled.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(label)).limit(1)


@dataclass(frozen=True)
class Constant:
    """The same answer for every message."""

    intent: str
    confidence: float = 1.0

    def predict(self, df: DataFrame, text: str = "customer_text") -> DataFrame:
        return df.withColumn("intent", F.lit(self.intent)).withColumn(
            "confidence", F.lit(self.confidence)
        )


@dataclass(frozen=True)
class IntentSettings:
    features: TfidfConfig
    c: float
    max_iter: int


# Inverse regularisation strength and iteration limit.
SIMPLE = IntentSettings(SIMPLE_CLASSIFIER, 1.0, 1000)
PRODUCTION = IntentSettings(PRODUCTION_CLASSIFIER, 2.5, 1500)


@dataclass
class IntentModel:
    """TF-IDF features and a multinomial logistic regression."""

    tfidf: TfidfModel
    regression: LogisticRegressionModel
    labels: list[str]

    @staticmethod
    def fit(
        labelled: DataFrame, settings: IntentSettings = PRODUCTION, text: str = "customer_text",
        label: str = "intent",
    ) -> "IntentModel":
        """Balanced, L2-penalised fit.

        The sum of balanced weights is the number of rows, so the penalty that
        corresponds to ``c`` is 1 / (c * rows).
        """
        # Read four times below; the plan that selects and cleans them runs once.
        rows = materialize(labelled.where(F.col(label).isNotNull()).select(
            normalize_text(text).alias("_clean"), F.col(label).alias("_label")
        ), "training")
        weights = class_weights(rows, "_label").orderBy("_label").limit(MAX_CLASSES + 1).collect()
        if not 2 <= len(weights) <= MAX_CLASSES:
            raise ValueError(f"a classifier needs 2 to {MAX_CLASSES} classes, not {len(weights)}")
        labels = [w["_label"] for w in weights]
        n_rows = sum(w["n"] for w in weights)
        tfidf = TfidfModel.fit(rows, "_clean", settings.features)
        # Labels and weights by position; at most MAX_CLASSES literals.
        position = F.array_position(F.array(*map(F.lit, labels)), F.col("_label"))
        row_weight = F.element_at(F.array(*[F.lit(w["weight"]) for w in weights]), position.cast("int"))
        features = tfidf.vectors(rows, "_clean").select(
            "features", (position - 1).cast("double").alias("label"), row_weight.alias("weight")
        )
        # Every iteration reads the features, so they are stored; in as few parts as
        # their number asks for, since a pass over a small set is mostly scheduling.
        cores = labelled.sparkSession.sparkContext.defaultParallelism
        parts = max(1, ceil(n_rows / ROWS_PER_PART))
        if parts > 1:
            parts = max(parts, min(cores, ceil(n_rows / ROWS_PER_CORE)))
        stored = materialize(features.repartition(parts), "features")
        regression = LogisticRegression(
            family="multinomial", regParam=1.0 / (settings.c * n_rows), elasticNetParam=0.0,
            standardization=False, maxIter=settings.max_iter, weightCol="weight",
        ).fit(stored)
        return IntentModel(tfidf, regression, labels)

    def predict(self, df: DataFrame, text: str = "customer_text") -> DataFrame:
        """The most probable label and its probability; narrow."""
        cleaned = df.withColumn("_clean", normalize_text(text))
        scored = self.regression.transform(self.tfidf.vectors(cleaned, "_clean", "features"))
        names = F.array(*map(F.lit, self.labels))
        best = let(
            vector_to_array("probability"),
            lambda p: F.struct(
                F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")).alias("intent"),
                F.array_max(p).alias("confidence"),
            ),
        )
        return scored.withColumn("_best", best).select(*df.columns, "_best.*")

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """``(intent, term, coefficient)``, read from the stored model; nothing passes the driver but labels."""
        path = f"{work_dir(spark)}/regression-{uuid.uuid4().hex}"
        self.regression.save(path)
        matrix = spark.read.parquet(f"{path}/data").select(F.unwrap_udt("coefficientMatrix").alias("m"))
        cells = matrix.select("m.numRows", "m.numCols", "m.isTransposed", F.posexplode("m.values").alias("at", "coefficient"))
        row = F.when(F.col("isTransposed"), F.floor(F.col("at") / F.col("numCols"))).otherwise(
            F.col("at") % F.col("numRows"))
        column = F.when(F.col("isTransposed"), F.col("at") % F.col("numCols")).otherwise(
            F.floor(F.col("at") / F.col("numRows")))
        names = F.array(*map(F.lit, self.labels))
        placed = cells.select(
            F.element_at(names, (row + 1).cast("int")).alias("intent"), column.cast("int").alias("term_id"), "coefficient")
        terms = self.tfidf.table(spark).select("term_id", "term")
        return placed.join(terms, "term_id").select("intent", "term", "coefficient")

    def certificate(
        self, labelled: DataFrame, text: str = "customer_text", label: str = "intent", tolerance: float = GRADIENT,
    ) -> DataFrame:
        """I8: ``(intent, n, gradient, converged)``, one row per class of the rows that the model was fitted on.

        ``gradient`` is the largest derivative of the penalised loss by a coefficient or the intercept of the
        class, summed over the rows in Spark from what the model predicts. The loss is convex, so a model with
        none above ``tolerance`` is the one that the fit looks for, whatever steps led to it.
        """
        spark = labelled.sparkSession
        rows = labelled.where(F.col(label).isNotNull()).select(
            normalize_text(text).alias("_clean"), F.col(label).alias("_label"))
        weights = materialize(class_weights(rows, "_label"), "class-weights")
        total = weights.agg(F.sum("n")).first()[0]
        scored = self.regression.transform(self.tfidf.as_vectors(self.tfidf.transform(rows, "_clean", "_x"), "_x"))
        pulls = F.zip_with(
            F.array(*map(F.lit, self.labels)), vector_to_array("probability"),
            lambda name, p: F.col("weight") * (p - (name == F.col("_label")).cast("double")) / total)
        # The intercept is a term that every row has once.
        terms = F.concat(
            F.array(F.struct(F.lit(-1).alias("term_id"), F.lit(1.0).alias("value"))),
            F.transform(F.arrays_zip("_x.indices", "_x.values"), lambda e: F.struct(
                e["indices"].alias("term_id"), e["values"].alias("value"))))
        pulled = scored.join(F.broadcast(weights.select("_label", "weight")), "_label").select(
            pulls.alias("pulls"), terms.alias("terms"))
        # A row per term of a text, with the sums of all classes beside each other.
        sums = pulled.select("pulls", F.inline("terms")).groupBy("term_id").agg(
            *[F.sum(F.get("pulls", F.lit(i)) * F.col("value")).alias(f"_{i}") for i in range(len(self.labels))])
        slopes = sums.select("term_id", F.inline(F.array(*[
            F.struct(F.lit(name).alias("intent"), F.col(f"_{i}").alias("slope")) for i, name in enumerate(self.labels)])))
        held = self.coefficients(spark).join(self.tfidf.table(spark).select("term", "term_id"), "term").select(
            "intent", "term_id", (F.col("coefficient") * self.regression.getOrDefault("regParam")).alias("penalty"))
        both = slopes.join(held, ["intent", "term_id"], "full_outer")
        size = F.abs(F.coalesce("slope", F.lit(0.0)) + F.coalesce("penalty", F.lit(0.0)))
        steepest = both.groupBy("intent").agg(F.max(size).alias("gradient"))
        return steepest.join(weights.select(F.col("_label").alias("intent"), "n"), "intent").select(
            "intent", "n", "gradient", (F.col("gradient") <= tolerance).alias("converged"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.tfidf.save(spark, f"{path}/tfidf")
        self.regression.write().overwrite().save(f"{path}/regression")
        spark.createDataFrame([(self.labels,)], "labels array<string>").coalesce(1).write.mode(
            "overwrite").json(f"{path}/labels")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IntentModel":
        labels = spark.read.schema("labels array<string>").json(f"{path}/labels").first()["labels"]
        return IntentModel(
            TfidfModel.load(spark, f"{path}/tfidf"),
            LogisticRegressionModel.load(f"{path}/regression"), list(labels),
        )


@dataclass(frozen=True)
class LinearWeights:
    """I9 with a given weight table: word counts times weights, plus bias, then softmax.

    The table is configuration, a few words per label, and becomes literals, so
    scoring stays inside the row.
    """

    weights: Mapping[str, Mapping[str, float]]
    bias: Mapping[str, float] = field(default_factory=dict)

    def scores(self, padded: str) -> Column:
        """One (label, score) entry per label, in label order."""
        def score(label: str) -> str:
            total = f"{float(self.bias.get(label, 0.0))}D"
            for term, weight in self.weights[label].items():
                spaced = sql_string(f" {term} ")
                rest = f"char_length(replace(`{padded}`, {spaced}, ''))"
                hits = f"((char_length(`{padded}`) - {rest}) / {len(term) + 2}D)"
                total += f" + {hits} * {float(weight)}D"
            return f"named_struct('label', {sql_string(label)}, 'score', {total})"

        return F.expr(f"array({', '.join(score(label) for label in sorted(self.weights))})")

    def probabilities(self, df: DataFrame, text: str, key: str) -> DataFrame:
        """One row per message and label."""
        return explode_structs(self._scored(df, text), [key], F.col("_p"))

    def _scored(self, df: DataFrame, text: str) -> DataFrame:
        # Words separated by two spaces, so that neighbours can match one after the other.
        padded = F.concat(F.lit(" "), F.array_join(tokenize(text), "  "), F.lit(" "))
        staged = df.withColumn("_padded", padded)
        staged = staged.withColumn("_s", self.scores("_padded"))
        top = F.array_max(F.transform("_s", lambda s: s["score"]))
        powers = let(top, lambda m: F.transform("_s", lambda s: F.exp(s["score"] - m)))
        shares = let(powers, lambda e: let(
            F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v),
            lambda total: F.transform(e, lambda v: v / total),
        ))
        entries = F.zip_with("_s", shares, lambda s, p: F.struct(
            s["label"].alias("label"), s["score"].alias("score"), p.alias("probability")
        ))
        return staged.withColumn("_p", entries).drop("_padded", "_s")

    def predict(self, df: DataFrame, text: str = "customer_text") -> DataFrame:
        """The most probable label; equal probabilities in label order."""
        best = F.reduce(
            F.slice("_p", 2, len(self.weights)), F.element_at("_p", 1),
            lambda acc, p: F.when(p["probability"] > acc["probability"], p).otherwise(acc),
        )
        scored = self._scored(df, text).withColumn("_b", best)
        return scored.select(
            *df.columns, F.col("_b.label").alias("intent"), F.col("_b.probability").alias("confidence")
        )


def damp_confidence(
    intent: Column, confidence: Column, text: Column, label: str, terms: tuple[str, ...],
    factor: float = DAMPING,
) -> Column:
    """A sensitive label without any of its terms in the text counts less."""
    doubtful = (intent == label) & ~contains_any(F.lower(text), terms)
    return F.when(doubtful, confidence * factor).otherwise(confidence)


def production_intent(
    messages: DataFrame, model, phrases, out_of_scope, fragment_label: str,
    out_of_scope_label: str, damped_label: str, damped_terms, fallback: str,
    text: str = "customer_text",
) -> DataFrame:
    """Heuristics first, else the model with damping (I10), else the fallback."""
    predictor = Constant(fallback, UNFITTED_CONFIDENCE) if model is None else model
    predicted = predictor.predict(messages, text)
    if model is None:
        confidence = F.col("confidence")
    else:
        damped = damp_confidence(
            F.col("intent"), F.col("confidence"), F.col(text), damped_label, tuple(damped_terms)
        )
        confidence = F.round(damped, CONFIDENCE_DIGITS)
    rule = heuristic_intent(F.col(text), phrases, out_of_scope, fragment_label, out_of_scope_label)
    chosen = F.coalesce(rule, F.struct(F.col("intent"), confidence.alias("confidence")))
    return predicted.withColumn("_chosen", chosen).select(*messages.columns, "_chosen.*")
