"""TF-IDF vocabulary and weights.

The vocabulary of a classifier has at most ``max_features`` terms, so it is the one
thing that may travel to the driver. Documents never do: they are counted by one
aggregation on terms with partial sums, and weighted row by row without any shuffle.
Which terms are the most frequent is told from the number of terms of each count, so
no task ever holds the vocabulary. The search has no bound on its terms and keeps
them in tables (``retrieval``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import (
    CountVectorizer, CountVectorizerModel, ElementwiseProduct, StopWordsRemover,
)
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T

from msgtriage.functions.text import (
    HYPHEN_WORD, LONG_WORD, explode_structs, let, ngrams, remove_stop_words, tokenize,
)
from msgtriage.operators.limits import first_n
from msgtriage.session import materialize

MAX_VOCABULARY = 100_000
#: Bytes of the texts whose terms a task counts at a time, about.
COUNTED = 8_000_000


@dataclass(frozen=True)
class TfidfConfig:
    low: int = 1
    high: int = 1
    max_features: int | None = None
    sublinear: bool = False
    pattern: str = LONG_WORD
    stop_words: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.max_features is not None and not 0 < self.max_features <= MAX_VOCABULARY:
            raise ValueError(f"max_features must be between 1 and {MAX_VOCABULARY}, or none")

    def tokens(self, text: Column) -> Column:
        return remove_stop_words(tokenize(text, self.pattern), self.stop_words)

    def terms(self, text: Column) -> Column:
        return ngrams(self.tokens(text), self.low, self.high) if self.high > 1 else self.tokens(text)


# The three feature settings.
SIMPLE_CLASSIFIER = TfidfConfig(1, 2, 5_000)
PRODUCTION_CLASSIFIER = TfidfConfig(1, 3, 12_000, sublinear=True, pattern=HYPHEN_WORD)


def retriever_config(stop_words: tuple[str, ...] | None = None) -> TfidfConfig:
    """Settings of the case search, with every term; Spark's English list stands in for the stop words."""
    if stop_words is None:
        stop_words = tuple(StopWordsRemover.loadDefaultStopWords("english"))
    return TfidfConfig(1, 2, sublinear=True, stop_words=stop_words)


def term_counts(df: DataFrame, text: str, config: TfidfConfig) -> DataFrame:
    """Occurrences ``cf`` and documents ``df`` of every term, in one shuffle.

    Each row emits its terms once for the occurrences and its distinct terms once
    for the documents; both sums are combined before the shuffle, so a term in a
    third of all documents costs one row per partition.
    """
    def marked(terms: Column, cf: int, docs: int) -> Column:
        return F.transform(
            terms,
            lambda t: F.struct(t.alias("term"), F.lit(cf).alias("cf"), F.lit(docs).alias("df")),
        )

    emitted = let(
        config.terms(F.col(text)),
        lambda t: F.concat(marked(t, 1, 0), marked(F.array_distinct(t), 0, 1)),
    )
    return explode_structs(df, [], emitted).groupBy("term").agg(
        F.sum("cf").alias("cf"), F.sum("df").alias("df")
    )


def frequent_counts(df: DataFrame, text: str, config: TfidfConfig) -> DataFrame:
    """``term_counts`` of all terms that can be among the ``max_features`` most frequent, and of some others.

    A term occurs at most as often as the terms of one word less that it starts and ends
    with. So of each length only terms are counted whose parts reach the last count that
    was in so far; the others would not be in. Most terms occur once, and are not counted.
    """
    tokens = materialize(df.select(config.tokens(F.col(text)).alias("tokens")), "tokens")
    counts, least, shorter = None, 0, None
    for n in range(config.low, config.high + 1):
        listed = term_counts_of(tokens, n, shorter)
        longer = materialize(listed, "term-counts")
        counts = longer if counts is None else counts.unionByName(longer)
        cut = _cut(counts, config.max_features)
        least = 0 if cut is None else cut["cf"]
        counts = counts.where(F.col("cf") >= least)
        # Stored, so that the planner knows how few they are.
        few = longer.where(F.col("cf") >= least).select("term")
        shorter = materialize(few, "frequent-terms") if least > 1 and n < config.high else None
    return counts


def term_counts_of(tokens: DataFrame, n: int, shorter: DataFrame | None) -> DataFrame:
    """``term_counts`` of the terms of ``n`` words; if ``shorter`` is given, of those with both parts in it.

    Terms are counted where their texts are, in numpy, so a row that is joined and moved is no single occurrence.
    """
    # Words hold no space.
    found = tokens.select(F.array_join("tokens", " ")).mapInArrow(_counted(n), "term string, cf long, df long")
    if shorter is not None:
        parts = {"_first": F.substring_index("term", " ", n - 1), "_last": F.substring_index("term", " ", 1 - n)}
        for name, part in parts.items():
            found = found.withColumn(name, part).join(shorter.withColumnRenamed("term", name), name, "left_semi").drop(name)
    return found.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _counted(n: int):
    """``term, cf, df`` of the terms of ``n`` words in a few texts at a time, a row for each."""
    def counts(texts: pa.Array) -> pa.RecordBatch:
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        codes, names = words.indices.to_numpy(), words.dictionary
        text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        starts = np.flatnonzero(text[:max(len(text) - n + 1, 0)] == text[n - 1:])
        gram = codes[starts].astype("int64")
        for i in range(1, n):
            gram = np.unique(gram * len(names) + codes[starts + i], return_inverse=True)[1]
        _, first, gram, cf = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
        df = np.bincount(np.unique(text[starts] * len(cf) + gram) % max(len(cf), 1), minlength=len(cf))
        parts = [names.take(pa.array(codes[starts[first] + i])) for i in range(n)]
        term = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
        return pa.record_batch([term, pa.array(cf, "int64"), pa.array(df, "int64")], ["term", "cf", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast("string")
            texts = texts.filter(pc.not_equal(texts, ""))
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < len(texts):
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + COUNTED, "right")))
                yield counts(texts.slice(begin, end - begin))
                begin = end

    return run


def idf_of(df: Column, n_docs: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((n_docs + 1.0) / (df + 1.0)) + 1.0


def counts_by_row(df: DataFrame, key: str, text: str, config: TfidfConfig) -> DataFrame:
    """``(key, term, tf)``, one row per term of a key. Texts move to the task of their key, since terms are far more."""
    listed = df.select(key, text).repartition(key).select(key, F.explode(config.terms(F.col(text))).alias("term"))
    return listed.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of ``counts`` with the largest ``cf``; equal counts in term order.

    The numbers of terms of each count, of which there are few, tell the last count that is
    taken whole and how many terms of the next one are; only those are compared by name.
    """
    counts = materialize(counts, "term-counts")
    cut = _cut(counts, n)
    if cut is None:
        return counts
    whole = counts.where(F.col("cf") > cut["cf"])
    last = counts.where(F.col("cf") == cut["cf"])
    return whole.unionByName(first_n(last, "term", n - (cut["upto"] - cut["n"])))


def _cut(counts: DataFrame, n: int) -> Row | None:
    """The count of the ``n``-th term, how many terms have it (``n``), and how many have it or more (``upto``)."""
    down = Window.orderBy(F.desc("cf"))
    sizes = counts.groupBy("cf").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(down))
    return sizes.where(F.col("upto") >= n).orderBy(F.desc("cf")).limit(1).first()


def vocabulary(df: DataFrame, text: str, config: TfidfConfig) -> DataFrame:
    """The most frequent terms in order; equal counts in term order; at most ``max_features`` rows, if it is given."""
    if config.max_features is None:
        counts = term_counts(df, text, config)
    elif config.high > config.low:
        counts = most_frequent(frequent_counts(df, text, config), config.max_features)
    else:
        counts = most_frequent(term_counts(df, text, config), config.max_features)
    return counts.orderBy(F.desc("cf"), F.asc("term"))


@dataclass
class TfidfModel:
    """A fitted vocabulary; the position in ``terms`` is the term's id."""

    config: TfidfConfig
    terms: list[str]
    idf: list[float]
    n_docs: int
    counts: CountVectorizerModel | None = field(repr=False, compare=False)

    @staticmethod
    def fit(df: DataFrame, text: str, config: TfidfConfig) -> "TfidfModel":
        if config.max_features is None:
            raise ValueError("a fitted vocabulary travels with the plan, so it needs max_features")
        rows = vocabulary(df, text, config).collect()  # at most max_features rows
        n_docs = df.count()
        idf = {r["term"]: log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0 for r in rows}
        if not idf:
            return TfidfModel(config, [], [], n_docs, None)
        # The vocabulary is chosen above; the ML stage is fitted on it alone, to count inside rows.
        listed = df.sparkSession.createDataFrame([([t],) for t in idf], "_terms array<string>")
        counts = CountVectorizer(vocabSize=len(idf), inputCol="_terms", outputCol="_tf").fit(listed)
        terms = counts.vocabulary
        return TfidfModel(config, terms, [idf[t] for t in terms], n_docs, counts)

    def table(self, spark: SparkSession) -> DataFrame:
        """``(term_id, term, idf)``, bounded by ``max_features``."""
        rows = [(i, t, w) for i, (t, w) in enumerate(zip(self.terms, self.idf))]
        return spark.createDataFrame(rows, "term_id int, term string, idf double")

    def transform(self, df: DataFrame, text: str, output: str = "tfidf") -> DataFrame:
        """Add a struct (indices, values) with the L2-normalised weights of each row.

        Narrow: counting, weighting and scaling all happen inside the row. Unknown
        terms are ignored and an empty text has no entries.
        """
        if not self.terms:
            empty = "struct<indices:array<int>,values:array<double>>"
            return df.withColumn(
                output, F.struct(F.array().alias("indices"), F.array().alias("values")).cast(empty)
            )
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_tfidf"
        )
        listed = df.withColumn("_terms", self.config.terms(F.col(text)))
        scaled = scale.transform(self.counts.transform(listed))
        # The vectors are opened to arrays; tf * idf / tf gives back the idf of each entry.
        opened = scaled.withColumn("_tf", F.unwrap_udt("_tf")).withColumn("_tfidf", F.unwrap_udt("_tfidf"))
        if self.config.sublinear:
            raw = F.zip_with("_tf.values", "_tfidf.values", lambda tf, w: (1.0 + F.log(tf)) * w / tf)
        else:
            raw = F.col("_tfidf.values")

        def normalised(values: Column) -> Column:
            norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v))
            return let(norm, lambda n: F.transform(values, lambda v: v / n))

        weights = let(raw, normalised)
        return opened.withColumn(
            output, F.struct(F.col("_tf.indices").alias("indices"), weights.alias("values"))
        ).drop("_terms", "_tf", "_tfidf")

    def postings(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """``(key, term_id, weight)``, one row per entry."""
        return explode_vectors(self.transform(df.select(key, text), text), key)

    def weights(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """``(key, term, weight)``; the vocabulary is bounded, so its join is a broadcast."""
        names = F.broadcast(self.table(df.sparkSession).select("term_id", "term"))
        return self.postings(df, key, text).join(names, "term_id").select(key, "term", "weight")

    def vectors(self, df: DataFrame, text: str, output: str = "features") -> DataFrame:
        """ML vectors for the classifier, built inside the JVM."""
        return self.as_vectors(self.transform(df, text, "_w"), "_w", output).drop("_w")

    def as_vectors(self, weighted: DataFrame, weights: str, output: str = "features") -> DataFrame:
        """The same from a column of weights that is there."""
        as_vector = F.to_json(F.struct(F.struct(
            F.lit(0).alias("type"), F.lit(len(self.terms)).alias("size"),
            F.col(f"{weights}.indices").alias("indices"), F.col(f"{weights}.values").alias("values"),
        ).alias("v")))
        shape = T.StructType([T.StructField("v", VectorUDT())])
        return weighted.withColumn(output, F.from_json(as_vector, shape).getField("v"))

    def save(self, spark: SparkSession, path: str) -> None:
        """The vocabulary as a small table, the settings and the counting stage as its siblings."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")
        save_config(spark, self.config, f"{path}/settings")
        spark.createDataFrame([(self.n_docs,)], "n_docs long").coalesce(1).write.mode("overwrite").json(f"{path}/size")
        if self.counts is not None:
            self.counts.write().overwrite().save(f"{path}/counts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TfidfModel":
        rows = spark.read.parquet(f"{path}/vocabulary").orderBy("term_id").collect()
        config, n_docs = load_config(spark, f"{path}/settings"), spark.read.json(f"{path}/size").first()["n_docs"]
        counts = CountVectorizerModel.load(f"{path}/counts") if rows else None
        return TfidfModel(
            config, [r["term"] for r in rows], [r["idf"] for r in rows], n_docs, counts)


_SETTINGS = "low int, high int, max_features int, sublinear boolean, pattern string, stop_words array<string>"


def save_config(spark: SparkSession, config: TfidfConfig, path: str) -> None:
    c = config
    row = [(c.low, c.high, c.max_features, c.sublinear, c.pattern, list(c.stop_words))]
    spark.createDataFrame(row, _SETTINGS).coalesce(1).write.mode("overwrite").json(path)


def load_config(spark: SparkSession, path: str) -> TfidfConfig:
    s = spark.read.schema(_SETTINGS).json(path).first()
    return TfidfConfig(s["low"], s["high"], s["max_features"], s["sublinear"], s["pattern"], tuple(s["stop_words"]))


def explode_vectors(df: DataFrame, key: str, vector: str = "tfidf") -> DataFrame:
    entries = F.arrays_zip(
        F.col(f"{vector}.indices").alias("term_id"), F.col(f"{vector}.values").alias("weight")
    )
    return explode_structs(df, [key], entries).toDF(key, "term_id", "weight")
