"""Language-model scores by a log-bilinear model with noise-contrastive estimation.

A text is a sequence of words, lower-cased in A-Z, and one end token. The words
that occur most are classes of their own, ``CLASSES`` at most; all others share
one class, and inside it a word has its smoothed share of the counts. The model
predicts the class of a token from the two before it: their vectors, each through
a matrix of its position, add up to a predicted vector, whose products with the
vectors of all classes are the scores. It is estimated against noise drawn from
the unigram distribution, and normalised exactly when it scores: the normaliser
of a context is a batched matrix product over all classes, computed once per
context and task. A token's probability is that of its class, times, in the
shared class, that of the word. As in the unigram base, all unseen words share
one place.

Learning reads all training documents. Counts of words are summed in each task in
a table of bounded size before they are shuffled. The network starts from a few passes
over a bounded sample (``SAMPLE_DOCS``), then every task takes its own pass over
its training documents from there, and the results are averaged, weighted by
tokens, in two steps so that no task reads many. Scoring needs the count of every
word: the ``FREQUENT`` most frequent are sent to the workers (a size bounded by
the number and length of the keys), the rest are joined by word. As none of the
rest is frequent, no key of that join is hot.

A null text is an empty text, whose only token is the end. Rows that repeat are
scored and counted as often as they come. Words of more than ``KEY_LENGTH`` bytes
are known by a 128-bit digest.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from msgtriage.llm.common import bucket_of, materialize, text_or_empty, uniform_of

END = b""
KEY_LENGTH = 32
CLASSES = 512
FREQUENT = 200_000
DIMENSION = 16
NOISE = 64
BATCH = 512
RATE = 0.1
SAMPLE_DOCS = 1_000
SAMPLE_PASSES = 8
FLUSH = 200_000
SLICE_BYTES = 2 << 20
SEED = 1
ADD = 0.1


def words(raw: bytes) -> list[bytes]:
    """The keys of a text's words, then the end.

    Words are runs of bytes that are no ASCII white space, A-Z lower-cased; a long one is known by a digest.
    """
    found = raw.lower().split()
    if max(map(len, found), default=0) > KEY_LENGTH:
        found = [w if len(w) <= KEY_LENGTH else b"\x00" + hashlib.blake2b(w, digest_size=16).digest() for w in found]
    found.append(END)
    return found


def _slices(column: pa.Array) -> Iterator[tuple[slice, list[bytes]]]:
    """The texts of a column, about ``SLICE_BYTES`` at a time."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield slice(start, stop), column.slice(start, stop - start).to_pylist()
        start = stop


# --- counts ------------------------------------------------------------------

def count_words(rows: DataFrame) -> DataFrame:
    """word, n_train, n_all over all rows (text binary, train boolean)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {True: Counter(), False: Counter()}

        def flush() -> Iterator[pa.RecordBatch]:
            for train, table in tables.items():
                if table:
                    n = pa.array(table.values(), pa.int64())
                    zero = pa.array(np.zeros(len(table), np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(table.keys(), pa.binary()), n if train else zero, n],
                        names=["word", "n_train", "n_all"])
                table.clear()

        for batch in batches:
            for text, train in zip(batch.column(0), batch.column(1).to_pylist()):
                table = tables[train]
                table.update(words(text.as_py()))
                if len(table) >= FLUSH:
                    yield from flush()
        yield from flush()

    return rows.select("text", "train").mapInArrow(count, "word binary, n_train long, n_all long").groupBy("word").agg(
        F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


@dataclass(frozen=True)
class Counts:
    """What the corpus tells: totals, and the frequent words in order."""

    total: int
    distinct: int
    words: list[bytes]
    n_train: np.ndarray

    @staticmethod
    def of(table: DataFrame, frequent: int) -> Counts:
        """``table`` is stored. The cut between frequent and rare comes from a histogram on a log scale."""
        total, distinct = table.agg(F.sum("n_train"), F.count(F.when(F.col("n_train") > 0, 1))).first()
        step = F.floor(F.log2("n_all") * 8)
        shape = table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
        cut, taken = None, 0
        for row in shape:
            taken += row["count"]
            if taken > frequent:
                break
            cut = row["step"]
        if cut is None:
            return Counts(total or 0, distinct, [], np.zeros(0, np.int64))
        top = table.where(step >= cut).select("word", "n_train").toPandas()
        top["word"] = top["word"].map(bytes)
        top = top.sort_values(["n_train", "word"], ascending=[False, True], kind="stable")
        return Counts(total or 0, distinct, list(top["word"]), top["n_train"].to_numpy(np.int64))


# --- the network -------------------------------------------------------------

Weights = dict[str, np.ndarray]


class LogBilinear:
    """Classes 0..n-1 are words, class n all others; as context, n + 1 is what stands before the first token."""

    def __init__(self, share: np.ndarray, weights: Weights | None = None, memory: Weights | None = None):
        self.share = share  # of each class among the training tokens
        self.classes = len(share)
        self.start = self.classes
        rng = np.random.default_rng(SEED)
        d = DIMENSION
        self.w = weights or {
            "context": (rng.standard_normal((self.classes + 1, d)) * 0.1).astype(np.float32),
            "near": np.eye(d, dtype=np.float32),
            "far": (0.5 * np.eye(d)).astype(np.float32),
            "target": (rng.standard_normal((self.classes, d)) * 0.1).astype(np.float32),
            "bias": np.log(share).astype(np.float32),
        }
        #: Sums of squared gradients, by which steps shrink.
        self.memory = memory or {k: np.full(v.shape, 1e-6) for k, v in self.w.items()}

    def predicted(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        w = self.w
        return w["context"][near] @ w["near"] + w["context"][far] @ w["far"]

    def learn(self, near, far, target, weight, rng: np.random.Generator) -> None:
        """One step of Adagrad on the noise-contrastive loss of weighted examples; they share their noise."""
        w = self.w
        noise = rng.choice(self.classes, size=NOISE, p=self.share)
        log_noise = np.log(NOISE * self.share).astype(np.float32)
        r = self.predicted(near, far)
        real = np.einsum("ij,ij->i", r, w["target"][target]) + w["bias"][target] - log_noise[target]
        fake = r @ w["target"][noise].T + (w["bias"][noise] - log_noise[noise])
        scale = (weight / weight.sum()).astype(np.float32)
        g_real = (_sigmoid(real) - 1) * scale
        g_fake = _sigmoid(fake) * scale[:, None]
        d_r = g_real[:, None] * w["target"][target] + g_fake @ w["target"][noise]
        d_target = _scatter(target, g_real[:, None] * r, self.classes)
        np.add.at(d_target, noise, g_fake.T @ r)
        d_bias = np.bincount(target, g_real, self.classes)
        np.add.at(d_bias, noise, g_fake.sum(axis=0))
        d_context = _scatter(near, d_r @ w["near"].T, self.classes + 1)
        d_context += _scatter(far, d_r @ w["far"].T, self.classes + 1)
        grads = {"context": d_context, "near": w["context"][near].T @ d_r, "far": w["context"][far].T @ d_r,
                 "target": d_target, "bias": d_bias}
        for k, g in grads.items():
            self.memory[k] += g * g
            w[k] = (w[k] - RATE * g / np.sqrt(self.memory[k])).astype(np.float32)

    def pass_over(self, streams: Iterator[tuple], seed: int) -> int:
        """Learn from arrays of contexts and tokens, a slice of texts each; the number of tokens."""
        rng = np.random.default_rng((SEED, seed))
        tokens = 0
        for near, far, target in streams:
            tokens += len(target)
            base = self.classes + 1
            code, count = np.unique((far * base + near) * base + target, return_counts=True)
            order = rng.permutation(len(code))
            for at in range(0, len(order), BATCH):
                pick = order[at:at + BATCH]
                c = code[pick]
                self.learn(c // base % base, c // (base * base), c % base, count[pick], rng)
        return tokens

    def log_probabilities(self, near: np.ndarray, far: np.ndarray, target: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Natural logarithms of the normalised probabilities; ``known`` keeps the normaliser of every context."""
        base = self.classes + 1
        code = far * base + near
        new = np.unique(code[np.isnan(known[code])])
        for at in range(0, len(new), 2048):
            part = new[at:at + 2048]
            scores = self.predicted(part % base, part // base) @ self.w["target"].T + self.w["bias"]
            top = scores.max(axis=1)
            known[part] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1, dtype=np.float64))
        r = self.predicted(near, far)
        score = np.einsum("ij,ij->i", r, self.w["target"][target]) + self.w["bias"][target]
        return score.astype(np.float64) - known[code]

    def normalisers(self) -> np.ndarray:
        return np.full((self.classes + 1) ** 2, np.nan)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    return np.stack([np.bincount(rows, values[:, j], n) for j in range(values.shape[1])], axis=1)


def contexts(classes: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: the token before, the one before that, the token."""
    near, far = np.empty_like(classes), np.empty_like(classes)
    near[1:], far[2:] = classes[:-1], classes[:-2]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    near[first] = start
    far[first] = start
    second = first[lengths > 1] + 1
    far[second] = start
    return near, far, classes


def streams(column: pa.Array, number: dict[bytes, int], rare: int, start: int) -> Iterator[tuple]:
    """Contexts and tokens of texts, a slice at a time; ``number`` gives the class of a word."""
    find = number.get
    for _, texts in _slices(column):
        split = [words(t) for t in texts]
        lengths = np.array([len(p) for p in split])
        flat = np.fromiter((find(w, rare) for p in split for w in p), np.int64, int(lengths.sum()))
        yield contexts(flat, lengths, start)


# --- learning and scoring over tables ---------------------------------------

@dataclass(frozen=True)
class LanguageModel:
    counts: Counts
    classes: int
    rare_total: int
    rare_distinct: int
    network: LogBilinear
    table: DataFrame

    @staticmethod
    def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", train=None, *,
            classes: int = CLASSES, frequent: int = FREQUENT) -> LanguageModel:
        """Learn from the rows of ``docs`` for which the condition ``train`` holds (all, if none is given)."""
        train = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
        rows = docs.select(F.col(id_column).cast("string").alias("id"),
                           text_or_empty(text_column).cast("binary").alias("text"), train.alias("train"))
        table = materialize(count_words(rows), "word-counts")
        counts = Counts.of(table, frequent)
        n = min(classes, int((counts.n_train > 0).sum()))
        inside = int(counts.n_train[:n].sum())
        share = np.append(counts.n_train[:n], counts.total - inside) + ADD
        network = LogBilinear(share / share.sum())
        model = LanguageModel(counts, n, counts.total - inside, counts.distinct - n, network, table)
        if counts.total:
            model._learn(rows.where("train"))
        return model

    def _learn(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        number = {w: i for i, w in enumerate(self.counts.words[:self.classes])}
        documents = max(1, rows.count())
        sample = rows.where(uniform_of(F.col("id"), seed=SEED) < SAMPLE_DOCS / documents).select("text").toPandas()
        texts = pa.array(sorted(map(bytes, sample["text"])), pa.binary())
        for i in range(SAMPLE_PASSES if len(texts) else 0):
            self.network.pass_over(streams(texts, number, self.classes, self.network.start), i)
        shapes = [(k, v.shape) for k, v in sorted(self.network.w.items())]
        shared = spark.sparkContext.broadcast(
            (self.network.share, self.network.w, self.network.memory, number))
        rare = self.classes

        def flat(weights: Weights) -> np.ndarray:
            return np.concatenate([weights[k].ravel() for k, _ in shapes]).astype(np.float64)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            share, start, memory, numbers = shared.value
            network = LogBilinear(share, *({k: v.copy() for k, v in x.items()} for x in (start, memory)))

            def all_streams() -> Iterator:
                for batch in batches:
                    yield from streams(batch.column(0), numbers, rare, network.start)

            tokens = network.pass_over(all_streams(), SAMPLE_PASSES)
            if tokens:
                yield pa.RecordBatch.from_pydict(
                    {"tokens": [tokens], "weights": [(flat(network.w) * tokens).tobytes()]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tokens, total = 0, 0.0
            for batch in batches:
                for n, raw in zip(batch["tokens"], batch["weights"]):
                    tokens, total = tokens + int(n), total + np.frombuffer(raw)
            if tokens:
                yield pd.DataFrame({"tokens": [tokens], "weights": [total.tobytes()]})

        schema = "tokens long, weights binary"
        learnt = materialize(rows.select("text").mapInArrow(local, schema), "network")
        width = max(1, math.isqrt(learnt.count()))
        # A round robin, so each of the teams adds up about as many as there are teams.
        partial = learnt.repartition(width).mapInPandas(add, schema)
        tokens, total = 0, 0.0
        for row in partial.toLocalIterator():
            tokens, total = tokens + row["tokens"], total + np.frombuffer(row["weights"])
        if tokens:
            at = 0
            for k, shape in shapes:
                size = int(np.prod(shape))
                self.network.w[k] = (total[at:at + size] / tokens).reshape(shape).astype(np.float32)
                at += size

    def score(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
        spark = docs.sparkSession
        counts, n_classes, network = self.counts, self.classes, self.network
        shared = spark.sparkContext.broadcast((counts.words, counts.n_train, network.share, network.w))

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frequent, n_train, share, weights = shared.value
            model = LogBilinear(share, weights)
            number = {w: i for i, w in enumerate(frequent)}
            # One more entry, for words that are not frequent.
            logs = np.append(np.log10(n_train + ADD), 0.0)
            seen = np.append(n_train > 0, False)
            known = model.normalisers()
            other, find = len(frequent), number.get
            for batch in batches:
                ids = batch.column(0)
                for part, texts in _slices(batch.column(1)):
                    split = [words(t) for t in texts]
                    lengths = np.array([len(p) for p in split])
                    size = int(lengths.sum())
                    flat = np.fromiter((find(w, other) for p in split for w in p), np.int64, size)
                    owner = np.repeat(np.arange(len(split)), lengths)
                    near, far, target = contexts(np.minimum(flat, n_classes), lengths, model.start)
                    log_p = model.log_probabilities(near, far, target, known) / math.log(10)
                    rare = flat >= n_classes
                    rest: list[list[bytes]] = []
                    at = 0
                    for p in split:
                        where = np.flatnonzero(flat[at:at + len(p)] == other)
                        rest.append([p[i] for i in where.tolist()])
                        at += len(p)
                    n = len(split)
                    columns = [
                        ids[part.start:part.stop], pa.array(lengths), pa.array(np.bincount(owner, seen[flat], n).astype(np.int64)),
                        pa.array(np.bincount(owner, logs[flat], n)), pa.array(np.bincount(owner, log_p, n)),
                        pa.array(np.bincount(owner, rare * logs[flat], n)),
                        pa.array(np.bincount(owner, rare, n).astype(np.int64)), pa.array(rest, pa.list_(pa.binary())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=PART_NAMES)

        rows = docs.select(
            F.struct(F.monotonically_increasing_id().alias("tag"), F.col(id_column).cast("long").alias("id"))
            .alias("row"), text_or_empty(text_column).cast("binary").alias("text"))
        scored = materialize(rows.mapInArrow(parts, PART_SCHEMA), "scored")
        rest = scored.select(F.col("row.tag").alias("tag"), F.explode("rest").alias("word"))
        rare_counts = self.table.where("n_train > 0").select("word", "n_train")
        found = rest.join(rare_counts, "word", "left").groupBy("tag").agg(
            F.sum(F.log10(F.coalesce("n_train", F.lit(0)) + F.lit(ADD))).alias("rest_log"),
            F.count("n_train").alias("rest_known"))
        base_size = math.log10(counts.total + ADD * (counts.distinct + 1))
        rare_size = math.log10(self.rare_total + ADD * (self.rare_distinct + 1))
        more = F.coalesce("rest_log", F.lit(0.0))
        return scored.drop("rest").withColumn("tag", F.col("row.tag")).join(found, "tag", "left").select(
            F.col("row.id").alias("doc_id"), "n_tokens",
            (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
            F.lit(counts.total).cast("long").alias("train_tokens"),
            (F.col("base_log") + more - F.col("n_tokens") * F.lit(base_size)).alias("base_score"),
            (F.col("class_log") + F.col("rare_log") + more - F.col("n_rare") * F.lit(rare_size)).alias("score"),
        )


PART_NAMES = ["row", "n_tokens", "n_known", "base_log", "class_log", "rare_log", "n_rare", "rest"]
PART_SCHEMA = ("row struct<tag: long, id: long>, n_tokens long, n_known long, base_log double, class_log double, "
               "rare_log double, n_rare long, rest array<binary>")


def held_out(id_column: str = "doc_id"):
    return bucket_of(id_column, 10) == 0
