"""Case search by TF-IDF cosine over a stored index.

**Index.** Every term has a number, and a case is a row of term numbers and weights.
Counts of terms are kept as they were read: more cases are counted and appended, and
weights and norms, which every new case changes through the document frequencies,
follow from the counts without reading a text again.

**Search.** Nearly every message shares a term with nearly every case, so sums by
message and case are far larger than both tables. They never leave the task that makes
them: messages are dealt to groups of a bounded size, which a task holds, the terms of
the index and then the cases pass by each group, and only the ``k`` best cases of a
message in a block are handed on. What moves is each message once, as its words, and
the index once per group, as many groups in a round as there are cores, so that the copies
of one round alone lie on the disks. No row is ever made for a message and term. The result
is exact.

**Bounds.** ``candidates`` tells which pairs bounds would leave, from blocks of the
postings of a term with about the same count and norm. ``rank_cases`` doesn't use it:
joining single postings and grouping their sums costs more than the product.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from msgtriage.operators.pairs import PAIR_COLUMNS
from msgtriage.operators.tfidf import TfidfConfig, counts_by_row, idf_of, load_config, most_frequent, save_config
from msgtriage.session import materialize, shuffles_released, work_dir

SCORE_DIGITS = 6      # ranking precision; ties go to the lower case id
REPORTED_DIGITS = 4   # fixed value: precision of reported scores
CLASS_BASE = 3.0      # norms of one class differ by this factor at most
LEVEL_STEP = 1.0      # damped counts of one block differ by this at most
TOP_LEVEL = 15
PART = 100_000        # postings of a term and part, about
FIRST = 300           # postings of a message that are read for its lower bound, about
SCORED_FIRST = 4      # times k cases are scored for it
REST = 0.4
#: Postings of a message of which ``candidates`` gives all cases, without bounds.
WHOLE = 12_000
#: Sums in another order differ by less; scores are rounded to SCORE_DIGITS.
MARGIN = 2e-6
BLOCK = ("term", "norm_class", "level", "part")
CELL = ("doc_id", "term")
#: Bytes of the messages that a task holds, about.
HELD = 48_000_000
#: Words of them that are sorted at a time, about.
SORTED = 500_000
#: Entries of the cases that pass by them at a time, about.
ENTRIES = 2_000_000
#: Terms of the index that a row has on its way to the messages, about.
TERMS_A_ROW = 500
#: Products, and cells of message and case, that a task holds at a time, about.
AT_ONCE = 1_000_000
#: A term is multiplied as a dense column where so many of all pairs of message and case share it.
DENSE = 0.003
#: Cells of the dense columns of a block, at most.
COLUMNS = 8_000_000
#: Cases of a block whose scores tell a first lower bound.
TRIED = 1_024
#: Pairs that a task hands on at a time where all are asked for, about.
PAIRS = 1_000_000


@dataclass
class CaseIndex:
    """Term counts, weights and texts of the cases, ready for many searches."""

    path: str
    config: TfidfConfig
    version: int
    n_docs: int
    texts: DataFrame      # doc_id, historical_query, historical_resolution
    terms: DataFrame      # term, number, idf, df, parts
    vectors: DataFrame    # doc_id, norm, entries: number, damped, idf

    @property
    def weights(self) -> DataFrame:
        """``doc_id, term, weight`` and what ``postings`` needs."""
        flat = self.vectors.select("doc_id", "norm", F.size("entries").alias("n_terms"), F.inline("entries"))
        return flat.join(self.terms.select("term", "number", "parts"), "number").select(
            "doc_id", "term", (F.col("damped") * F.col("idf") / F.col("norm")).alias("weight"),
            "norm", "damped", "parts", "n_terms")

    @property
    def postings(self) -> DataFrame:
        """``term, norm_class, level, part, doc_id, weight, n_terms``; a term that very many cases have is in parts."""
        level = F.least(F.floor((F.col("damped") - 1.0) / LEVEL_STEP), F.lit(TOP_LEVEL))
        return self.weights.select(
            "term", F.floor(F.log("norm") / log(CLASS_BASE)).cast("int").alias("norm_class"),
            level.cast("int").alias("level"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"),
            "doc_id", "weight", "n_terms")

    def blocks(self) -> DataFrame:
        """``term, idf, parts, blocks``: of each block its number of postings and the largest weight."""
        # What is unread of a term may be in any of its lower levels, so a block's bound is the largest of theirs.
        lower = Window.partitionBy("term", "norm_class").orderBy("level")
        sizes = self.postings.groupBy("term", "norm_class", "level").agg(
            F.count(F.lit(1)).alias("n"), F.max("weight").alias("top"))
        blocks = sizes.withColumn("top", F.max("top").over(lower)).withColumn(
            "step", F.col("top") - F.coalesce(F.lag("top").over(lower), F.lit(0.0)))
        listed = blocks.groupBy("term").agg(
            F.collect_list(F.struct("norm_class", "level", "n", "top", "step")).alias("blocks"))
        return self.terms.select("term", "idf", "parts").join(listed, "term")

    @staticmethod
    def build(
        corpus: DataFrame, config: TfidfConfig, key: str = PAIR_COLUMNS[0],
        text: str = "customer_text", resolution: str = "agent_text", path: str | None = None,
    ) -> "CaseIndex":
        """Count the terms of the corpus and weight them; the index lies in ``path``, or in the work folder."""
        spark = corpus.sparkSession
        path = path or f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
        save_config(spark, config, f"{path}/settings")
        with shuffles_released(spark):
            _count(corpus, config, key, text, resolution, path, "overwrite")
            return _weigh(spark, path, config, 0)

    def extend(
        self, more: DataFrame, key: str = PAIR_COLUMNS[0], text: str = "customer_text",
        resolution: str = "agent_text",
    ) -> "CaseIndex":
        """The index with further cases, whose keys must be new.

        Only their texts are read; the result equals one build over all cases.
        """
        spark = more.sparkSession
        with shuffles_released(spark):
            _count(more, self.config, key, text, resolution, self.path, "append")
            return _weigh(spark, self.path, self.config, self.version + 1)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "CaseIndex":
        v = spark.read.json(f"{path}/versions").orderBy(F.desc("version")).first()
        return _version(spark, path, load_config(spark, f"{path}/settings"), v["version"], v["n_docs"])


def _version(spark: SparkSession, path: str, config: TfidfConfig, version: int, n_docs: int) -> CaseIndex:
    at = f"{path}/version-{version}"
    return CaseIndex(path, config, version, n_docs, spark.read.parquet(f"{path}/texts"),
                     spark.read.parquet(f"{at}/terms"), spark.read.parquet(f"{at}/vectors"))


def _count(corpus: DataFrame, config: TfidfConfig, key: str, text: str, resolution: str, path: str, mode: str) -> None:
    """Store texts and term counts of cases; those without a text or a resolution are none."""
    usable = corpus.where(F.col(text).isNotNull() & F.col(resolution).isNotNull()).select(
        F.col(key).alias("doc_id"), F.col(text).alias("historical_query"),
        F.col(resolution).alias("historical_resolution"))
    segment = materialize(usable, "cases")
    segment.write.mode(mode).parquet(f"{path}/texts")
    counts = counts_by_row(segment, "doc_id", "historical_query", config)
    counts.write.mode(mode).parquet(f"{path}/counts")


def _weigh(spark: SparkSession, path: str, config: TfidfConfig, version: int) -> CaseIndex:
    """Terms and vectors from the counts, as a version of the index."""
    texts, counts = spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/counts")
    at = f"{path}/version-{version}"
    n_docs = texts.count()
    stats = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    if config.max_features is not None:
        stats = most_frequent(stats, config.max_features)
    # Numbers hold once they are stored.
    stats.select(
        "term", F.monotonically_increasing_id().alias("number"),
        idf_of(F.col("df"), F.lit(float(n_docs))).alias("idf"), "df",
        F.ceil(F.col("df") / F.lit(float(PART))).cast("int").alias("parts"),
    ).write.mode("overwrite").parquet(f"{at}/terms")
    known = spark.read.parquet(f"{at}/terms").select("term", "number", "idf")
    rows = _rows(counts, known, "doc_id", config)
    rows.write.mode("overwrite").parquet(f"{at}/vectors")
    spark.createDataFrame([(version, n_docs)], "version int, n_docs long").coalesce(
        1).write.mode("append" if version else "overwrite").json(f"{path}/versions")
    return _version(spark, path, config, version, n_docs)


def _rows(counts: DataFrame, known: DataFrame, key: str, config: TfidfConfig) -> DataFrame:
    """``key, norm, entries`` of the known terms. The terms of a text meet in one row, which the text bounds."""
    entry = F.struct("number", _damped(config).alias("damped"), "idf")
    rows = counts.join(known, "term").select(key, entry.alias("entry")).groupBy(key).agg(
        F.sort_array(F.collect_list("entry")).alias("entries"))
    norm = F.sqrt(F.aggregate("entries", F.lit(0.0), lambda s, e: s + F.pow(e["damped"] * e["idf"], F.lit(2.0))))
    return rows.withColumn("norm", norm)


def _damped(config: TfidfConfig) -> Column:
    return 1.0 + F.log("tf") if config.sublinear else F.col("tf").cast("double")


# --- search -----------------------------------------------------------------

def _keyed(queries: DataFrame, key: str, text: str) -> DataFrame:
    """``_q, _text``; a row without a key is an error."""
    no_id = F.raise_error(F.lit(f"a row has no {key}")).cast(queries.schema[key].dataType)
    return queries.select(F.coalesce(F.col(key), no_id).alias("_q"), F.col(text).alias("_text"))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Of all elements: the place of their row, and the elements."""
    lists = lists.combine_chunks()
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _found(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``values`` in the sorted ``among``, and which of them are there."""
    at = np.minimum(np.searchsorted(among, values), max(len(among) - 1, 0))
    return at, among[at] == values if len(among) else np.zeros(len(values), bool)


class _Messages:
    """The messages of a group, by the words that they have; the index's terms pass by and give weights.

    A term of several words is told by the place of the one word shorter term that it
    starts with and its last word, so all comparisons are exact and none is of long strings.
    """

    def __init__(self, texts: pa.Table, config: TfidfConfig) -> None:
        texts = texts.filter(pc.not_equal(texts["words"], ""))
        # Texts of the same key are one message, and lie side by side.
        keys = texts["_q"].combine_chunks().dictionary_encode()
        self.ids, self.config, of_text = keys.dictionary, config, keys.indices.to_numpy()
        order = np.argsort(of_text, kind="stable")
        text, words = _flat(pc.split_pattern(texts["words"].take(pa.array(order)), " "))
        text = text.astype("int32")
        words = words.dictionary_encode()
        self.words, code = words.dictionary, words.indices.to_numpy()
        message = of_text[order][text]
        del texts, words
        # A few whole messages at a time, since sorting takes many times the memory of what is sorted.
        firsts = np.flatnonzero(np.diff(message, prepend=-1))
        cuts = np.unique(firsts[np.searchsorted(firsts, np.arange(0, len(text), SORTED), "right") - 1]) if len(text) else []
        pieces = [slice(i, j) for i, j in zip(cuts, [*cuts[1:], len(text)])]
        starts, places = [np.arange(p.stop - p.start, dtype="int32") for p in pieces], [code[p] for p in pieces]
        self.grams, self.first, self.n_terms = [], {}, 0
        rows, terms, times = [], [], []
        for n in range(1, config.high + 1):
            size = len(self.words)
            if n > 1:
                grams = []
                for i, p in enumerate(pieces):
                    inside = text[p][:max(p.stop - p.start - n + 1, 0)] == text[p][n - 1:]
                    start = np.flatnonzero(inside).astype("int32")
                    # Of the one word shorter terms, those with a word after them.
                    place = places[i][np.searchsorted(starts[i], start)].astype("int64")
                    gram, place = np.unique(place * len(self.words) + code[p][start + n - 1], return_inverse=True)
                    grams.append(gram)
                    starts[i], places[i] = start, place.astype("int32")
                self.grams.append(np.unique(np.concatenate(grams)) if grams else np.zeros(0, "int64"))
                places = [np.searchsorted(self.grams[-1], g).astype("int32")[place] for g, place in zip(grams, places)]
                size = len(self.grams[-1])
            if n >= config.low:
                for p, start, place in zip(pieces, starts, places):
                    cell, tf = np.unique(message[p][start].astype("int64") * max(size, 1) + place, return_counts=True)
                    rows.append((cell // max(size, 1)).astype("int32"))
                    terms.append((cell % max(size, 1) + self.n_terms).astype("int32"))
                    times.append(tf.astype("int32"))
                self.first[n] = self.n_terms
                self.n_terms += size
        none = [np.zeros(0, "int32")]
        self.row, self.term, self.tf = (np.concatenate(x or none) for x in (rows, terms, times))
        self.number, self.idf = np.full(self.n_terms, -1), np.zeros(self.n_terms)
        # What the words took is of use to the JVM beside this process.
        del rows, terms, times, text, message, code, order, starts, places
        pa.default_memory_pool().release_unused()

    def meet(self, terms: pa.Table) -> None:
        """Terms of the index, each with its number and idf; any number of times."""
        _, names = _flat(pc.split_pattern(terms["terms"], "\n"))
        numbers, idf = (_flat(terms[c])[1].to_numpy() for c in ("numbers", "idfs"))
        term, words = _flat(pa.chunked_array([pc.split_pattern(names, " ")]))
        code = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype("int64")
        length = np.bincount(term, minlength=len(names))
        begin = np.cumsum(length) - length
        for n, first in self.first.items():
            at = np.flatnonzero(length == n)
            place = code[begin[at]]
            at, place = at[place >= 0], place[place >= 0]
            for i in range(1, n):
                last = code[begin[at] + i]
                place, there = _found(np.where(last < 0, -1, place * len(self.words) + last), self.grams[i - 1])
                at, place = at[there], place[there]
            self.number[first + place], self.idf[first + place] = numbers[at], idf[at]

    def settle(self) -> None:
        """When all terms have passed: the normalised weights of the known ones, by message."""
        held = np.flatnonzero(self.number[self.term] >= 0)
        held = held[np.lexsort((self.number[self.term[held]], self.row[held]))]
        self.row, term, tf = self.row[held], self.term[held], self.tf[held]
        del held
        raw = (1.0 + np.log(tf) if self.config.sublinear else tf.astype("double")) * self.idf[term]
        norm = np.sqrt(np.bincount(self.row, raw * raw, len(self.ids)))
        self.weights = raw / norm[self.row]
        # From now on a term is its place among the known ones.
        known = np.flatnonzero(self.number >= 0)
        known = known[np.argsort(self.number[known])]
        place = np.zeros(self.n_terms, "int32")
        place[known] = np.arange(len(known))
        self.term, self.number, self.idf = place[term], self.number[known], self.idf[known]
        # Entries lie by message, then term, so one is found by its key.
        self.key = self.row.astype("int64") * max(len(known), 1) + self.term
        self.best = None
        self.grams = self.words = self.tf = None


class _Block:
    """The cases of a block, as postings; places follow the case ids, so that of equal scores the first is the lower id."""

    def __init__(self, cases: pa.Table, messages: _Messages) -> None:
        cases = cases.take(pc.sort_indices(cases["doc_id"], null_placement="at_start"))
        self.ids, self.width, self.messages = cases["doc_id"].combine_chunks(), cases.num_rows, messages
        of_case, numbers = _flat(cases["numbers"])
        damped, norm = _flat(cases["damped"])[1].to_numpy(), cases["norm"].to_numpy()
        term, shared = _found(numbers.to_numpy(), messages.number)
        of_case, term = of_case[shared], term[shared]
        weights = damped[shared] * messages.idf[term] / norm[of_case]
        # The same entries by case, and by term.
        self.size = np.bincount(of_case, minlength=self.width)
        self.first_of_case = np.cumsum(self.size) - self.size
        self.terms, self.by_case = term.astype("int32"), weights
        order = np.argsort(term, kind="stable")
        self.of_case, self.weights = of_case[order], weights[order]
        self.times = np.bincount(term, minlength=len(messages.number))
        self.first = np.cumsum(self.times) - self.times
        self.products = np.bincount(messages.row, self.times[messages.term], len(messages.ids))

    def postings(self, low: int, high: int, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the entries ``low`` to ``high``: how many postings each has, and their places, one entry after the other."""
        n, first = self.times[term[low:high]], self.first[term[low:high]]
        place = np.arange(n.sum())
        place += np.repeat(first - (np.cumsum(n) - n), n)
        return n, place

    def sums(self, at_once: int):
        """For a few messages at a time: their first place, and the cosines with all cases, a row for each."""
        m = self.messages
        shared = self.times[m.term] > 0
        row, term, asked = m.row[shared], m.term[shared], m.weights[shared]
        products = np.bincount(row, self.times[term], len(m.ids)).astype("int64")
        for begin, end in self.turns(products, at_once):
            low, high = np.searchsorted(row, (begin, end))
            n, place = self.postings(low, high, term)
            cell = np.repeat((row[low:high].astype("int64") - begin) * self.width, n) + self.of_case[place]
            sums = np.bincount(cell, np.repeat(asked[low:high], n) * self.weights[place], (end - begin) * self.width)
            # Without products the counts are integers.
            yield begin, sums.astype("double", copy=False).reshape(end - begin, self.width)

    def turns(self, products: np.ndarray, at_once: int) -> Iterator[tuple[int, int]]:
        """The messages, as many at a time as have about so many products and cells, one at least."""
        ends, begin = np.cumsum(products), 0
        while begin < len(products):
            before = ends[begin - 1] if begin else 0
            end = int(np.searchsorted(ends, before + at_once, "right"))
            end = max(begin + 1, min(end, begin + at_once // max(self.width, 1)))
            yield begin, end
            begin = end

    def near_sums(self, at_once: int):
        """As ``sums``, in single precision, and how far a cosine is off at most, as a share of it.

        Terms that many messages and many cases have are a product of dense matrices; the others are
        added where both have them. All products are positive, so the error of a sum is a share of it.
        """
        m, width = self.messages, self.width
        worth = np.bincount(m.term, minlength=len(m.number)) * self.times.astype("double")
        dense = np.flatnonzero(worth > DENSE * len(m.ids) * width)
        dense = dense[np.argsort(-worth[dense], kind="stable")][:COLUMNS // max(width, 1)]
        column = np.full(len(m.number), -1)
        column[dense] = np.arange(len(dense))
        cases, of_case = np.zeros((len(dense), width), "float32"), np.repeat(np.arange(width), self.size)
        at = column[self.terms]
        cases[at[at >= 0], of_case[at >= 0]] = self.by_case[at >= 0]
        del of_case
        at = column[m.term]
        held = np.flatnonzero(at >= 0)
        held_row, held_at, held_weight = m.row[held], at[held], m.weights[held].astype("float32")
        rest = np.flatnonzero((at < 0) & (self.times[m.term] > 0))
        row, term, asked = m.row[rest], m.term[rest], m.weights[rest].astype("float32")
        del at, held, rest
        weights = self.weights.astype("float32")
        shared = min(self.size.max(initial=0), np.bincount(m.row, minlength=1).max())
        error = (shared + 8) * 2.0 ** -24
        for begin, end in self.turns(np.bincount(row, self.times[term], len(m.ids)).astype("int64"), at_once):
            low, high = np.searchsorted(held_row, (begin, end))
            asked_dense = np.zeros((end - begin, len(dense)), "float32")
            asked_dense[held_row[low:high] - begin, held_at[low:high]] = held_weight[low:high]
            block = asked_dense @ cases
            low, high = np.searchsorted(row, (begin, end))
            n, place = self.postings(low, high, term)
            cell = np.repeat((row[low:high].astype("int64") - begin) * width, n)
            cell += self.of_case[place]
            products = np.repeat(asked[low:high], n)
            products *= weights[place]
            np.add.at(block.reshape(-1), cell, products)
            yield begin, block, error

    def exact(self, row: np.ndarray, case: np.ndarray) -> np.ndarray:
        """The cosines of pairs, sorted by message, in double precision."""
        m, out, done = self.messages, np.zeros(len(row)), 0
        if not len(row) or not len(m.key):
            return out
        # Where a message has many pairs, all of its cosines take less.
        lowest, size = row[0], self.size[case]
        many = 4 * np.bincount(row - lowest, size) > self.products[lowest:row[-1] + 1] + self.width
        whole = many[row - lowest]
        for r in np.flatnonzero(many) + lowest:
            (begin, end), (low, high) = np.searchsorted(row, (r, r + 1)), np.searchsorted(m.row, (r, r + 1))
            n, place = self.postings(low, high, m.term)
            sums = np.bincount(self.of_case[place], np.repeat(m.weights[low:high], n) * self.weights[place], self.width)
            out[begin:end] = sums[case[begin:end]]
        few = np.flatnonzero(~whole)
        ends = np.cumsum(size[few])
        while done < len(few):
            # A few at a time.
            before = ends[done - 1] if done else 0
            to = max(done + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
            some = few[done:to]
            n = size[some]
            place = np.arange(n.sum()) + np.repeat(self.first_of_case[case[some]] - (np.cumsum(n) - n), n)
            key = np.repeat(row[some].astype("int64") * len(m.number), n) + self.terms[place]
            at, there = _found(key, m.key)
            pair = np.repeat(np.arange(len(some)), n)[there]
            out[some] = np.bincount(pair, m.weights[at[there]] * self.by_case[place[there]], len(some))
            done = to
        return out

    def pairs(self, rows: np.ndarray, columns: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        ids = self.messages.ids.take(pa.array(rows))
        return pa.record_batch([ids, self.ids.take(pa.array(columns)), pa.array(scores)], ["_q", "doc_id", "score"])


def _ranked(row: np.ndarray, column: np.ndarray, score: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by message, best first, of equal scores the lower place; and the ranks from 0 in it."""
    order = np.lexsort((column, -score, row))
    held = np.bincount(row, minlength=rows)
    return order, np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)


def _best_of_block(k: int, at_once: int) -> Callable[[_Block], Iterator[pa.RecordBatch]]:
    """The best ``k`` cases of each message in a block, without those that ``k`` cases of earlier blocks surpass.

    Sums in single precision tell which cases can be among them; those alone are summed up exactly.
    """
    def run(cases: _Block) -> Iterator[pa.RecordBatch]:
        m = cases.messages
        if m.best is None:
            m.best = np.zeros((len(m.ids), k))
        for begin, block, error in cases.near_sums(at_once):
            rows, spare = len(block), 1 - 2 * error
            best = m.best[begin:begin + rows]
            least = best[:, -1].copy()
            if k < min(block.shape[1], TRIED):
                tried = block[:, :TRIED]
                least = np.maximum(least, np.partition(tried, tried.shape[1] - k, axis=1)[:, tried.shape[1] - k])
            # Lower scores than the last are 0 at the precision of the ranking.
            least = np.maximum(least * spare - MARGIN, 0.1 * 10.0 ** -SCORE_DIGITS)
            row, column = np.divmod(np.flatnonzero(block >= least[:, None].astype("float32")), max(block.shape[1], 1))
            near = block[row, column].astype("double")
            order, rank = _ranked(row, column, near, rows)
            row, column, near = row[order], column[order], near[order]
            least[row[rank == k - 1]] = near[rank == k - 1] * spare - MARGIN
            kept = near >= least[row]
            row, column = row[kept], column[kept]
            score = np.round(cases.exact(row + begin, column), SCORE_DIGITS)
            order, rank = _ranked(row, column, score, rows)
            order, rank = order[rank < k], rank[rank < k]
            row, column, score = row[order], column[order], score[order]
            found = np.zeros((rows, k))
            found[row, rank] = score
            m.best[begin:begin + rows] = -np.sort(-np.concatenate([best, found], axis=1), axis=1)[:, :k]
            kept = (score > 0) & (score >= m.best[begin + row, -1])
            yield cases.pairs(row[kept] + begin, column[kept], score[kept])

    return run


def _all_of_block(at_once: int) -> Callable[[_Block], Iterator[pa.RecordBatch]]:
    def run(cases: _Block) -> Iterator[pa.RecordBatch]:
        for begin, block in cases.sums(at_once):
            row, column = np.nonzero(block)
            yield cases.pairs(row + begin, column, block[row, column])

    return run


MESSAGES, TERMS, CASES = range(3)


def _met(run: Callable[[_Block], Iterator[pa.RecordBatch]], config: TfidfConfig, entries: int):
    """``run`` over cells that come one after the other: messages are held, then terms and blocks of cases pass by."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
        for batch in batches:
            of_cell, kind = batch["_cell"].to_numpy(), batch["_kind"].to_numpy()
            cuts = np.flatnonzero((np.diff(of_cell) != 0) | (np.diff(kind) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if begin < end:
                    yield of_cell[begin], kind[begin], pa.Table.from_batches([batch.slice(begin, end - begin)])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in groupby(parts(batches), lambda part: part[0]):
            texts, messages, settled, cases, held = [], None, False, [], 0
            for _, kind, part in cell:
                if kind == MESSAGES:
                    texts.append(part.select(["_q", "words"]))
                    continue
                if texts:
                    messages, texts = _Messages(pa.concat_tables(texts), config), []
                if messages is None:
                    continue
                if kind == TERMS:
                    messages.meet(part)
                    continue
                if not settled:
                    messages.settle()
                    settled = True
                # Long batches are cut, so that a block has about as many entries as it may.
                ends = np.cumsum(pc.list_value_length(part["numbers"]).to_numpy())
                begin = 0
                while begin < part.num_rows:
                    before = ends[begin - 1] if begin else 0
                    end = max(begin + 1, int(np.searchsorted(ends, before + entries - held, "right")))
                    cases.append(part.slice(begin, end - begin).select(["doc_id", "norm", "numbers", "damped"]))
                    held, begin = held + int(ends[end - 1] - before), end
                    if held >= entries or begin < part.num_rows:
                        yield from run(_Block(pa.concat_tables(cases), messages))
                        cases, held = [], 0
            if cases:
                yield from run(_Block(pa.concat_tables(cases), messages))

    return cells


def _worded(queries: DataFrame, index: CaseIndex, key: str, text: str) -> DataFrame:
    """``_q, words``: the messages as the search moves them."""
    words = F.array_join(index.config.tokens(F.col("_text")), " ")
    return _keyed(queries, key, text).select("_q", words.alias("words"))


def _group_number(queries: DataFrame, text: str) -> int:
    """Groups of about ``HELD`` bytes of text; at least so many that all cores have some."""
    size = queries.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, -(-size // HELD), queries.sparkSession.sparkContext.defaultParallelism)


def _term_lists(index: CaseIndex) -> DataFrame:
    """``terms, numbers, idfs``: many terms to a row, since a row has a cost of its own."""
    lists = -(-index.terms.count() // TERMS_A_ROW)
    term = F.collect_list(F.struct("term", "number", "idf"))
    return index.terms.groupBy(F.pmod(F.xxhash64("term"), F.lit(max(1, lists))).alias("_list")).agg(term.alias("t")).select(
        F.array_join("t.term", "\n").alias("terms"), F.col("t.number").alias("numbers"), F.col("t.idf").alias("idfs"))


def _product(asked: DataFrame, groups: int, terms: DataFrame, index: CaseIndex, run) -> DataFrame:
    """``_q, doc_id, score``: ``run`` over every group of messages and block of cases.

    A task holds a group; the terms of the index and its cases, ``ENTRIES`` at a time, pass by.
    A message moves once, as its words, since its terms are many times larger. How many pairs
    there are doesn't matter: they leave a task as they are made.
    """
    spark, config = asked.sparkSession, index.config
    # One cell for each partition that they are dealt to by hash.
    numbers = spark.range(100 * groups).select(F.col("id").cast("int").alias("cell"))
    cells = [r["cell"] for r in numbers.groupBy(F.pmod(F.hash("cell"), F.lit(groups))).agg(F.min("cell").alias("cell")).collect()]
    every = F.explode(F.array(*map(F.lit, cells)))

    asked = asked.withColumn("_cell", F.get(F.array(*map(F.lit, cells)), F.pmod(F.xxhash64("_q"), F.lit(len(cells))).cast("int")))
    cases = index.vectors.select(
        "doc_id", "norm", F.col("entries.number").alias("numbers"), F.col("entries.damped").alias("damped"))
    sides = {MESSAGES: asked, TERMS: terms.withColumn("_cell", every), CASES: cases.withColumn("_cell", every)}
    dealt = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [side.withColumn("_kind", F.lit(kind)) for kind, side in sides.items()])
    dealt = dealt.repartition(groups, "_cell").sortWithinPartitions("_cell", "_kind")
    shape = asked.select("_q").schema.add(cases.schema["doc_id"]).add("score", "double")
    return dealt.mapInArrow(_met(run, config, ENTRIES), shape)


def _best_by_rounds(asked: DataFrame, groups: int, index: CaseIndex, k: int) -> DataFrame:
    """``_q, doc_id, score, rank`` of the ``k`` best cases; copies of the index lie on disk for as many groups as there are cores.

    One after the other, rounds of so many groups are searched and their few rows stored. A
    round's copies go when it is done, so that the disk grows with the index and the messages,
    not with their product.
    """
    spark, cores = asked.sparkSession, asked.sparkSession.sparkContext.defaultParallelism
    rounds, run = -(-groups // cores), _best_of_block(k, AT_ONCE)
    if rounds == 1:
        return _best(_product(asked, groups, _term_lists(index), index, run), k)
    path = f"{work_dir(spark)}/nearest-{uuid.uuid4().hex}"
    # The groups of a round follow from the remainder by the number of cores.
    turn = F.floor(F.pmod(F.xxhash64("_q"), F.lit(rounds * cores)) / F.lit(cores)).cast("int")
    with shuffles_released(spark):
        terms = materialize(_term_lists(index), "term-lists")
        dealt = materialize(asked.withColumn("_round", turn), "asked", "_round")
        for i in range(rounds):
            some = dealt.where(F.col("_round") == i).drop("_round")
            _best(_product(some, cores, terms, index, run), k).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@dataclass
class _Asked:
    """The messages as the search sees them, stored: their weights, and what the index knows of their terms."""

    weights: DataFrame   # _q, term, asked
    blocks: DataFrame    # of the message's terms: what each can add (gain), what reading it settles (step)
    index: CaseIndex

    @staticmethod
    def of(queries: DataFrame, index: CaseIndex, key: str, text: str) -> "_Asked":
        counts = materialize(counts_by_row(_keyed(queries, key, text), "_q", "_text", index.config), "asked-terms")
        known = materialize(index.blocks().join(counts.select("term").distinct(), "term"), "known-terms")
        raw = counts.join(known.select("term", "idf"), "term").select(
            "_q", "term", (_damped(index.config) * F.col("idf")).alias("raw"))
        message = Window.partitionBy("_q")
        norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(message))
        weights = raw.select("_q", "term", (F.col("raw") / norm).alias("asked"))
        weights = materialize(weights, "asked")
        listed = weights.join(known.select("term", "parts", "blocks"), "term").select(
            "_q", "term", "asked", "parts", F.inline("blocks"))
        blocks = listed.withColumn("gain", F.col("asked") * F.col("top")).withColumn(
            "step", F.col("asked") * F.col("step")).drop("top")
        return _Asked(weights, materialize(
            blocks.withColumn("whole", F.sum("n").over(message) <= WHOLE), "asked-blocks"), index)

    def whole(self) -> DataFrame:
        """``_q, doc_id, sum`` of all pairs of the messages that are read without bounds."""
        found = _every_part(self.blocks.where("whole")).join(self.index.postings, list(BLOCK))
        products = found.select("_q", "doc_id", (F.col("asked") * F.col("weight")).alias("product"))
        return products.repartition("_q").groupBy("_q", "doc_id").agg(F.sum("product").alias("sum"))

    def read(self, blocks: DataFrame, *kept: str) -> DataFrame:
        """Sums of products of the blocks by message and case; ``kept`` are equal for all blocks of a message and class."""
        found = blocks.join(self.index.postings, list(BLOCK))
        return found.groupBy("_q", "doc_id").agg(
            F.sum(F.col("asked") * F.col("weight")).alias("sum"), *[F.first(c).alias(c) for c in kept])

    def exact(self, pairs: DataFrame) -> DataFrame:
        """``_q, doc_id, score`` of stored pairs (``_q, doc_id``) from all their terms; pairs that share none have no row."""
        product = (F.col("asked") * F.col("weight")).alias("product")
        return pairs.select("_q", "doc_id").join(self.weights.select("_q", "term", "asked"), "_q").join(
            self.index.weights, list(CELL)).select("_q", "doc_id", product).groupBy("_q", "doc_id").agg(
            F.round(F.sum("product"), SCORE_DIGITS).alias("score"))


def _every_part(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _best(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Rank on the score, then the case id; pruned in each partition first."""
    order = Window.partitionBy("_q").orderBy(F.desc(score), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _lower_bounds(asked: _Asked, k: int) -> DataFrame:
    """``_q, bound``: the ``k``-th score among a few cases that are likely to be near."""
    by_gain = Window.partitionBy("_q").orderBy(F.desc("gain"), "term", "norm_class", "level")
    before = F.sum("n").over(by_gain.rowsBetween(Window.unboundedPreceding, -1))
    few = asked.blocks.where("not whole").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < FIRST)
    # One part of a term's cases will do; another one for each message.
    part = F.pmod(F.xxhash64("_q"), F.col("parts")).cast("int")
    likely = materialize(_best(asked.read(few.withColumn("part", part)), SCORED_FIRST * k, "sum"), "likely")
    scores = asked.exact(likely).groupBy("_q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    return scores.select("_q", F.get("s", F.lit(k - 1)).alias("bound"))


def _needed(asked: _Asked, bounds: DataFrame) -> DataFrame:
    """The blocks to read, each with the bound and the most that the other blocks of its class can add (``rest``)."""
    bound = F.greatest(F.coalesce("bound", F.lit(0.0)) - MARGIN, F.lit(0.0))
    every = asked.blocks.where("not whole").join(bounds, "_q", "left").withColumn("bound", bound)
    of_class = Window.partitionBy("_q", "norm_class")
    # Of a term, higher levels come first.
    in_turn = of_class.orderBy(F.desc("gain"), F.desc("level"), "term")
    every = every.withColumn("all", F.sum("step").over(of_class)).withColumn(
        "done", F.coalesce(F.sum("step").over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    reaches = (F.col("all") >= F.col("bound")) & (F.col("all") - F.col("done") >= REST * F.col("bound"))
    read = (F.col("bound") == 0) | reaches
    every = every.withColumn("read", read)
    rest = F.col("all") - F.sum(F.when(F.col("read"), F.col("step")).otherwise(0.0)).over(of_class)
    return every.withColumn("rest", rest).where("read")


def candidates(queries: DataFrame, index: CaseIndex, k: int, key: str = "id", text: str = "customer_text") -> DataFrame:
    """``(key, doc_id)`` of the pairs that can be among the ``k`` best by bounds, or all of messages with few postings."""
    asked = _Asked.of(queries, index, key, text)
    found = _candidates(asked, k).select("_q", "doc_id").unionByName(asked.whole().select("_q", "doc_id"))
    return found.withColumnRenamed("_q", key)


def _candidates(asked: _Asked, k: int) -> DataFrame:
    sums = asked.read(_every_part(_needed(asked, _lower_bounds(asked, k))), "rest", "bound")
    kept = sums.where(F.col("sum") + F.col("rest") >= F.col("bound")).select("_q", "doc_id")
    return materialize(kept, "candidates")


def scores(queries: DataFrame, index: CaseIndex, key: str = "id", text: str = "customer_text") -> DataFrame:
    """C4: ``(key, doc_id, score)`` of every pair that shares a term."""
    asked, groups = _worded(queries, index, key, text), _group_number(queries, text)
    found = _product(asked, groups, _term_lists(index), index, _all_of_block(PAIRS))
    return found.select(F.col("_q").alias(key), "doc_id", F.round("score", SCORE_DIGITS).alias("score"))


def rank_cases(
    queries: DataFrame, index: CaseIndex, k: int, key: str = "id", text: str = "customer_text",
) -> DataFrame:
    """``(key, doc_id, score, rank)`` of the ``k`` closest cases per message; exact.

    Keys are unique and not null. A message without a term of the index has no row.
    """
    best = _best_by_rounds(_worded(queries, index, key, text), _group_number(queries, text), index, k)
    return best.select(F.col("_q").alias(key), "doc_id", "score", "rank")


def retrieve(
    queries: DataFrame, index: CaseIndex, k: int, key: str = "id", text: str = "customer_text",
) -> DataFrame:
    """Each message with its list of cases, best first, and its top score.

    A message that shares no term with any case keeps an empty list and score 0. A case
    that is the best one of very many messages is a hot key of the join with the texts,
    which adaptive execution splits: both sides are plain tables there.
    """
    best = rank_cases(queries, index, k, key, text)
    case = F.struct(
        "rank", F.round("score", REPORTED_DIGITS).alias("similarity_score"), "doc_id",
        "historical_query", "historical_resolution",
    )
    # At most k cases per message reach this list.
    lists = best.join(index.texts, "doc_id").groupBy(key).agg(F.array_sort(F.collect_list(case)).alias("retrieved"))
    joined = queries.join(lists, key, "left")
    nothing = F.array().cast(lists.schema["retrieved"].dataType)
    found = joined.withColumn("retrieved", F.coalesce("retrieved", nothing))
    top = F.try_element_at("retrieved", F.lit(1)).getField("similarity_score")
    return found.withColumn("retrieval_score", F.coalesce(top, F.lit(0.0)))
