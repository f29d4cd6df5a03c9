"""Near duplicates by DartMinHash over word shingles.

Darts are thrown at the plane of weight and rank, element by element. Where an
element's darts land follows from hashes of the element alone, so an element
shared by two documents gets the same darts in both. A document keeps the darts
below the weight of their element; each dart names one of ``COORDINATES``
coordinates, and a coordinate keeps its earliest dart. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity.

A document does not look at every coordinate for every element. The darts of an
element come in order of rank, and a document of total weight w needs ranks up to
about (k ln k + 2k) / w only to have k coordinates filled, so it throws about
k ln k + 2k darts, however long it is. Should a coordinate stay empty, the document
throws darts up to twice the rank, until none is. Weights above 1 are cut into
the regions [0, 1), [1, 2), [2, 4), ...: one stream of darts each.

Elements are runs of five words (as in ``runs``; all words, if there are fewer) with
weight 1 each, or as many as they occur (``weights="count"``).

Bands of ``ROWS`` coordinates make candidates. Documents whose elements are equal
are one class from the start, told by a digest of all of them; only one document
of a class goes on. Buckets never form all pairs. In the first round, every
document of a bucket is paired with the smallest id there, and the pairs are
verified by exact similarity on the whole texts; those that fail go on to rounds
among themselves, against the ``CENTRES`` smallest ids, then ``GROWTH`` times as many,
until none is left. So what a round verifies is linear in the size of a bucket,
and few rounds are needed. Pairs that are surely far apart are not verified: elements
fall into ``64 * LONGS`` bins, a bit of each tells whether its weight is odd, and every
bit in which two documents differ takes at least one element, or unit of weight, that
they do not share. So no similar pair is lost by it. Then, what a star may have missed: a document that is
linked to a centre leaves its bucket, so one that is not linked to that centre may
never have met it there. All of another class meet it now, a few of each class at a
time: a document that is near to many members of a class meets one of them soon.
Classes are the connected components of all verified links, by repeated minima over
the links, in tables.

A copy's class id is the smallest id in its component. A null text is an empty
text; texts without a word have no elements and are equal to one another. Rows
that repeat an id are one document if their texts are equal and else ill-defined,
as ids must tell documents apart; a null id is not near to anything but equal
texts, and its class is the smallest id among those.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from msgtriage.llm.common import materialize, text_or_empty
from msgtriage.llm.runs import hashed_runs, mix, slices

SHINGLE = 5
COORDINATES = 150
ROWS = 6
SIMILARITY = 0.8
#: Smallest ids of a bucket that the rest is compared with in the second round, and members of a class with
#: which one that failed is compared first; ``GROWTH`` times as many in each further round.
CENTRES = TRIES = GROWTH = 8
#: Longs of bits that screen pairs before they are verified.
LONGS = 8
PARITY = [f"p{i}" for i in range(LONGS)]
MEMBERS = "bucket long, id long, n double, " + ", ".join(f"{p} long" for p in PARITY)
SEED = 9
#: Characters of text, and documents, whose elements and darts a task holds at once, about.
SLICE = 1 << 18
DOCUMENTS = 200

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def shingles(texts: list[str], words: int = SHINGLE) -> list[np.ndarray]:
    """The elements of each text, in its order with repeats: hashes of runs of words."""
    codes, owner = hashed_runs(texts, punctuation=False)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    runs = _chain(codes, words) if len(codes) >= words else codes[:0]
    return [runs[f:f + n - words + 1] if n >= words else _chain(codes[f:f + n], n) for f, n in zip(first, counts)]


def _chain(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive codes; none of no codes."""
    if not width:
        return codes
    count = len(codes) - width + 1
    out = np.zeros(count, np.uint64)
    for i in range(width):
        out = mix(out * _C + codes[i:i + count])
    return out


def weighted(elements: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements and their weights."""
    found, counts = np.unique(elements, return_counts=True)
    return found, np.ones(len(found)) if weights == "set" else counts.astype(float)


def darts(elements: np.ndarray, weights: np.ndarray, most: np.ndarray, k: int):
    """All darts of rank up to ``most`` below their element's weight: index of the element, coordinate, rank, name."""
    found = []
    top = float(weights.max(initial=0))
    region, low, high = 0, 0.0, 1.0
    while low < top:
        at = np.flatnonzero(weights > low)
        stream = mix(elements[at] + mix(np.full(1, SEED + region, np.uint64) * _C))
        rank = np.zeros(len(at))
        # A stream's darts are numbered; they are made 1, 2, 4, ... at a time while the last is in reach.
        number, block = 1, 1
        while len(at):
            steps = np.arange(number, number + block, dtype=np.uint64) * _C
            draw = mix(stream[:, None] + steps)
            # Exponential steps in rank, as a region has area (high - low) per rank.
            ranks = rank[:, None] + np.cumsum(-np.log(_uniform(draw)), axis=1) / (high - low)
            near = ranks <= most[at][:, None]
            row, column = np.nonzero(near)
            name = mix(draw[row, column] ^ _B)
            owner = at[row]
            thrown = ranks[row, column]
            if region:
                below = low + (high - low) * _uniform(mix(name + _A)) < weights[owner]
                owner, name, thrown = owner[below], name[below], thrown[below]
            found.append((owner, ((name >> np.uint64(20)) % np.uint64(k)).astype(np.int64), thrown, name))
            alive = near[:, -1]
            at, stream, rank = at[alive], stream[alive], ranks[alive, -1]
            number, block = number + block, min(2 * block, 256)
        region, low, high = region + 1, high, high * 2
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4)) if found else (np.zeros(0, np.int64),) * 4


def signatures(documents: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """[document, coordinate]: the name of the earliest dart. Every document has an element."""
    out = np.zeros((len(documents), k), np.uint64)
    todo = np.arange(len(documents))
    wanted = k * math.log(k) + 2 * k
    reach = np.array([wanted / w.sum() for _, w in documents])
    while len(todo):
        sizes = np.array([len(documents[d][0]) for d in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        elements = np.concatenate([documents[d][0] for d in todo])
        weights = np.concatenate([documents[d][1] for d in todo])
        at, coordinate, rank, name = darts(elements, weights, reach[todo][owner], k)
        cell = owner[at] * k + coordinate
        earliest = np.full(len(todo) * k, np.inf)
        np.minimum.at(earliest, cell, rank)
        first = rank == earliest[cell]
        sketch = np.zeros(len(todo) * k, np.uint64)
        sketch[cell[first]] = name[first]
        filled = np.isfinite(earliest)
        full = filled.reshape(len(todo), k).all(axis=1)
        out[todo[full]] = sketch.reshape(len(todo), k)[full]
        todo = todo[~full]
        reach[todo] *= 2
    return out


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """[document, band]: a hash of the band's coordinates and its number."""
    count = sketches.shape[1] // rows
    out = np.broadcast_to(np.arange(count, dtype=np.uint64), (len(sketches), count)) + np.uint64(1)
    for i in range(rows):
        out = mix(out * _C + sketches[:, i:count * rows:rows])
    return out


def parity(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``LONGS`` longs: a bit for each bin of elements, whether the sum of its weights is odd."""
    bins = (mix(elements ^ _B) % np.uint64(64 * LONGS)).astype(np.int64)
    odd = np.bincount(bins, weights, 64 * LONGS).astype(np.int64) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _alike(similarity: float, other: str) -> Column:
    """Whether a document may be as similar to another, whose columns begin with ``other``: false only if it is not.

    With total weights n and m, and a difference of at least d, the similarity is (n + m - d) / (n + m + d) at most.
    """
    sizes = F.col("n") + F.col(f"{other}n")
    bits = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(other + p))) for p in PARITY), F.lit(0))
    least = F.greatest(bits.cast("double"), F.abs(F.col("n") - F.col(f"{other}n")))
    return least * (1 + similarity) <= sizes * (1 - similarity + 1e-9)


def sketch(docs: DataFrame, id_column: str, text_column: str, *, weights: str = "set", words: int = SHINGLE,
           coordinates: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """id, digest of all elements, band hashes (none for a text without elements), total weight, bits of parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in slices(texts, SLICE):
                held = [weighted(e, weights) for e in shingles(texts[part], words)]
                digests = [hashlib.blake2b(e.tobytes() + (w.tobytes() if weights != "set" else b""),
                                           digest_size=16).digest() for e, w in held]
                found: list = [[] for _ in held]
                some = [j for j, (e, _) in enumerate(held) if len(e)]
                for at in range(0, len(some), DOCUMENTS):
                    group = some[at:at + DOCUMENTS]
                    sketches = signatures([held[j] for j in group], coordinates)
                    for j, row in zip(group, bands(sketches, rows)):
                        found[j] = row.view(np.int64)
                flags = np.array([parity(e, w) for e, w in held]).reshape(len(held), LONGS)
                yield pa.RecordBatch.from_arrays(
                    [ids[part], pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64())),
                     pa.array([float(w.sum()) for _, w in held]), *[pa.array(flags[:, i]) for i in range(LONGS)]],
                    names=["id", "digest", "bands", "n", *PARITY])

    return docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text")).mapInArrow(
        run, "id long, digest binary, bands array<long>, n double, " + ", ".join(f"{p} long" for p in PARITY))


def element_column(weights: str, words: int):
    """A column function: text to its sorted elements and their weights (weight null: all are 1)."""
    @F.pandas_udf("elements array<long>, weights array<double>")
    def elements(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            texts = [t or "" for t in column]
            found = [weighted(e, weights) for part in slices(texts, SLICE) for e in shingles(texts[part], words)]
            yield pd.DataFrame({
                "elements": [e.view(np.int64) for e, _ in found],
                "weights": [None if weights == "set" else w for _, w in found],
            })

    def apply(text: Column) -> Column:
        return elements(text)

    return apply


def exact_similarity(weights: str) -> Column:
    """Jaccard similarity of the elements ea and eb, with their weights wa and wb."""

    def counted(a: pd.Series, wa: pd.Series, b: pd.Series, wb: pd.Series) -> pd.Series:
        out = []
        for x, u, y, v in zip(a, wa, b, wb):
            _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            low = np.minimum(u[i], v[j]).sum()
            out.append(low / (u.sum() + v.sum() - low))
        return pd.Series(out, dtype=float)

    if weights == "count":
        return F.pandas_udf(counted, "double")("ea", "wa", "eb", "wb")
    shared = F.size(F.array_intersect("ea", "eb"))
    return shared / (F.size("ea") + F.size("eb") - shared)


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, root: the smallest id of each connected component. ``links`` has a and b, ``nodes`` id.

    A node that has links to many others keeps the one to the smallest of them, and the others are
    linked to that one instead: the components are the same, and a group whose members all have links
    to the same few has hardly more links than members.

    Every round then gives a node the smallest root among its own and its neighbours', then the root of its
    root; components of stars and short chains are done in a few rounds. Minima by node are taken in
    each task before the shuffle.
    """
    least = F.min("a").over(Window.partitionBy("b"))
    told = links.select("a", "b").withColumn("least", least)
    fewer = told.select(F.explode(F.array(
        F.struct(F.col("least").alias("a"), "b"), F.struct(F.col("least").alias("a"), F.col("a").alias("b")))).alias("l")
        ).select("l.*").where("a != b").distinct()
    fewer = materialize(fewer, "fewer-links")
    both = materialize(fewer.union(fewer.select(F.col("b"), F.col("a"))).distinct(), "links")
    own = nodes.select("id", F.col("id").alias("root"))
    near = both.select(F.col("a").alias("id"), F.col("b").alias("root"))
    roots = materialize(own.union(near).groupBy("id").agg(F.min("root").alias("root")), "roots")
    while True:
        told = both.join(roots.withColumnRenamed("id", "b"), "b").select(
            F.col("a").alias("id"), "root", F.lit(None).cast("long").alias("old"))
        lower = told.union(roots.select("id", "root", F.col("root").alias("old"))).groupBy("id").agg(
            F.min("root").alias("root"), F.min("old").alias("old"))
        lower = materialize(lower, "roots-lower")
        if not lower.where("root != old").limit(1).count():
            return lower.select("id", "root")
        jumped = lower.join(lower.select(F.col("id").alias("root"), F.col("root").alias("next")), "root")
        roots = materialize(jumped.select("id", F.col("next").alias("root")), "roots")


def _prefixed(prefix: str) -> list[Column]:
    """What the screen reads, under names that begin with ``prefix``."""
    return [F.col(c).alias(prefix + c) for c in ("n", *PARITY)]


def _stars(members: DataFrame, centres: int, similarity: float) -> DataFrame:
    """bucket, a, b, n, bits, last, near: every member b with the smaller ones of the bucket's ``centres`` smallest ids, a.

    Only pairs that may be similar, told by ``near``, and those with the first centre, so that each b is there.
    ``last`` is the largest centre. Ranking the centres drops all others in each task before the shuffle.
    """
    by_id = Window.partitionBy("bucket").orderBy("id")
    few = members.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= centres).select(
        "bucket", F.col("id").alias("a"), *_prefixed("a_"), "rank")
    few = few.withColumn("last", F.max("a").over(Window.partitionBy("bucket")))
    near = _alike(similarity, "a_")
    return members.withColumnRenamed("id", "b").join(few, "bucket").where(
        (F.col("b") > F.col("a")) & ((F.col("rank") == 1) | near)).select(
        "bucket", "a", "b", "n", *PARITY, "last", near.alias("near"))


def bucket_classes(members: DataFrame, verified, similarity: float) -> DataFrame | None:
    """id, root: components of the similar pairs that share a bucket; None, if no bucket has two members.

    ``members`` is as ``MEMBERS`` says, and stored; ``verified`` gives a, b, s of distinct pairs a, b.
    """
    wanted = members.select("id").distinct()
    # Stars: everyone in a bucket against its smallest id, which settles groups of near copies; then
    # those that fail among themselves, against the smallest few, which settles buckets of unlike texts.
    stars, left, centres = [], members, 1
    while left is not None:
        paired = materialize(_stars(left, centres, similarity), "star")
        if not paired.limit(1).count():
            break
        found = verified(paired.where("near").select("a", "b").distinct()).where(F.col("s") >= similarity)
        star = materialize(paired.join(found, ["a", "b"], "left"), "judged")
        stars.append(star.where(F.col("s").isNotNull()).select("bucket", "a", "b"))
        beyond = star.where(F.col("b") > F.col("last"))
        left = materialize(beyond.groupBy("bucket", F.col("b").alias("id")).agg(
            F.max("s").alias("s"), *[F.first(c).alias(c) for c in ("n", *PARITY)]).where("s IS NULL").drop("s"),
            "left") if beyond.limit(1).count() else None
        centres = CENTRES if centres == 1 else GROWTH * centres
    if not stars:
        return None
    arms = stars[0]
    for more in stars[1:]:
        arms = arms.unionByName(more)
    links = arms.select("a", "b").distinct()
    roots = materialize(components(links, wanted), "classes")
    # What a star may have missed: y left the bucket by a link to a centre, so those that are in another
    # class by now may never have met it there. They meet all such y, whatever the centre.
    placed = members.join(roots, "id")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(
        "low != high").select("bucket")
    waiting = materialize(placed.join(mixed, "bucket"), "waiting")
    gone = arms.select("bucket", F.col("b").alias("id")).distinct()
    in_order = Window.partitionBy("bucket", "root").orderBy(F.xxhash64("id"), "id")
    others = materialize(waiting.join(gone, ["bucket", "id"], "left_semi").withColumn(
        "rank", F.row_number().over(in_order)), "others")
    most = others.agg(F.max("rank")).first()[0] or 0
    done, tries = 0, TRIES
    while done < most:
        some = others.where((F.col("rank") > done) & (F.col("rank") <= done + tries)).select(
            "bucket", F.col("id").alias("y"), *_prefixed("y_"), F.col("root").alias("root_y"))
        near = (F.col("root") != F.col("root_y")) & _alike(similarity, "y_")
        pairs = materialize(waiting.join(some, "bucket").where(near).select(
            F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b")).distinct(), "fringe")
        done, tries = done + tries, GROWTH * tries
        if not pairs.limit(1).count():
            continue
        found = materialize(verified(pairs).where(F.col("s") >= similarity).select("a", "b"), "linked")
        if found.limit(1).count():
            links = links.union(found)
            roots = materialize(components(links, wanted), "classes")
            waiting = materialize(waiting.drop("root").join(roots, "id"), "waiting")
            others = materialize(others.drop("root").join(roots, "id"), "others")
    return roots


def near_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, similarity: float = SIMILARITY,
    weights: str = "set", words: int = SHINGLE, coordinates: int = COORDINATES, rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id."""
    if weights not in ("set", "count"):
        raise ValueError("weights is set or count")
    sketched = materialize(sketch(docs, id_column, text_column, weights=weights, words=words,
                                  coordinates=coordinates, rows=rows), "sketch")
    first = materialize(sketched.groupBy("digest").agg(
        F.min("id").alias("rep"), F.min_by(F.struct("bands", "n", *PARITY), "id").alias("s")), "distinct")
    known = first.where(F.col("rep").isNotNull())
    entries = known.select(F.explode("s.bands").alias("bucket"), F.col("rep").alias("id"), "s.n", *[f"s.{p}" for p in PARITY])
    shared = entries.groupBy("bucket").count().where("count > 1").select("bucket")
    members = materialize(entries.join(shared, "bucket"), "members")

    wanted = members.select("id").distinct()
    texts = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    # The same plan at every size: what is wanted grows with the table, so it is never broadcast.
    held = texts.join(wanted.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"])
    elements = materialize(held.select("id", element_column(weights, words)(F.col("text")).alias("e")).select(
        "id", "e.elements", "e.weights"), "elements")
    exact = exact_similarity(weights)

    def verified(pairs: DataFrame) -> DataFrame:
        """a, b, s of distinct pairs."""
        one = elements.select(F.col("id").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa"))
        two = elements.select(F.col("id").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))
        joined = pairs.select("a", "b").distinct().join(one, "a").join(two, "b")
        return materialize(joined.select("a", "b", exact.alias("s")), "verified")

    return _with_classes(sketched, first, bucket_classes(members, verified, similarity))


def _with_classes(sketched: DataFrame, first: DataFrame, roots: DataFrame | None) -> DataFrame:
    named = first.select("digest", "rep")
    if roots is not None:
        named = named.join(roots, F.col("rep") == F.col("id"), "left").select(
            "digest", F.coalesce("root", "rep").alias("rep"))
    return sketched.select("id", "digest").join(named, "digest", "left").select(
        F.col("id").alias("doc_id"), F.col("rep").alias("class_id"))


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, one document of each class: the one whose id names it."""
    classes = near_classes(docs, id_column, text_column)
    dropped = classes.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(id_column)).distinct()
    return docs.join(dropped, id_column, "left_anti").select(*docs.columns)
