"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``STEPS`` bytes that cover all of it. Two gated
recurrent layers read a window, one in each direction; at every byte, both
states give probabilities of the languages. The probabilities of a document are
the mean over all of its bytes.

The network learns in numpy, by backpropagation through time with Adam, on the
driver, from a sample of bounded size: about ``SAMPLE_DOCS`` documents at most, shared
out evenly among all languages that occur (``DOCS_PER_LANG`` at most, one at least),
and ``WINDOWS_PER_DOC`` windows of each, from anywhere in the text. Which documents
these are depends on hashes of their ids, so a run can be repeated. More than
``MAX_LANGS`` languages are an error. Prediction sees the text alone, in Arrow
batches, and moves no rows.

A null text, or one without a letter, is ``und`` with score 0; so is every text
if there is nothing to learn from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from msgtriage.llm.common import uniform_of

UNDETERMINED = "und"
STEPS = 64
HIDDEN = 8
ALPHABET = 256
PAD = 256

#: Bounds of what the network learns from.
MAX_LANGS = 1024
SAMPLE_DOCS = 25_600
DOCS_PER_LANG = 400
WINDOWS_PER_DOC = 4
ITERATIONS = 220
LANGS_A_PASS = 64
BATCH = 128
SEED = 20

LETTER = regex.compile(r"\p{L}")
Weights = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by the hyperbolic tangent, which numpy has vectorised."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def windows_of(raw: bytes) -> np.ndarray:
    """All bytes of a text in rows of ``STEPS``, padded with ``PAD``."""
    count = max(1, -(-len(raw) // STEPS))
    out = np.full(count * STEPS, PAD, np.int16)
    out[:len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(count, STEPS)


def new_weights(languages: int, rng: np.random.Generator) -> Weights:
    """Index 0 of a weight's first axis reads forwards, 1 backwards. Gates: update, reset, candidate."""

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "input": draw(2, ALPHABET + 1, 3 * HIDDEN, scale=0.3),
        "gates": draw(2, HIDDEN, 2 * HIDDEN, scale=0.3),
        "candidate": draw(2, HIDDEN, HIDDEN, scale=0.3),
        "out": draw(2 * HIDDEN, languages, scale=0.3),
        "bias": np.zeros(languages, np.float32),
    }


def _directions(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as [step, direction, window], and which of them are no padding."""
    both = np.ascontiguousarray(np.stack([windows, windows[:, ::-1]]).transpose(2, 0, 1), np.intp)
    return both, both != PAD


def forward(w: Weights, windows: np.ndarray, keep: bool = False):
    """States [step, window, both directions] in reading order, and the tape for backpropagation.

    Padding leaves the state as it is, so the backward layer starts at the last byte.
    """
    codes, real = _directions(windows)
    n, h2 = windows.shape[0], 2 * HIDDEN
    state = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((STEPS, n, h2), np.float32)
    tape = []
    padded = not real.all()
    for t in range(STEPS):
        x = np.stack([w["input"][0].take(codes[t, 0], axis=0), w["input"][1].take(codes[t, 1], axis=0)])
        gates = np.matmul(state, w["gates"])
        gates += x[..., :h2]
        _sigmoid(gates)
        update, reset = gates[..., :HIDDEN], gates[..., HIDDEN:]
        gated = reset * state
        candidate = np.matmul(gated, w["candidate"])
        candidate += x[..., h2:]
        np.tanh(candidate, out=candidate)
        change = candidate - state
        change *= update
        if padded:
            change *= real[t][..., None]
        if keep:
            tape.append((state, update, reset, candidate))
        state = state + change
        states[t, :, :HIDDEN] = state[0]
        states[STEPS - 1 - t, :, HIDDEN:] = state[1]
    return states, codes, real, tape


def position_probabilities(w: Weights, states: np.ndarray) -> np.ndarray:
    """[step, window, language]"""
    scores = states.reshape(-1, 2 * HIDDEN) @ w["out"]
    scores += w["bias"]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores.reshape(*states.shape[:2], -1)


def pooled_probabilities(w: Weights, windows: np.ndarray) -> np.ndarray:
    """[window, language]: the sum of ``position_probabilities`` over the bytes of each window.

    The same network as ``forward``, laid out for scoring: features come first and
    windows last, so that every operation runs over long rows, in buffers that are
    made once.
    """
    codes, real = _directions(windows)
    n = windows.shape[0]
    padded = not real.all()
    table = np.ascontiguousarray(w["input"].transpose(0, 2, 1))
    to_gates = np.ascontiguousarray(w["gates"].transpose(0, 2, 1))
    to_candidate = np.ascontiguousarray(w["candidate"].transpose(0, 2, 1))
    state = np.zeros((2, HIDDEN, n), np.float32)
    x = np.empty((2, 3 * HIDDEN, n), np.float32)
    gates = np.empty((2, 2 * HIDDEN, n), np.float32)
    gated, candidate = np.empty_like(state), np.empty_like(state)
    states = np.empty((STEPS, 2 * HIDDEN, n), np.float32)
    update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
    for t in range(STEPS):
        for side in (0, 1):
            table[side].take(codes[t, side], axis=1, out=x[side], mode="clip")
        np.matmul(to_gates, state, out=gates)
        gates += x[:, :2 * HIDDEN]
        _sigmoid(gates)
        np.multiply(reset, state, out=gated)
        np.matmul(to_candidate, gated, out=candidate)
        candidate += x[:, 2 * HIDDEN:]
        np.tanh(candidate, out=candidate)
        candidate -= state
        candidate *= update
        if padded:
            candidate *= real[t][:, None]
        state += candidate
        states[t, :HIDDEN] = state[0]
        states[STEPS - 1 - t, HIDDEN:] = state[1]
    to_out = np.ascontiguousarray(w["out"].T)
    scores = np.matmul(to_out, states)
    scores += w["bias"][:, None]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    weight = real[:, 0] / scores.sum(axis=1)
    scores *= weight[:, None]
    return scores.sum(axis=0).T


def gradients(w: Weights, windows: np.ndarray, labels: np.ndarray) -> tuple[float, Weights]:
    """Mean cross-entropy over all bytes, and its derivative by backpropagation through time."""
    states, codes, real, tape = forward(w, windows, keep=True)
    probs = position_probabilities(w, states)
    mask = real[:, 0]
    total = max(1, int(mask.sum()))
    rows = np.arange(len(labels))
    loss = -float((np.log(probs[:, rows, labels] + 1e-9) * mask).sum()) / total
    d = probs.copy()
    d[:, rows, labels] -= 1
    d *= (mask / np.float32(total))[..., None]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    flat = d.reshape(-1, d.shape[2])
    g["out"] = states.reshape(-1, 2 * HIDDEN).T @ flat
    g["bias"] = flat.sum(axis=0)
    by_state = (flat @ w["out"].T).reshape(STEPS, -1, 2 * HIDDEN)
    back = np.zeros_like(tape[0][0])
    for t in range(STEPS - 1, -1, -1):
        state, update, reset, candidate = tape[t]
        back = back + np.stack([by_state[t, :, :HIDDEN], by_state[STEPS - 1 - t, :, HIDDEN:]])
        step = back * real[t][..., None]
        d_candidate = step * update * (1 - candidate * candidate)
        d_update = step * (candidate - state) * update * (1 - update)
        d_gated = np.matmul(d_candidate, w["candidate"].transpose(0, 2, 1))
        d_reset = d_gated * state * reset * (1 - reset)
        d_gates = np.concatenate([d_update, d_reset], axis=2)
        g["candidate"] += np.matmul((reset * state).transpose(0, 2, 1), d_candidate)
        g["gates"] += np.matmul(state.transpose(0, 2, 1), d_gates)
        d_input = np.concatenate([d_gates, d_candidate], axis=2)
        for side in (0, 1):
            np.add.at(g["input"][side], codes[t, side], d_input[side])
        back = back - step * update + d_gated * reset + np.matmul(d_gates, w["gates"].transpose(0, 2, 1))
    return loss, g


def train(windows: np.ndarray, labels: np.ndarray, languages: int, *, iterations: int = ITERATIONS,
          batch: int = BATCH, rate: float = 0.02, seed: int = SEED) -> Weights:
    """Adam over random batches, drawn so that all languages weigh the same."""
    rng = np.random.default_rng(seed)
    w = new_weights(languages, rng)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    counts = np.bincount(labels, minlength=languages)
    chance = 1.0 / counts[labels]
    chance /= chance.sum()
    for i in range(1, iterations + 1):
        pick = rng.choice(len(labels), size=batch, p=chance)
        _, g = gradients(w, windows[pick], labels[pick])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        shrink = min(1.0, 1.0 / (norm + 1e-9))
        pace = rate * min(1.0, 2.0 * (1 - i / (iterations + 1)))
        for k in w:
            x = g[k] * np.float32(shrink)
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            step = (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-6)
            w[k] = (w[k] - pace * step).astype(np.float32)
    return w


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: Weights

    #: Windows that run through the network at once, at up to 64 languages; their states fit in cache and memory.
    CHUNK = 2048

    @staticmethod
    def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            lang_column: str = "lang") -> LanguageModel:
        """Learn from rows that have a language and a text with a letter."""
        rows = docs.select(
            F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"),
            F.col(lang_column).cast("string").alias("lang"),
        ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        draw = uniform_of(F.coalesce("id", F.lit("")), F.col("text"), seed=SEED)
        rows = rows.withColumn("draw", draw)
        counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.min("draw").alias("least")).limit(
            MAX_LANGS + 1).collect()
        if len(counts) > MAX_LANGS:
            raise ValueError(f"more than {MAX_LANGS} languages in {lang_column}")
        languages = sorted(r["lang"] for r in counts)
        if not languages:
            return LanguageModel([], {})
        each = min(DOCS_PER_LANG, SAMPLE_DOCS / len(languages))
        # The smallest draw is always taken, so every language is learnt.
        cuts = docs.sparkSession.createDataFrame(
            [(r["lang"], max(each / r["size"], r["least"])) for r in counts], "lang string, cut double")
        chosen = rows.join(F.broadcast(cuts), "lang").where("draw <= cut")
        # Windows of the chosen, from places that the same hashes name.
        starts = [
            F.floor(uniform_of(F.coalesce("id", F.lit("")), F.lit(k), seed=SEED + 1) * F.octet_length("text"))
            for k in range(WINDOWS_PER_DOC)
        ]
        raw = F.encode("text", "UTF-8")
        cut = F.array(*[F.substring(raw, (s + 1).cast("int"), F.lit(STEPS)) for s in starts])
        sample = chosen.select("lang", F.explode(F.array_distinct(cut)).alias("raw")).toPandas()
        sample = sample.sort_values(["lang", "raw"], kind="stable")
        windows = np.concatenate([windows_of(bytes(r)) for r in sample["raw"]])
        number = {lang: i for i, lang in enumerate(languages)}
        labels = sample["lang"].map(number).to_numpy()
        # As many steps for every ``LANGS_A_PASS`` languages.
        more = {"iterations": ITERATIONS * -(-len(languages) // LANGS_A_PASS)} if len(languages) > LANGS_A_PASS else {}
        return LanguageModel(languages, train(windows, labels, len(languages), **more))

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """[text, language]: the mean over all bytes of each text."""
        sizes = np.array([max(1, -(-len(t) // STEPS)) for t in texts])
        owner = np.repeat(np.arange(len(texts)), sizes)
        sums = np.zeros((len(texts), len(self.languages)))
        stream = self._chunks(texts)
        at = 0
        for windows in stream:
            pooled = pooled_probabilities(self.weights, windows)
            np.add.at(sums, owner[at:at + len(windows)], pooled)
            at += len(windows)
        return sums / np.array([max(1, len(t)) for t in texts])[:, None]

    def _chunks(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The windows of all texts, ``CHUNK`` at a time, or fewer where many languages make their scores large."""
        held, size, chunk = [], 0, max(1, self.CHUNK * 64 // max(64, len(self.languages)))
        for text in texts:
            windows = windows_of(text)
            while len(windows):
                part = windows[:chunk - size]
                held.append(part)
                size += len(part)
                windows = windows[len(part):]
                if size == chunk:
                    yield np.concatenate(held)
                    held, size = [], 0
        if held:
            yield np.concatenate(held)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)] if self.languages else []
        if known:
            probs = self.document_probabilities([texts[i].encode() for i in known])
            best = probs.argmax(axis=1)
            for i, k, row in zip(known, best, probs):
                langs[i], scores[i] = self.languages[k], float(min(1.0, row[k]))
        return langs, scores

    def column(self, text: Column) -> Column:
        """struct<lang_pred, score> of a text column."""
        model = self

        @F.pandas_udf("lang_pred string, score double")
        def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                langs, scores = model.predict(list(texts))
                yield pd.DataFrame({"lang_pred": langs, "score": scores})

        return predicted(text)
