"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the UTF-8 bytes of a whole text, once from the left and once from the right, and gives every byte position a
distribution over the languages. A document's probabilities are the mean over all its positions. To run many positions side by
side, a text is cut into windows of WINDOW positions; each starts CONTEXT bytes early in either direction, so that a state that
begins there has settled before a position counts, and words are read with the words around them. Training is backpropagation
through time with Adam on a bounded sample of labelled documents.

Edge cases: null texts and texts without a letter are "und" with score 0. Without usable training rows everything is "und".
Ties go to the language that comes first in the alphabet. Repeated rows teach once. Extra columns stay, but ones named as the
two results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_short_batches, slices

UNDETERMINED = "und"
#: Training documents of each language and of all together (at least one of each language), about, and characters that are
#: taken from each: the bound of what the driver gathers.
DOCS_PER_LANG, MAX_DOCS, EXAMPLE_CHARS = 600, 24_000, 1500
STEPS, BATCH, UNROLLED = 400, 96, 64
#: Hidden units: one for each language, within these bounds.
HIDDEN = (4, 32)
#: Positions of a window, bytes that it starts early, windows of a run.
WINDOW, CONTEXT, RUN = 224, 16, 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


@dataclass
class Gru:
    """One direction. x: input weights of each byte and bias for the gates z, r and n; u: recurrent weights."""

    x: np.ndarray
    u: np.ndarray

    def states(self, bytes_: np.ndarray) -> np.ndarray:
        """Hidden states (length, hidden, rows) of (length, rows) bytes."""
        k, rows = self.u.shape[0], bytes_.shape[1]
        # sigmoid(v) = (tanh(v / 2) + 1) / 2; the half is in the weights, and all arrays are written in place.
        half = np.repeat((0.5, 0.5, 1.0), k).astype(self.x.dtype)[:, None]
        x, u = self.x.T * half, self.u.T * half
        h, out = np.zeros((k, rows), dtype=x.dtype), np.empty((len(bytes_), k, rows), dtype=x.dtype)
        a, b = np.empty((3 * k, rows), dtype=x.dtype), np.empty((3 * k, rows), dtype=x.dtype)
        gates, n, part = a[: 2 * k], a[2 * k :], b[2 * k :]
        for t, now in enumerate(bytes_.astype(np.intp)):
            np.take(x, now, axis=1, out=a, mode="clip")
            np.matmul(u, h, out=b)
            gates += b[: 2 * k]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            part *= gates[k:]
            n += part
            np.tanh(n, out=n)
            h = np.subtract(h, n, out=out[t])
            h *= gates[:k]
            h += n
        return out

    def gradients(self, bytes_: np.ndarray, states: np.ndarray, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpropagation through time; d_states: the loss's gradient at each state."""
        k, x = self.u.shape[0], np.ascontiguousarray(self.x.T)
        du, dh = np.zeros_like(self.u), np.zeros_like(states[0])
        d_in = np.empty((len(states), 3 * k, states.shape[2]), dtype=states.dtype)
        for t in range(len(states) - 1, -1, -1):
            dh = dh + d_states[t]
            h0 = states[t - 1] if t else np.zeros_like(dh)
            a, b = x[:, bytes_[t]], self.u.T @ h0
            zr = _sigmoid(a[: 2 * k] + b[: 2 * k])
            z, r = zr[:k], zr[k:]
            n = np.tanh(a[2 * k :] + r * b[2 * k :])
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h0 - n) * z * (1 - z)
            dr = dn * b[2 * k :] * r * (1 - r)
            d_in[t] = np.concatenate((dz, dr, dn))
            db = np.concatenate((dz, dr, dn * r))
            du += h0 @ db.T
            dh = dh * z + self.u @ db
        kinds, at = np.unique(bytes_, return_inverse=True)
        dx = np.zeros_like(self.x)
        each = np.eye(len(kinds), dtype=states.dtype)[at.ravel()]
        dx[kinds] = each.T @ d_in.transpose(0, 2, 1).reshape(-1, 3 * k)
        return dx, du


def _softmax(s: np.ndarray) -> np.ndarray:
    """Over the languages, axis 1 of (length, languages, rows), in place."""
    s -= s.max(axis=1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=1, keepdims=True)
    return s


@dataclass
class LanguageModel:
    langs: list[str]
    left: Gru
    right: Gru
    out: np.ndarray  # (2 * hidden + 1, languages)

    def logits(self, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits (length, languages, rows) of rows of one length, and the states of either direction."""
        k = len(self.left.u)
        a, b = self.left.states(bytes_), self.right.states(bytes_[::-1])
        return self.out[:k].T @ a + self.out[k:-1].T @ b[::-1] + self.out[-1][:, None], a, b

    def _windows(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Probabilities (length, languages, rows) of the rows data[begin:end]; those behind a row's end mean nothing."""
        k, size, last = len(self.left.u), end - begin, len(data) - 1
        step = np.arange(int(size.max()))[:, None]
        logits = self.out[:k].T @ self.left.states(data[np.minimum(begin + step, last)])
        back = self.out[k:-1].T @ self.right.states(data[np.maximum(end - 1 - step, 0)])
        # A row's last byte is the first one from the right.
        mirrored = back[::-1] if size.min() == len(step) else np.take_along_axis(back, np.maximum(size - 1 - step, 0)[:, None, :], axis=0)
        logits += mirrored
        logits += self.out[-1][:, None]
        return _softmax(logits)

    def positions(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Texts lie in data from starts on. For runs of windows: their texts, first positions in data, and probabilities (positions, languages, windows), 0 outside."""
        windows = -(-sizes // WINDOW)
        text = np.repeat(np.arange(len(sizes)), windows)
        first = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
        stop = starts[text] + sizes[text]
        begin, end = np.maximum(first - CONTEXT, starts[text]), np.minimum(first + WINDOW + CONTEXT, stop)
        order = np.lexsort((first - begin, end - begin))  # rows of much the same shape run together
        rows = max(1, min(RUN, 8 * RUN // len(self.langs)))
        step = np.arange(WINDOW)[:, None]
        for i in range(0, len(order), rows):
            at = order[i : i + rows]
            p, early = self._windows(data, begin[at], end[at]), first[at] - begin[at]
            if early.min() == early.max() and (stop[at] - first[at]).min() >= WINDOW:
                yield text[at], first[at], p[early[0] : early[0] + WINDOW]
            else:
                own = np.minimum(early + step, len(p) - 1)
                yield text[at], first[at], np.take_along_axis(p, own[:, None, :], axis=0) * (first[at] + step < stop[at])[:, None, :]

    def documents(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Predicted language and pooled probability of each text."""
        asked = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        coded = [texts[i].encode("utf-8", "replace") for i in asked]
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        total = np.zeros((len(asked), len(self.langs)))
        for text, _, p in self.positions(np.frombuffer(b"".join(coded), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes):
            np.add.at(total, text, p.sum(axis=0).T)
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        for i, p in zip(asked, total / np.maximum(sizes, 1)[:, None], strict=True):
            langs[i], scores[i] = self.langs[int(p.argmax())], min(float(p.max()), 1.0)
        return langs, scores

    def label_bytes(self, text: str) -> list[str]:
        """The likeliest language of every byte of a text."""
        data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        best = np.zeros(len(data), dtype=np.int64)
        for _, first, p in self.positions(data, np.zeros(1, dtype=np.int64), np.array([len(data)])):
            for k, begin in enumerate(first):
                n = min(WINDOW, len(data) - begin)
                best[begin : begin + n] = p[:n, :, k].argmax(axis=1)
        return [self.langs[k] for k in best]


def train(examples: list[tuple[str, str]], *, hidden: int | None = None, steps: int = STEPS, batch: int = BATCH, seed: int = 5) -> LanguageModel | None:
    """Train on (text, language) pairs; every language has the same weight. None if there is nothing to learn."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for text, lang in examples if any(map(str.isalpha, text))})
    if not langs:
        return None
    # Each language's texts one behind the other; a row of a batch begins anywhere in them.
    streams = []
    for lang in langs:
        data = b"\n".join(text.encode("utf-8", "replace") for text, own in examples if own == lang)
        streams.append(np.frombuffer(data * -(-2 * UNROLLED // len(data)), dtype=np.uint8))
    k = hidden or min(max(len(langs), HIDDEN[0]), HIDDEN[1])
    init = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    params = [init(256, 3 * k, s=0.3), init(k, 3 * k, s=1 / np.sqrt(k)), init(256, 3 * k, s=0.3), init(k, 3 * k, s=1 / np.sqrt(k)), init(2 * k + 1, len(langs), s=0.1)]
    model = LanguageModel(langs, Gru(*params[:2]), Gru(*params[2:4]), params[4])
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        truth = rng.integers(0, len(langs), batch)
        begin = [int(rng.integers(0, len(streams[lang]) - UNROLLED)) for lang in truth]
        data = np.stack([streams[lang][b : b + UNROLLED] for lang, b in zip(truth, begin, strict=True)], axis=1)
        logits, a, b = model.logits(data)
        d = _softmax(logits)
        d[:, truth, np.arange(batch)] -= 1
        d /= batch * UNROLLED
        h = np.concatenate((a, b[::-1]), axis=1)
        d_out = np.concatenate((np.einsum("tkn,tln->kl", h, d, optimize=True), d.sum(axis=(0, 2))[None]))
        dh = model.out[:-1] @ d
        grads = [*model.left.gradients(data, a, dh[:, :k]), *model.right.gradients(data[::-1], b, dh[::-1, k:]), d_out]
        rate = 0.01 * min(1, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.005 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-6)
    return model


def fit(docs: DataFrame, teaches: Column, *, docs_per_lang: int = DOCS_PER_LANG, max_docs: int = MAX_DOCS, **options) -> LanguageModel | None:
    """Train on a bounded sample of the documents for which teaches holds and that have a text and a language."""
    rows = docs.filter(teaches & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return None
    each = max(1, min(docs_per_lang, max_docs // len(sizes)))
    # One row for each language.
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1_000_000)) / 1e6
    # A window of each example that starts anywhere in it.
    begin = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.greatest(F.length("text") - EXAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    window = F.substr("text", begin, F.lit(EXAMPLE_CHARS))
    drawn = rows.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select(window.alias("text"), "lang").distinct().collect()
    return train(sorted((r["text"], r["lang"]) for r in drawn), **options)


def predict(docs: DataFrame, model: LanguageModel | None, *, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its pooled probability; all other columns stay."""
    if model is None:
        return docs.withColumns({lang: F.lit(UNDETERMINED), score: F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [sent.value.documents(part) for part in slices(texts, 2_000_000)]
            yield pd.DataFrame({"lang": [x for langs, _ in got for x in langs], "score": np.concatenate([np.zeros(0), *(s for _, s in got)])})

    found = free_name(docs, "_language")
    out = in_short_batches(docs).withColumn(found, label.asNondeterministic()(F.col(text)))
    return out.withColumns({lang: F.col(f"{found}.lang"), score: F.col(f"{found}.score")}).drop(found)
