"""Language identification by a byte convolutional network, trained in numpy.

Input is a fixed-length window of bytes.  Filters of several widths slide over it, each
is max-pooled over the window, and a softmax layer gives the languages.  As inputs are
one-hot, a filter's product with a window is a sum of table entries; for inference the
tables of neighbouring positions are added up beforehand, so a position costs two
look-ups for all filters.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import kernels as K

WIDTHS, FILTERS, N_BYTES = (2, 3, 4), 16, 256
WINDOW = 256
#: The training sample: documents of each language and in all, and windows of each document.
MAX_DOCS, MAX_SAMPLE, WINDOWS_PER_DOC = 400, 25_600, 4
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Filter tables by width (width, N_BYTES, FILTERS), and the dense layer."""

    langs: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out_bias: np.ndarray

    def fused(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums for the pair of bytes at i, and for that at i + 2, of all filters."""
        if not hasattr(self, "_fused"):
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(N_BYTES * N_BYTES, -1)
            zero = np.zeros((N_BYTES, FILTERS), np.float32)
            t2, t3, t4 = self.tables
            near = np.concatenate([pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1])], axis=1)
            far = np.concatenate([pair(t3[2], zero), pair(t4[2], t4[3])], axis=1)
            self._fused = np.ascontiguousarray(near + self.bias, np.float32), np.ascontiguousarray(far, np.float32)
        return self._fused


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _pooled(net: Network, x: np.ndarray) -> np.ndarray:
    """Max-pooled, rectified filter outputs of windows of bytes (n, WINDOW + 3)."""
    near, far = net.fused()
    wide = x.astype(np.int32)
    code = wide[:, :-1] * N_BYTES + wide[:, 1:]
    out = near[code[:, :-2]]
    out[:, :, FILTERS:] += far[code[:, 2:]]
    return np.maximum(out.max(axis=1), 0)


def windows_of(data: np.ndarray, size: int) -> np.ndarray:
    """All windows of WINDOW bytes over one text, each with 3 bytes more.

    The last window is filled with byte 0; every byte lies in one window.
    """
    n = max(1, -(-size // WINDOW))
    padded = np.zeros(n * WINDOW + 3, np.uint8)
    padded[:size] = data[:size]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 3)[::WINDOW]


def sample_windows(text: str, count: int = WINDOWS_PER_DOC) -> np.ndarray:
    """At most ``count`` of a text's windows, from anywhere in it, chosen by its bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    w = windows_of(np.frombuffer(raw, np.uint8), len(raw))
    seed = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big")
    return w[np.sort(np.random.default_rng(seed).choice(len(w), min(len(w), count), replace=False))]


def new_network(langs: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    width = FILTERS * len(WIDTHS)
    return Network(
        langs,
        [rng.normal(0, 0.3, (k, N_BYTES, FILTERS)).astype(np.float32) for k in WIDTHS],
        np.zeros(width, np.float32),
        rng.normal(0, 0.2, (width, len(langs))).astype(np.float32),
        np.zeros(len(langs), np.float32),
    )


def gradient(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted mean cross entropy of a batch of windows, and its gradient by parameter.

    A maximum passes its gradient to the first place that attains it.
    """
    x = x.astype(np.int64)
    # Filters sum entries of the tables; a look-up takes all filters of a width at once.
    conv = [sum(np.take(t[j], x[:, j : j + WINDOW], axis=0) for j in range(len(t))) for t in net.tables]
    best = [c.argmax(axis=1) for c in conv]
    top = np.concatenate([np.take_along_axis(c, b[:, None, :], 1)[:, 0] for c, b in zip(conv, best, strict=True)], axis=1) + net.bias
    hidden = np.maximum(top, 0)
    prob = _softmax(hidden @ net.dense + net.out_bias)
    scale = weight / len(y)
    loss = float(-(np.log(prob[np.arange(len(y)), y]) * scale).sum())
    delta = prob
    delta[np.arange(len(y)), y] -= 1
    delta *= scale[:, None].astype(delta.dtype)
    back = (delta @ net.dense.T) * (top > 0)
    grads, filters = [], np.arange(FILTERS)
    for k, (table, place) in enumerate(zip(net.tables, best, strict=True)):
        own = back[:, k * FILTERS : (k + 1) * FILTERS].reshape(-1)
        cells = [np.take_along_axis(x, place + j, 1) * FILTERS + filters for j in range(len(table))]
        grads.append(np.stack([np.bincount(c.reshape(-1), own, N_BYTES * FILTERS).reshape(N_BYTES, FILTERS) for c in cells]))
    return loss, [*grads, back.sum(0), hidden.T @ delta, delta.sum(0)]


def train(windows: np.ndarray, langs: list[str], epochs: int = 10, rate: float = 0.02, seed: int = 7) -> Network | None:
    """Fits the network with Adam on windows, at a falling rate; None without any.  Languages weigh the same."""
    if not len(windows):
        return None
    names = sorted(set(langs))
    index = {x: i for i, x in enumerate(names)}
    y = np.array([index[x] for x in langs])
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names))))[y]
    net, rng = new_network(names, seed), np.random.default_rng(seed)
    params = [*net.tables, net.bias, net.dense, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    t, steps = 0, epochs * -(-len(y) // 64)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            pick = order[at : at + 64]
            t += 1
            for p, g, (m, v) in zip(params, gradient(net, windows[pick], y[pick], weight[pick])[1], moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return net


def predict(net: Network | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of each text and its probability, from all windows of the text.

    Window log-probabilities are averaged by their filled length.  Texts that are
    null or have no letter are "und" with score 0, as are all without a network.
    """
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    todo = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    if net is None or not todo:
        return langs, scores
    views, owner, filled = [], [], []
    for i in todo:
        raw = np.frombuffer(texts[i].encode("utf-8", "surrogatepass"), np.uint8)
        w = windows_of(raw, len(raw))
        views.append(w)
        owner.append(np.full(len(w), i))
        size = np.full(len(w), float(WINDOW))
        size[-1] = len(raw) - (len(w) - 1) * WINDOW
        filled.append(size)
    x, own, size = np.concatenate(views), np.concatenate(owner), np.concatenate(filled)
    hidden = np.concatenate([_pooled(net, x[a : a + 64]) for a in range(0, len(x), 64)])
    logs = np.log(_softmax(hidden @ net.dense + net.out_bias) + 1e-9) * size[:, None]
    total = np.stack([np.bincount(own, logs[:, k], minlength=len(texts)) for k in range(len(net.langs))], axis=1)
    mean = total / np.maximum(np.bincount(own, size, minlength=len(texts)), 1)[:, None]
    prob = _softmax(mean)
    for i in todo:
        k = int(prob[i].argmax())
        langs[i], scores[i] = net.langs[k], float(prob[i, k])
    return langs, scores


def _sampled(batches):
    for batch in batches:
        for piece, texts in K.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([sample_windows(t).tobytes() for t in texts], pa.binary())], ["lang", "place", "windows"])


def training_rows(docs: DataFrame, usable: Column, id_col: str = "doc_id", max_docs: int = MAX_DOCS, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """(lang, windows) of at most ``max_docs`` documents of each language, ``max_sample`` in all.

    Any number of languages is learned: each gives its share, its documents by a hash of
    id and text; only of more than ``max_sample`` languages the rarest are left, as each
    takes a row.  Only texts without a letter and null languages are left out.  Windows
    are cut from whole texts where they lie, so no long text travels.
    """
    rows = docs.where(usable).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # A language's documents are first thinned by the hash to about four times what is
    # needed; repeated rows share a hash and count as one.
    place = F.pmod(F.xxhash64(id_col, "text"), F.lit(1 << 30))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(place).alias("count")).orderBy(F.desc("count"), "lang").limit(max_sample)
    counts = F.broadcast(counts.select(F.col("lang").alias("l"), (F.lit((4.0 * max_docs + 100) * (1 << 30)) / F.col("count")).alias("upto")))
    thin = rows.select("lang", "text", place.alias("place")).join(counts, (F.col("lang") == F.col("l")) & (F.col("place") < F.col("upto")))
    found = thin.select("lang", "place", "text").mapInArrow(_sampled, "lang string, place long, windows binary").dropDuplicates()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place", "windows"))
    return found.withColumn("turn", turn).where(F.col("turn") <= max_docs).orderBy("turn", "lang").limit(max_sample).select("lang", "windows")


def fit(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", max_docs: int = MAX_DOCS, max_sample: int = MAX_SAMPLE) -> Network | None:
    """Trains on a bounded sample of the documents that ``usable`` allows."""
    rows = training_rows(docs, F.lit(True) if usable is None else usable, id_col, max_docs, max_sample).toArrow()
    windows = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW + 3) for w in rows.column("windows").to_pylist()]
    langs = [lang for lang, w in zip(rows.column("lang").to_pylist(), windows, strict=True) for _ in w]
    return train(np.concatenate(windows) if windows else np.zeros((0, WINDOW + 3), np.uint8), langs)


def language_id(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs``, over whole texts.

    Null and letterless texts are "und" with score 0.  Repeated rows and null ids each
    give their row; an empty table gives none; other columns are not read.
    """
    share = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            for piece, texts in K.slices(batch, "text"):
                langs, scores = predict(share.value, texts)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
