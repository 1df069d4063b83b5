"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score; the document's
score is their noisy-or, 1 - prod(1 - p).  Only documents carry labels, and the
gradient of the document's likelihood shares the blame among its sentences, so the
trained scores also locate the offending ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernels as K
from lodestar.llm.scratch import Scratch

BITS = 18
PREFIXES = range(4, 10)
#: The training sample: bags of each label, of any length.
MAX_BAGS = 2000
THRESHOLD = 0.7

_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SENTENCE = re.compile(r"[.!?\n]")
_END = np.zeros(256, bool)
_END[[0x0A, *b".!?"]] = True


@dataclass(frozen=True)
class Model:
    """Weights of hashed word features, and the bias of a sentence."""

    weights: np.ndarray
    bias: float


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte Latin-1 capitals."""
    out = K.LOWER[data]
    two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[two] += 0x20
    return out


def bag_features(texts: list[str | None]):
    """Features of a batch: (feature, sentence) pairs, and the document of sentences.

    A word gives its own hash and those of its proper prefixes of 4 to 9 bytes.
    Sentences end at . ! ? and newlines; those without words are left out.  Also
    returns the bytes and each sentence's first and last word.
    """
    raw, offsets = K.join_texts(texts)
    data = _fold(raw)
    starts, ends = K.words(data, _SEP)
    number = np.cumsum(_END[data])[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    np.not_equal(number[1:], number[:-1], out=new[1:])
    sentence = np.cumsum(new) - 1
    feats, owner = [K.mix(K.word_hashes(data, starts, ends), 50) >> K.U64(64 - BITS)], [sentence]
    for size in PREFIXES:
        at = np.flatnonzero(ends - starts > size)
        feats.append(K.mix(K.word_hashes(data, starts[at], starts[at] + size), 50 + size) >> K.U64(64 - BITS))
        owner.append(sentence[at])
    first = np.flatnonzero(new)
    doc = np.searchsorted(offsets, starts[first], "right") - 1 if len(first) else first
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return np.concatenate(feats).astype(np.int64), np.concatenate(owner), doc, raw, starts[first], ends[last]


def _pieces(texts: list[str], limit: int = 250_000) -> list[tuple[int, list[str]]]:
    """The texts in runs of about ``limit`` characters, with the number of the first."""
    out, held = [], limit
    for i, t in enumerate(texts):
        if held >= limit:
            out.append((i, []))
            held = 0
        out[-1][1].append(t)
        held += len(t)
    return out


def gradient(w: np.ndarray, b: float, row: np.ndarray, col: np.ndarray, doc: np.ndarray, y: np.ndarray, penalty: float, times: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Loss of the bags' labels under the noisy-or, and its gradient by weights and bias.

    Sentence row[i] holds feature col[i]; sentence s is in bag doc[s], ``times`` times.
    """
    times = np.ones(len(doc)) if times is None else times
    z = b + np.bincount(row, w[col], minlength=len(doc))
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    q = np.bincount(doc, times * np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
    toxic = np.maximum(-np.expm1(q), 1e-9)
    loss = -np.where(y, np.log(toxic), q).sum() / len(y) + penalty * (w * w).sum() / 2
    pull = np.where(y, -np.exp(q) / toxic, 1.0)
    g = times * pull[doc] * p / len(y)
    return float(loss), np.append(np.bincount(col, g[row], minlength=len(w)) + penalty * w, g.sum())


def telling(pos: np.ndarray, neg: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """The features in at least three toxic bags, and at least three times as often in toxic as in clean ones."""
    return np.flatnonzero((pos >= 3) & ((pos / toxic) >= 3 * (neg + 0.5) / clean))


def kept_features(names: np.ndarray, texts: list[str]):
    """(bag, sentence, number of the kept feature) of the texts, each once, and each bag's sentences."""
    number = np.full(1 << BITS, -1)
    number[names] = np.arange(len(names))
    found, sentences, before = [], np.zeros(len(texts), np.int64), 0
    for at, part in _pieces(texts):
        feats, owner, doc, *_ = bag_features(part)
        local, k = number[feats], max(1, len(names))
        pairs = np.unique(owner[local >= 0] * k + local[local >= 0])
        found.append(np.stack([at + doc[pairs // k], before + pairs // k, pairs % k]))
        sentences += np.bincount(at + doc, minlength=len(texts))
        before += len(doc)
    return (np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)), sentences


def solve(names: np.ndarray, bag: np.ndarray, sentence: np.ndarray, feature: np.ndarray, sentences: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.1, penalty: float = 2e-5) -> Model:
    """Fits the weights of the features ``names``; they start at 0 and stay non-negative.

    Sentences without any of them are alike: a bag's count as one, so many times.
    """
    held, row = np.unique(sentence, return_inverse=True)
    own = np.zeros(len(held), np.int64)
    own[row] = bag
    plain = sentences - np.bincount(own, minlength=len(y))
    doc, times = np.concatenate([own, np.flatnonzero(plain)]), np.concatenate([np.ones(len(own)), plain[plain > 0]])
    w, b = np.zeros(len(names)), -5.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        grad = gradient(w, b, row, feature, doc, y, penalty, times)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[names] = w
    return Model(weights, float(b))


def bag_counts(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many toxic and clean bags each feature stands."""
    pos, neg = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for at, part in _pieces(texts):
        feats, owner, doc, *_ = bag_features(part)
        seen = np.unique(doc[owner] * (1 << BITS) + feats)
        toxic, code = y[at + (seen >> BITS)], seen & ((1 << BITS) - 1)
        pos += np.bincount(code[toxic], minlength=1 << BITS)
        neg += np.bincount(code[~toxic], minlength=1 << BITS)
    return pos, neg


def train(texts: list[str], labels: list[int], **how) -> Model | None:
    """Fits the noisy-or model on texts at hand; None without bags of both labels."""
    y = np.asarray(labels, bool)
    if not y.any() or y.all():
        return None
    names = telling(*bag_counts(texts, y), int(y.sum()), int((~y).sum()))
    (bag, sentence, feature), sentences = kept_features(names, texts)
    return solve(names, bag, sentence, feature, sentences, y, **how)


def _cut(texts: list[str | None], limit: int = 500_000) -> tuple[list[str], np.ndarray]:
    """Texts cut after sentences into pieces of about ``limit`` characters, and their numbers.

    Sentences count alone, so cutting changes nothing, and a text of any length is
    scored a piece at a time.
    """
    pieces, source = [], []
    for i, t in enumerate(texts):
        t, at = t or "", 0
        while at == 0 or at < len(t):
            to = at + limit
            if to < len(t):
                end = _SENTENCE.search(t, to)
                to = end.end() if end else len(t)
            pieces.append(t[at:to])
            source.append(i)
            at = max(to, 1)
    return pieces, np.array(source, np.int64)


def score_batch(model: Model | None, texts: list[str | None], locate: float = 0.5):
    """Document scores and, for each, its sentences scored at least ``locate``."""
    n = len(texts)
    spans: list[list[dict]] = [[] for _ in texts]
    if model is None:
        return np.zeros(n), spans
    pieces, source = _cut(texts)
    logs = np.zeros(n)
    for at, part in _pieces(pieces, 1_000_000):
        feats, owner, doc, raw, starts, ends = bag_features(part)
        doc = source[at + doc]
        z = model.bias + np.bincount(owner, model.weights[feats], minlength=len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        logs += np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
        for s in np.flatnonzero(p >= locate):
            sentence = raw[starts[s] : ends[s]].tobytes().decode("utf-8", "replace")
            spans[doc[s]].append({"text": sentence, "score": float(p[s])})
    return np.clip(-np.expm1(logs), 0, 1), spans


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", max_bags: int = MAX_BAGS) -> DataFrame:
    """(id, h, toxic) of at most 2 * ``max_bags`` documents, chosen by a hash of the id.

    h is the hash of the text.  Only labelled documents that exist, with a text, are
    drawn from, and repeated rows are one: neither labels of other documents nor copies
    thin the sample.  Ids with both labels count as toxic; null ids and labels are left out.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic")).where(usable)
    # Keys only; copies of a row are one in each task before they meet.
    there = docs.where(F.length("text") > 0).select(F.col(id_col).cast("long").alias("id"), F.xxhash64("text").alias("h")).distinct()
    found = Scratch(docs.sparkSession, "bags").keep(there.join(marks, "id"), "marked")
    by = [F.xxhash64("id"), F.col("id"), F.col("h")]
    parts = [found.where(F.col("toxic") == k).orderBy(*by).limit(max_bags).select("id", "h", "toxic") for k in (0, 1)]
    return parts[0].union(parts[1])


def _once(batches):
    """Rows (id, h, ...) without the repeats in a task; the sample bounds what is remembered."""
    seen = set()
    for batch in batches:
        new = []
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                new.append(i)
        yield batch.take(pa.array(new, pa.int64()))


def _bag_parts(names):
    """Rows (id, h, feature, sentence): the features of a text, or with ``names`` the places of those.

    There a row of feature -1 tells the text's number of sentences.
    """

    def run(batches):
        for batch in batches:
            for piece, texts in K.slices(batch, "text"):
                for i, text in enumerate(texts):
                    if names is None:
                        feature = np.unique(np.concatenate([bag_features(part)[0] for _, part in _pieces(_cut([text])[0])]))
                        place = np.zeros_like(feature)
                    else:
                        (_, place, feature), total = kept_features(names.value, _cut([text])[0])
                        place, feature = np.append(place, total.sum()), np.append(feature, -1)
                    key = [pa.array([piece.column(c)[i].as_py()] * len(feature), pa.int64()) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*key, pa.array(feature.astype(np.int64)), pa.array(place.astype(np.int64))], ["id", "h", "feature", "sentence"])

    return run


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", max_bags: int = MAX_BAGS) -> Model | None:
    """Trains on a bounded sample of the labelled documents that ``usable`` (on id) allows.

    The bags, of any length, stay on the executors: features are counted there, and only
    places of those that tell the labels apart come to the driver.
    """
    spark, box = docs.sparkSession, Scratch(docs.sparkSession, "bags")
    sample = box.keep(training_rows(docs, labels, F.lit(True) if usable is None else usable, id_col, max_bags), "sample")
    counts = dict(sample.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return None
    # At most 2 * max_bags rows, whatever the tables hold.
    chosen = F.broadcast(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
    rows = rows.join(F.broadcast(sample.select("id", "h")), ["id", "h"]).select("id", "h", "text")
    texts = box.keep(rows.mapInArrow(_once, rows.schema), "texts")
    kind = "id long, h long, feature long, sentence long"
    held = texts.mapInArrow(_bag_parts(None), kind).select("id", "h", "feature").distinct().join(chosen, ["id", "h"])
    pos, neg = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for r in held.groupBy("feature").agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n")).where("p >= 3").toArrow().to_pylist():
        pos[r["feature"]], neg[r["feature"]] = r["p"], r["n"]
    names = telling(pos, neg, counts[1], counts[0])
    places = texts.mapInArrow(_bag_parts(spark.sparkContext.broadcast(names)), kind).distinct().toArrow()
    bags = {(r["id"], r["h"]): (k, r["toxic"]) for k, r in enumerate(sample.toArrow().sort_by([("id", "ascending"), ("h", "ascending")]).to_pylist())}
    at = np.array([bags[k][0] for k in zip(places.column("id").to_pylist(), places.column("h").to_pylist(), strict=True)], np.int64)
    feature, place = places.column("feature").to_numpy(), places.column("sentence").to_numpy()
    sentences, real = np.zeros(len(bags), np.int64), feature >= 0
    sentences[at[~real]] = place[~real]
    # A place counts from its bag's first sentence; sorted, so that sums are the same each time.
    order = np.lexsort((feature[real], place[real], at[real]))
    bag, place, feature = at[real][order], place[real][order], feature[real][order]
    first = np.ones(len(bag), bool)
    first[1:] = (np.diff(bag) != 0) | (np.diff(place) != 0)
    box.drop("texts")
    return solve(names, bag, np.cumsum(first), feature, sentences, np.array([y for _, y in bags.values()], bool))


def toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, offending) for every row of ``docs``.

    ``offending`` lists the sentences (text, score) scored 0.5 or more, in order.
    Null, empty and wordless texts score 0; without a model all do.  Repeated rows and
    null ids each give their row; an empty table gives none; other columns are not read.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        kind = pa.list_(pa.struct([("text", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            for piece, texts in K.slices(batch, "text"):
                score, spans = score_batch(share.value, texts)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(spans, kind)],
                    ["id", "score", "predicted", "offending"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, "id long, score double, predicted int, offending array<struct<text:string,score:double>>")
    return found.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    # Columns go by number on the way: names may hold any sign.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index(text_col)}"

    def run(batches):
        for batch in batches:
            for piece, texts in K.slices(batch, text):
                yield piece.filter(pa.array(score_batch(share.value, texts)[0] < THRESHOLD))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
