"""Toxicity, language, media, token files, nearest neighbours."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import kernels as K
from lodestar.llm import language, permutation_index, png_column, queries, token_files, toxicity
from tests.conftest import DATA
from tests.llm.fixtures import awkward, empty, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_toxicity_learns_and_locates():
    rng = random.Random(1)
    clean = [". ".join([*(words(i * 7 + k, 8) for k in range(6)), "you are a friend really"]) for i in range(150)]
    bad = [". ".join([words(9000 + i * 7, 8), f"you are a {rng.choice(['blorptard', 'zugmuck'])} really", words(9500 + i, 8)]) for i in range(60)]
    model = toxicity.train(clean + bad, [0] * 150 + [1] * 60)
    score, spans = toxicity.score_batch(model, ["Fine text. BLORPTARD indeed! Other words.", words(3, 50), None, "", "?!"])
    assert score[0] >= 0.7 and score[1] < 0.3 and list(score[2:]) == [0, 0, 0]
    assert [s["text"] for s in spans[0]] == ["BLORPTARD indeed"] and spans[1] == []
    assert toxicity.train(clean, [0] * 150) is None


def test_noisy_or_is_the_product():
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    model = toxicity.Model(weights, -2.0)
    p = 1 / (1 + np.exp(2.0))
    cut, source = toxicity._cut(["one. two! three\nfour", None, "", "x" * 50], 6)
    assert (cut, list(source)) == (["one. two!", " three\n", "four", "", "", "x" * 50], [0, 0, 0, 1, 2, 3])
    score, _ = toxicity.score_batch(model, ["a b. c d! e"])
    assert abs(score[0] - (1 - (1 - p) ** 3)) < 1e-9


def test_score_in_plain_python():
    """Words, prefixes, sentences and noisy-or in plain loops give the same scores."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 0.3, 1 << toxicity.BITS).astype(np.float32), -3.0)

    def feature(b, salt):
        data = np.frombuffer(b, np.uint8)
        return int(K.mix(K.word_hashes(data, np.array([0]), np.array([len(b)])), salt)[0] >> np.uint64(64 - toxicity.BITS))

    def plain(text):
        rest = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            words_ = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), sentence).encode())
            if words_:
                z = model.bias + sum(float(model.weights[feature(w, 50)]) + sum(float(model.weights[feature(w[:n], 50 + n)]) for n in toxicity.PREFIXES if len(w) > n) for w in words_)
                rest *= 1 - 1 / (1 + math.exp(-z))
        return 1 - rest

    texts = [words(k, 5) + ". " + words(k + 50, 9).upper() + "! " + words(k + 99, 14) for k in range(20)] + ["", None, "...", "Ünïcödé wörds ÀÉ. Ça va?", "a"]
    assert np.allclose(toxicity.score_batch(model, texts)[0], [plain(t) for t in texts], atol=1e-6)


def test_toxicity_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    doc = np.sort(rng.integers(0, 8, 25))
    row, col, y = rng.integers(0, 25, 80), rng.integers(0, 10, 80), np.arange(8) % 2 == 0
    w, b = rng.uniform(0, 1, 10), -1.5
    grad = toxicity.gradient(w, b, row, col, doc, y, 0.01)[1]
    for k in range(11):
        at = [np.where(np.arange(10) == k, step, 0.0) for step in (1e-6, -1e-6)]
        up, down = (toxicity.gradient(w + d, b + (s if k == 10 else 0), row, col, doc, y, 0.01)[0] for d, s in zip(at, (1e-6, -1e-6), strict=True))
        assert abs((up - down) / 2e-6 - grad[k]) < 1e-7


def test_toxicity_held_out(spark):
    got = queries.op1_toxicity(spark, DATA.replace("sf0.001", "sf0.1"))
    docs = spark.read.parquet(DATA.replace("sf0.001", "sf0.1") + "/documents.parquet").select("doc_id", F.length("text").alias("n"))
    clean = got.join(docs, "doc_id").join(spark.read.parquet(DATA.replace("sf0.001", "sf0.1") + "/labels.parquet").where("toxic = 0").select("doc_id"), "doc_id")
    for size in ("n < 1000", "n >= 1000 and n < 10000", "n >= 10000"):
        part = clean.where(size)
        assert part.where("predicted = 1").count() <= 0.03 * part.count() + 1, size
    labels = spark.read.parquet(DATA.replace("sf0.001", "sf0.1") + "/labels.parquet").select("doc_id", "toxic")
    r = got.where("held_out").join(labels, "doc_id").agg(F.count_if(F.expr("toxic = 1 and predicted = 1")).alias("tp"), F.count_if(F.expr("toxic = 0 and predicted = 1")).alias("fp"), F.count_if(F.expr("toxic = 1")).alias("p")).first()
    assert r.tp >= 0.8 * r.p and r.fp <= 0.1 * r.p


def test_toxicity_trains_where_the_bags_are(spark):
    """The distributed fit is that of the same texts at hand; marks of other documents and copies change nothing."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    sample = toxicity.training_rows(docs, labels, F.lit(True)).join(docs, F.expr("id = doc_id")).orderBy("id", "h").collect()
    there = docs.where("length(text) > 0").join(labels.where("toxic in (0, 1)"), "doc_id").count()
    assert len(sample) == there > 50
    local, model = toxicity.train([r.text for r in sample], [r.toxic for r in sample]), toxicity.fit(docs, labels)
    assert np.array_equal(local.weights, model.weights) and local.bias == model.bias
    foreign = spark.range(10**7, 10**7 + 40_000).selectExpr("id as doc_id", "0 as quality", "int(id % 2) as toxic")
    copies = docs.where(F.col("doc_id") == sample[0].id).crossJoin(spark.range(2000)).drop("id")
    again = toxicity.fit(docs.unionByName(copies).repartition(7), labels.unionByName(foreign, allowMissingColumns=True))
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and toxicity.fit(docs.limit(0), labels) is None


def test_toxicity_sample_is_bounded_and_drawn_from_what_exists(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(5, "text 5")] * 50 + [(None, "x"), (400, ""), (401, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, F.lit(True), max_bags=100).collect()
    assert sorted(r.toxic for r in got) == [0] * 100 + [1] * 100 and len({r.id for r in got}) == 200
    assert max(r.id for r in got) < 300
    assert len(toxicity.training_rows(docs, labels, F.lit(True)).collect()) == 300


def test_language_sample_is_not_thinned_by_copies(spark):
    rows = [(7, words(7, 30), "en")] * 4000 + [(10 + k, words(10 + k, 30), "en") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.training_rows(docs, F.lit(True)).count() == language.MAX_DOCS == 400
    assert language.training_rows(docs.where("doc_id < 200"), F.lit(True)).count() == 191


def test_language_held_out(spark):
    d = DATA.replace("sf0.001", "sf0.01")
    got = queries.op9_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def train_on(texts, langs, **how):
    parts = [language.sample_windows(t) for t in texts]
    return language.train(np.concatenate(parts), [x for x, w in zip(langs, parts, strict=True) for _ in w], **how)


def test_language_table_form_equals_convolution():
    net = train_on(["the cat and the dog", "le chat et le chien"] * 8, ["en", "fr"] * 8, epochs=2)
    x = np.random.default_rng(0).integers(0, 256, (5, language.WINDOW + 3)).astype(np.uint8)
    got = language._pooled(net, x)
    full = np.zeros((5, language.FILTERS * 3))
    for k, w in enumerate(language.WIDTHS):
        conv = sum(net.tables[k][j][x[:, j : j + language.WINDOW]] for j in range(w))
        full[:, k * 16 : (k + 1) * 16] = conv.max(1)
    assert np.allclose(got, np.maximum(full + net.bias, 0), atol=1e-4)


def test_language_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    net = language.new_network(["a", "b", "c"], 3)
    net.tables[:] = [t.astype(np.float64) for t in net.tables]
    net.bias, net.dense, net.out_bias = (p.astype(np.float64) for p in (net.bias, net.dense, net.out_bias))
    x, y, weight = rng.integers(0, 256, (6, language.WINDOW + 3)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 1]), rng.uniform(0.5, 2, 6)
    _, grads = language.gradient(net, x, y, weight)
    for p, g in zip([*net.tables, net.bias, net.dense, net.out_bias], grads, strict=True):
        # The cells that matter most, and some others.
        for at in [*np.argsort(-np.abs(g).reshape(-1))[:6], *rng.integers(0, g.size, 4)]:
            flat, step = p.reshape(-1), 1e-6
            flat[at] += step
            up = language.gradient(net, x, y, weight)[0]
            flat[at] -= 2 * step
            down = language.gradient(net, x, y, weight)[0]
            flat[at] += step
            assert abs((up - down) / (2 * step) - g.reshape(-1)[at]) < 1e-5


def test_language_score_by_definition():
    """Windows one by one, in plain loops, pooled by their filled length."""
    net = language.new_network(["a", "b", "c"], 5)
    texts = ["x" * 10, words(3, 150), "é" * 256, words(1, 45)]
    langs, scores = language.predict(net, texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        raw = text.encode()
        total = np.zeros(3)
        for at in range(0, len(raw), language.WINDOW):
            w = (raw[at : at + language.WINDOW + 3] + bytes(language.WINDOW + 3))[: language.WINDOW + 3]
            hidden = [max(0, max(sum(t[j][w[i + j]][f] for j in range(len(t))) for i in range(language.WINDOW)) + net.bias[k * 16 + f]) for k, t in enumerate(net.tables) for f in range(16)]
            z = np.array(hidden) @ net.dense + net.out_bias
            total += (z - np.log(np.exp(z - z.max()).sum()) - z.max()) * min(language.WINDOW, len(raw) - at)
        mean = total / len(raw)
        prob = np.exp(mean) / np.exp(mean).sum()
        assert lang == net.langs[int(prob.argmax())] and abs(score - prob.max()) < 1e-4


SCRIPTS = {
    "ru": "это хорошо когда всё идёт как надо и никто не спешит потому что время ещё есть",
    "uk": "це добре коли все йде як треба і ніхто не поспішає тому що час ще є та їжа готова",
    "el": "είναι καλό όταν όλα πάνε καλά και κανείς δεν βιάζεται γιατί υπάρχει ακόμα χρόνος",
    "ar": "من الجيد أن يسير كل شيء كما ينبغي ولا أحد في عجلة لأن هناك وقتا بعد",
    "fa": "خوب است که همه چیز همانطور که باید پیش می‌رود و هیچ کس عجله ندارد چون هنوز وقت هست گفت پژوهش",
    "zh": "一切都很顺利没有人着急因为还有时间我们可以慢慢地走回家",
    "ja": "すべてがうまくいくのは良いことで誰も急がないまだ時間があるからです家に帰ります",
}


def test_language_tells_scripts_apart():
    rng = random.Random(2)

    def text(lang):
        base = SCRIPTS[lang].split(" ")
        return " ".join(rng.choice(base) for _ in range(30)) if len(base) > 1 else "".join(base[0][i : i + 4] for i in (rng.randrange(len(base[0]) - 3) for _ in range(20)))

    net = train_on([text(x) for x in SCRIPTS for _ in range(60)], [x for x in SCRIPTS for _ in range(60)], epochs=15)
    fresh = [(x, text(x)) for x in SCRIPTS for _ in range(30)]
    got, _ = language.predict(net, [t for _, t in fresh])
    assert np.mean([g == x for g, (x, _) in zip(got, fresh, strict=True)]) >= 0.97


def test_any_number_of_languages_is_learned(spark):
    """90 languages, one of them with a third of the rows; long texts give windows from anywhere."""
    rng = random.Random(5)
    vocabulary = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for k in range(90)}
    text = lambda x: " ".join(rng.choice(vocabulary[x]) for _ in range(40))
    rows = [(i, text(x), x) for i, x in enumerate([x for x in vocabulary for _ in range(8)] + ["l00"] * 360)]
    rows += [(5000, "9 " * 30_000 + text("l01"), "l01"), (5001, None, "l02"), (5002, "", "l03"), (5003, "12 34", "l04"), (None, text("l05"), "l05"), (5004, text("l06"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.training_rows(df, F.lit(True), max_docs=6).groupBy("lang").count().collect()
    assert len(sample) == 90 and {r["count"] for r in sample} == {6}
    assert language.training_rows(df, F.lit(True), max_docs=6, max_sample=100).select("lang").distinct().count() == 90
    net = language.fit(df)
    found = language.language_id(df, net).join(df.select("doc_id", "lang"), "doc_id").where("doc_id < 5000")
    assert len(net.langs) == 90 and found.where("lang = lang_pred").count() >= 0.95 * found.count()


def test_windows_cover_all_bytes():
    for n in (1, 255, 256, 257, 1000):
        w = language.windows_of(np.full(n, ord("a"), np.uint8), n)
        assert (w[:, : language.WINDOW] != 0).sum() == n


def test_models_awkward(spark):
    df = awkward(spark)
    net = language.fit(df)
    got = {r.doc_id: r for r in language.language_id(df, net).where("doc_id in (5, 6, 7, 17)").collect()}
    assert {(r.lang_pred, r.score) for r in got.values()} == {("und", 0.0)}
    assert language.language_id(df, net).count() == df.count()
    assert language.language_id(empty(spark), language.fit(empty(spark))).count() == 0
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (1, 1), (16, 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert toxicity.toxicity(df, model).count() == df.count()
    assert toxicity.toxicity(df, None).where("score <> 0").count() == 0
    assert toxicity.drop_toxic(df, None).count() == df.count()
    assert toxicity.fit(empty(spark), labels.limit(0)) is None


@pytest.mark.parametrize("shape", [(1, 64), (7, 64), (5, 9, 3), (4, 4, 4), (3, 5, 2)])
def test_png_round_trip(shape):
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 256, shape, np.uint8), np.zeros(shape, np.uint8), np.cumsum(np.ones(shape, np.uint8), axis=0, dtype=np.uint8)):
        assert np.array_equal(png_column.decode_png(png_column.encode_png(x)), x)


def test_png_all_filters():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (10, 6, 3), np.uint8).astype(int)
    raw = b""
    for y in range(10):
        kind = y % 5
        line = []
        for i in range(6):
            for c in range(3):
                a = x[y, i - 1, c] if i else 0
                b = x[y - 1, i, c] if y else 0
                d = x[y - 1, i - 1, c] if i and y else 0
                p = a + b - d
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                line.append((x[y, i, c] - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        raw += bytes([kind, *line])
    data = png_column.SIGNATURE + b"".join(png_column._chunk(k, v) for k, v in ((b"IHDR", struct.pack(">IIBBBBB", 6, 10, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(raw)), (b"IEND", b"")))
    assert np.array_equal(png_column.decode_png(data), x)


def image(head, *chunks):
    body = [(b"IHDR", struct.pack(">IIBBBBB", *head)), *chunks, (b"IEND", b"")]
    return png_column.SIGNATURE + b"".join(png_column._chunk(k, v) for k, v in body)


def test_png_kinds():
    """Palette, suggested palette, low and high bit depths, interlaced."""
    idx = np.array([[0, 1, 2], [2, 1, 0]], np.uint8)
    colors = bytes(range(9))
    raw = zlib.compress(b"".join(b"\0" + bytes([r[0] << 6 | r[1] << 4 | r[2] << 2]) for r in idx.tolist()))
    want = np.arange(9, dtype=np.uint8).reshape(3, 3)[idx]
    assert np.array_equal(png_column.decode_png(image((3, 2, 2, 3, 0, 0, 0), (b"PLTE", colors), (b"IDAT", raw))), want)
    with pytest.raises(ValueError):
        png_column.decode_png(image((3, 2, 2, 3, 0, 0, 0), (b"PLTE", colors[:6]), (b"IDAT", raw)))
    flat = zlib.compress(b"".join(b"\0" + r.tobytes() for r in want))
    assert np.array_equal(png_column.decode_png(image((3, 2, 8, 2, 0, 0, 0), (b"PLTE", colors), (b"IDAT", flat[:4]), (b"IDAT", flat[4:]))), want)
    deep = np.random.default_rng(0).integers(0, 1 << 16, (4, 5)).astype(">u2")
    got = png_column.decode_png(image((5, 4, 16, 0, 0, 0, 0), (b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in deep)))))
    assert got.dtype == np.uint16 and np.array_equal(got, deep)
    for h, w in ((1, 1), (5, 3), (9, 17)):
        x = np.random.default_rng(h).integers(0, 256, (h, w, 3), np.uint8)
        laced = b"".join(b"\0" + r.tobytes() for y, c, dy, dx in png_column.PASSES if y < h and c < w for r in x[y::dy, c::dx])
        assert np.array_equal(png_column.decode_png(image((w, h, 8, 2, 0, 0, 1), (b"IDAT", zlib.compress(laced)))), x)


def test_png_of_wrong_sizes():
    line = zlib.compress(b"\0" * 65)
    for head in ((0, 1), (64, 0), (64, 2), (63, 1), (1 << 31, 1 << 31)):
        with pytest.raises(ValueError):
            png_column.decode_png(image((*head, 8, 0, 0, 0, 0), (b"IDAT", line)))
    bomb = image((64, 1, 8, 0, 0, 0, 0), (b"IDAT", zlib.compress(bytes(50_000_000))))
    with pytest.raises(ValueError, match="wrong size"):
        png_column.decode_png(bomb)
    with pytest.raises(ValueError, match="too large"):
        png_column.decode_png(png_column.encode_png(np.zeros((100, 64), np.uint8)), max_bytes=1000)
    for bad in (image((64, 1, 8, 0, 0, 0, 0)), png_column.SIGNATURE + png_column._chunk(b"IHDR", b"short") + png_column._chunk(b"IEND", b"")):
        with pytest.raises(ValueError):
            png_column.decode_png(bad)


def test_every_damaged_image_gives_a_row():
    """Bits flipped, bytes cut and inserted, in chunks whose checksums are made anew."""
    rng = np.random.default_rng(7)
    seen = set()
    for k in range(1500):
        x = rng.integers(0, 256, (int(rng.integers(1, 9)), 64), np.uint8)
        rows = zlib.compress(b"".join(bytes([int(rng.integers(0, 5))]) + r.tobytes() for r in x))
        parts = [[b"IHDR", struct.pack(">IIBBBBB", 64, len(x), 8, 0, 0, 0, 0)], [b"IDAT", rows]]
        if k % 3 == 0:
            parts.insert(1, [b"PLTE", rng.bytes(int(rng.integers(0, 12)))])
        for _ in range(int(rng.integers(1, 3))):
            part = parts[rng.integers(0, len(parts))]
            body, at = bytearray(part[1]), int(rng.integers(0, max(1, len(part[1]))))
            how = rng.integers(0, 3)
            if how == 0 and body:
                body[at] ^= 1 << int(rng.integers(0, 8))
            elif how == 1:
                del body[at : at + int(rng.integers(1, 5))]
            else:
                body[at:at] = rng.bytes(int(rng.integers(1, 5)))
            part[1] = bytes(body)
        data = png_column.SIGNATURE + b"".join(png_column._chunk(*p) for p in [*parts, (b"IEND", b"")])
        if k % 5 == 0:
            data = data[: int(rng.integers(0, len(data)))]
        got = png_column.image_features(data)
        assert len(got) == 7 and (got[5] is None) == (got[6] is not None)
        seen.add(got[6])
    assert len(seen) > 5 and None in seen


def test_cosine_hash_by_definition():
    """The hash of a 32 x 32 image from the double sum of the transform; larger ones by means of areas."""
    x = np.random.default_rng(2).integers(0, 256, (32, 32)).astype(float)
    low = []
    for u in range(8):
        for v in range(8):
            low.append(sum(x[i, j] * math.cos(math.pi * (2 * i + 1) * u / 64) * math.cos(math.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)))
    low = np.round(np.array(low), 6)
    middle = sorted(low[1:])[31]
    want = int("".join("1" if c > middle else "0" for c in low), 2)
    assert png_column.dct_hash(x) == f"{want:016x}"
    assert png_column.dct_hash(np.kron(x, np.ones((4, 2)))) == f"{want:016x}"


def test_damaged_png():
    good = png_column.encode_png(np.zeros((4, 64), np.uint8))
    for bad in (b"", b"x", good[:-5], good[:30] + b"\x00" + good[31:], good[:8]):
        with pytest.raises(ValueError):
            png_column.decode_png(bad)


def test_media_column(spark):
    df = awkward(spark)
    got = png_column.png_features(png_column.text_to_png(df)).collect()
    assert len(got) == df.count()
    for r in [g for g in got if g.doc_id == 15]:
        raw = df.where("doc_id = 15").first().text.encode()
        pad = raw + bytes(-len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert {r.payload_bytes for r in got if r.doc_id in (5, 6)} == {64}
    assert len({(r.feature, r.media_sha256) for r in got if r.doc_id in (1, 2)}) == 1
    broken = spark.createDataFrame([(1, 3, bytearray(b"no")), (2, 3, None)], "doc_id long, n_bytes long, media binary")
    assert {r.error for r in png_column.png_features(broken).collect()} == {"no PNG signature", "null"}
    assert png_column.text_to_png(empty(spark)).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bit_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 4096, 4097, 9000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = token_files.pack(ids, bits)
        assert len(data) == -(-n * bits // 8) and np.array_equal(token_files.unpack(data, bits, n), ids)
    if bits < 32:
        with pytest.raises(ValueError):
            token_files.pack(np.array([1 << bits], np.uint32), bits)


def test_shard_random_access():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 3000, 20)
    ids = rng.integers(0, 1 << 17, sizes.sum()).astype(np.uint32)
    shard = token_files.Shard(token_files.write_shard([None, *range(19)], sizes, ids, 17))
    ends = np.cumsum(sizes)
    for k in range(20):
        assert np.array_equal(shard.document(k), ids[ends[k] - sizes[k] : ends[k]])
    assert shard.doc_ids[:2] == [None, 0] and np.array_equal(shard.tokens(4000, 9000), ids[4000:9000])


def test_token_files(spark):
    df = awkward(spark)
    tok = Tokenizer.from_file(PATH)
    got = token_files.token_files(df, PATH).collect()
    assert len(got) == df.count()
    rows = sorted(((r.doc_id, r.text) for r in df.collect() if r.doc_id is not None and r.doc_id != 1))
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (by[i].n_tokens, by[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known)
    assert token_files.token_files(empty(spark), PATH).count() == 0


def test_word_encoder_is_exact():
    rng = random.Random(4)
    alpha = "aAbéÉ'.,,.'s't 're\n\t!<|endoftext|>0129ßİΣσ́ñ\x1c   中é’-_\r"
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randrange(0, 40))) for _ in range(3000)] + [None, "", "don't. Stop, it's"]
    coder = token_files.WordEncoder(PATH, 1)
    ids, sizes = coder.encode(texts)
    at = 0
    for t, n in zip(texts, sizes, strict=True):
        assert list(ids[at : at + n]) == [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        at += n


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_file_gives_its_own_ids(name):
    path = public_tokenizers.path(name)
    assert token_files.goes_by_pieces(path) == (name == "word_bpe_49k.json")
    coder = token_files.WordEncoder(path, 1)
    texts = ["Hello  World, it's HERE.", None, "", "\n tabs\tand  blanks ", "naïve Café 123 <|endoftext|> x", "x" * 300]
    ids, sizes = coder.encode(texts)
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert ids[a:b].tolist() == [*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("n_pivots", [1, 7, 20, 256])
def test_footrule_by_definition(n_pivots):
    rng = np.random.default_rng(1)
    pivots = permutation_index.unit(rng.normal(size=(n_pivots, 12)))
    units = permutation_index.unit(rng.normal(size=(40, 12)))
    got = permutation_index.footrule(permutation_index.ranks(units[:5], pivots), permutation_index.ranks(units, pivots))
    orders = [sorted(range(n_pivots), key=lambda p, u=u: -float(pivots[p] @ u)) for u in units]
    for i in range(5):
        for j in range(40):
            assert got[i, j] == sum(abs(orders[i].index(p) - orders[j].index(p)) for p in range(n_pivots))


def test_pivots_are_spread_over_a_dense_cluster():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    v = permutation_index.unit(np.concatenate([centre + 1e-3 * rng.normal(size=(3000, 16)), rng.normal(size=(1000, 16))])[rng.permutation(4000)])
    points = permutation_index.choose_pivots(v, 600)
    assert (points @ permutation_index.unit(centre[None])[0] > 0.99).mean() < 0.2


def brute_nearest(rows, k=5):
    """(query, rank, id) of the queries by all pairs, in numpy."""
    ids, u = np.array([i for i, _ in rows]), permutation_index.unit(np.array([v for _, v in rows], np.float64))
    out = set()
    for q in np.flatnonzero(ids % 50 == 0):
        score = (u * u[q]).sum(1)
        score[q] = -9
        out |= {(ids[q], r + 1, ids[i]) for r, i in enumerate(np.lexsort((ids, -np.round(score, 13)))[:k])}
    return out


def test_exact_search_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 8)).round(1)
    v[300:600] = v[300]
    v[600:700] = v[300] + 1e-3 * rng.normal(size=(100, 8))
    rows = [(i, [float(x) for x in v[i]]) for i in range(900) if v[i].any()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = permutation_index.nearest(df, df.where("vec_id % 50 = 0"), pivots=40, visited=40, rerank=900)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got.collect()} == brute_nearest(rows)


def test_vectors_of_extreme_size_and_other_lengths(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2e199]), (2, [1e-200, 1e-200]), (3, [5e-324, 0.0]), (50, [0.0, 1e-310]), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in permutation_index.nearest(df, df.where("vec_id % 50 = 0")).collect())
    a, b = round(1 / math.sqrt(2), 9), round(1 / math.sqrt(1.04), 9)
    assert got == [(0, 1, 3, 1.0), (0, 2, 1, b), (0, 3, 2, a), (0, 4, 50, 0.0), (50, 1, 2, a), (50, 2, 1, round(0.2 * b, 9)), (50, 3, 0, 0.0), (50, 4, 3, 0.0), (100, 1, 5, 1.0)]


def test_each_length_of_vector_has_its_own_index(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8 if i % 3 else 5)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = permutation_index.nearest(df, df.where("vec_id % 50 = 0"), pivots=20, visited=20, rerank=600).collect()
    want = set()
    for part in ([r for r in rows if len(r[1]) == d] for d in (5, 8)):
        want |= brute_nearest(part)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == want and len({r.query_id for r in got}) == 12


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 32)).astype(np.float32)
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in permutation_index.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        hit += len(set(want) & {x for x, _ in got[q].values()})
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        for x, score in got[q].values():
            assert abs(score - s[x]) < 1e-12
    assert hit >= 0.9 * 300
    assert [got[100][k][0] for k in range(1, 6)] == [101, 102, 103, 104, 105]


def test_nearest_awkward(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (None, [1.0, 0.0]), (6, [float("inf"), 0.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("vector", F.lit(2))
    got = [(r.query_id, r["rank"], r.vec_id) for r in permutation_index.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert permutation_index.nearest(df.limit(0), df.limit(0)).count() == 0
