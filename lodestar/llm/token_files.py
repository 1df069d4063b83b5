"""Token ids in fixed-width bit-packed shards with random access.

A shard holds whole documents in id order: a header, the documents' ids and token
offsets, block offsets, then blocks of BLOCK tokens, each id in the least number of
bits that the vocabulary needs, least significant bit first.  BLOCK is a multiple of
8, so blocks are byte-aligned and numpy unpacks any of them alone.  Shards are binary
values of a Parquet table, which Spark's committers write to any shared store and
which a lost executor cannot leave half-written.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import kernels as K
from lodestar.llm.scratch import Scratch

MAGIC, HEAD = b"LSTOKEN1", "<8sIIQQ"
BLOCK = 4096
SHARD_TOKENS = 1 << 20
#: Pieces whose ids a worker remembers; then it forgets all.
CACHE = 1_000_000


def bits_for(vocab_size: int) -> int:
    """Bits that tell ``vocab_size`` ids apart."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Packs ids into ``bits`` bits each, least significant bit first."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), BLOCK):
        part = ids[at : at + BLOCK].astype("<u4")
        wide = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
        out.append(np.packbits(wide.reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    out, step = [], BLOCK * bits // 8
    for at in range(0, count, BLOCK):
        n = min(BLOCK, count - at)
        raw = np.frombuffer(data, np.uint8, -(-n * bits // 8), at // BLOCK * step)
        wide = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
        full = np.zeros((n, 32), np.uint8)
        full[:, :bits] = wide
        out.append(np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_shard(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One shard of whole documents; ``sizes`` are their token counts."""
    offsets = np.zeros(len(sizes) + 1, "<i8")
    np.cumsum(sizes, out=offsets[1:])
    blocks = np.arange(-(-len(ids) // BLOCK) + 1, dtype="<i8") * (BLOCK * bits // 8)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([0 if x is None else x for x in doc_ids], "<i8")
    head = struct.pack(HEAD, MAGIC, bits, BLOCK, len(doc_ids), len(ids))
    return b"".join([head, names.tobytes(), known.tobytes(), offsets.tobytes(), blocks.tobytes(), pack(ids, bits)])


class Shard:
    """Random access to the documents and tokens of a shard."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, n, self.n_tokens = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)
        names = np.frombuffer(data, "<i8", n, at)
        known = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [int(x) if k else None for x, k in zip(names, known, strict=True)]
        at += 9 * n
        self.offsets = np.frombuffer(data, "<i8", n + 1, at)
        at += 8 * (n + 1)
        n_blocks = -(-self.n_tokens // self.block)
        self.blocks = np.frombuffer(data, "<i8", n_blocks + 1, at)
        self.payload = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; reads only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        count = min(self.n_tokens, (last + 1) * self.block) - first * self.block
        ids = unpack(self.payload[int(self.blocks[first]) :], self.bits, count)
        return ids[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.offsets[k]), int(self.offsets[k + 1]))


#: A word of small Latin letters before a blank, point, comma or the end; a point or
#: comma before a blank or the end; or all up to the next blank.
_PIECE = re.compile(r"[a-zß-öø-ÿ]++(?=[ \t\n\r\f\v.,]|\Z)|[.,](?=[ \t\n\r\f\v]|\Z)|[^ \t\n\r\f\v]+")
_FOREIGN = re.compile(r"<\||[^\u0000-\u024f]")


#: The text rules, as tokenizer files state them, for which pieces may be
#: encoded one by one.
PIECE_RULES = {
    "normalizer": [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)],
    "pre_tokenizer": [("Split", "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"), ("ByteLevel", None)],
}


def goes_by_pieces(path: str) -> bool:
    """Whether a tokenizer file states just the rules under which ``WordEncoder`` may split."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def rules(part: str, many: str) -> list[tuple[str, str | None]]:
        top = spec.get(part) or {}
        steps = top.get(many, [top] if top else [])
        return [(x.get("type"), (x.get("pattern") or {}).get("Regex")) for x in steps]

    split = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"]
    plain = all(x.get("behavior") == "Removed" and x.get("invert") for x in split)
    blanks = [x.get("content") for x in (spec.get("normalizer") or {}).get("normalizers", []) if x.get("type") == "Replace"]
    special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
    alike = rules("normalizer", "normalizers") == PIECE_RULES["normalizer"] and rules("pre_tokenizer", "pretokenizers") == PIECE_RULES["pre_tokenizer"]
    return alike and plain and special and blanks == [" "] and spec.get("model", {}).get("type") == "BPE"


class WordEncoder:
    """Encodes texts by pieces and remembers the pieces' ids.

    This holds for tokenizers that lower-case, split on white space and keep runs of
    letters apart from points and commas: the ids of a text are then those of its pieces
    in turn.  Texts with characters beyond Latin, or that may hold special tokens, are not
    lower-cased here but left to the tokenizer.  If the tokenizer's file states other
    rules, whole texts go through it.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.by_pieces = Tokenizer.from_file(path), end_id, goes_by_pieces(path)
        self.vocab = self.tokenizer.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        class Known(dict):
            def __missing__(known, piece: str) -> int:
                known[piece] = at = len(known)
                new.append(piece)
                return at

        self.new = new = []
        self.known = Known()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _store(self, numbers: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Appends the ids of pieces; ``numbers`` are the pieces' own, ``counts`` their ids."""
        need, top = self.used + len(ids), len(self.known)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.uint32)])
        if top > len(self.starts):
            more = np.zeros(max(top, len(self.starts)), np.int32)
            self.starts, self.sizes = np.concatenate([self.starts, more]), np.concatenate([self.sizes, more])
        self.flat[self.used : need] = ids
        self.starts[numbers] = self.used + np.cumsum(counts) - counts
        self.sizes[numbers] = counts
        self.used = need

    def _learn(self) -> None:
        """Ids of the new pieces: words of letters many at once, others one by one."""
        first = len(self.known) - len(self.new)
        letters = np.fromiter(map(str.isalpha, self.new), bool, len(self.new))
        plain, alone = np.flatnonzero(letters), np.flatnonzero(~letters).tolist()
        words = list(itertools.compress(self.new, letters))
        for at in range(0, len(words), 2000):
            part = plain[at : at + 2000]
            e = self.tokenizer.encode(" ".join(words[at : at + 2000]), add_special_tokens=False)
            # A word of letters is one unit of the tokenizer; if not, these go one by one.
            counts = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            if len(counts) != len(part) or not counts.all():
                alone += part.tolist()
            else:
                self._store(first + part, counts, np.array(e.ids, np.uint32))
        for at in range(0, len(alone), 500):
            part = alone[at : at + 500]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([self.new[i] for i in part], add_special_tokens=False)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self._store(first + np.array(part), counts, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts.sum())))
        self.new.clear()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text ended by the end id, and the number of each text."""
        if not self.by_pieces:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found)) + 1
            return np.array([i for ids in found for i in (*ids, self.end_id)], np.uint32), counts
        if len(self.known) > CACHE:
            self._forget()
        words: list[str] = []
        ends = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                foreign = "<|" in t if t.isascii() else _FOREIGN.search(t)
                words += _PIECE.findall(t if foreign else t.lower())
            ends[i] = len(words)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.new:
            self._learn()
        size = self.sizes[at].astype(np.int64)
        total = np.zeros(len(words) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.starts[at] - total[:-1], size)]
        last = total[ends]
        counts = np.diff(last, prepend=0) + 1
        return np.insert(ids, last, self.end_id), counts


_CODERS: dict[tuple[str, int], WordEncoder] = {}


def coder_for(path: str, end_id: int) -> WordEncoder:
    """The encoder of this worker process, kept from task to task."""
    if (path, end_id) not in _CODERS:
        _CODERS[path, end_id] = WordEncoder(path, end_id)
    return _CODERS[path, end_id]


def _encode(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        coder = coder_for(path, end_id)
        bits, part, seq = bits_for(max(coder.vocab, end_id + 1)), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        total = 0

        def shard():
            data = write_shard(names, np.concatenate(counts), np.concatenate(held), bits)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([total]), pa.array([data], pa.binary())], ["part", "seq", "n_tokens", "data"])

        for batch in batches:
            for piece, texts in K.slices(batch, "text", 500_000):
                ids, sizes = coder.encode(texts)
                names += piece.column(0).to_pylist()
                held.append(ids)
                counts.append(sizes)
                total += len(ids)
                if total >= SHARD_TOKENS:
                    yield shard()
                    names, held, counts, total, seq = [], [], [], 0, seq + 1
        if names:
            yield shard()

    return run


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all texts' ids as shards, in ascending id order, to the table ``path``.

    Rows (part, seq, n_tokens, data); documents ascend within a shard, shards by
    (part, seq).  Null ids come first; rows of one id lie by text.  Null and empty
    texts are the end id alone.  An empty table writes an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Rows without id may be many; their texts spread them.
    order = [F.col("id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = ordered.mapInArrow(_encode(tokenizer, end_id), "part long, seq long, n_tokens long, data binary")
    shards.write.mode("overwrite").option("compression", "none").parquet(path)


def _read(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            shard = Shard(batch.column(2)[k].as_py())
            n = len(shard.doc_ids)
            ids = shard.tokens(0, shard.n_tokens)
            o = shard.offsets
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(k, 1).take(pa.array(np.zeros(n, np.int64))),
                    batch.column(1).slice(k, 1).take(pa.array(np.zeros(n, np.int64))),
                    pa.array(shard.doc_ids, pa.int64()),
                    pa.array(o[:-1], pa.int64()),
                    pa.array(np.diff(o), pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(o, o[1:], strict=False)], pa.int64()),
                ],
                ["part", "seq", "id", "at", "n_tokens", "ids_crc32"],
            )


def read_token_shards(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document of a shard table.

    ``start`` counts the ids of all documents before: totals by part, then by shard in
    its part, then by document in its shard, so that no task sums over everything but
    the parts' totals, one row each.
    """
    shards = spark.read.schema("part long, seq long, n_tokens long, data binary").parquet(path)
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = sizes.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("seq_start"))
    starts = within.join(before, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("start"))
    documents = shards.select("part", "seq", "data").mapInArrow(_read, "part long, seq long, id long, at long, n_tokens long, ids_crc32 long")
    return documents.join(starts, ["part", "seq"]).select(F.col("id").alias(id_col), (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes shards to the shared folder and reads them back, one row a document."""
    spark = docs.sparkSession
    path = f"{Scratch(spark, 'tokens').path}/shards"
    write_token_shards(docs, path, tokenizer, end_id)
    return read_token_shards(spark, path)
