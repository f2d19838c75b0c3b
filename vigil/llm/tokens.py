"""Token-id files: documents as zstd frames sharing one trained dictionary.

Encoding uses the ``tokenizers`` library.  Its regular-expression splitter is
the slow part, so texts made of common Latin characters only are split here by
the same rule and every distinct word is encoded by the library once per
worker; any other text goes to the library whole.

File format: one Parquet row per block of neighbouring documents,
``(part, block, before, first_doc, last_doc, dict_sha256, id_bytes, doc_ids[],
n_tokens[], offsets[], payload)``; ``before`` counts the ids of the part's earlier
blocks.  ``payload`` is the concatenation of one zstd frame per
document; ``offsets`` (one entry more than documents) is the index, so one
short document is read by slicing its frame.  Ids are stored as little-endian
unsigned integers of ``id_bytes`` bytes.  Rows are in ascending doc_id order
within and across blocks, which lets Parquet statistics find a document's
block.  The dictionary is one row ``(dict_sha256, dictionary)`` beside it, and
readers refuse a block that names another dictionary.

Defined results: a null text is empty and has only the end id; rows repeating
a doc_id are stored one after the other (ordered by a hash of their text);
rows without doc_id come first; an empty table gives no blocks; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.base import partitions, query, table, write_table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
DICT_BYTES = 64 << 10
#: The dictionary is trained on about this many pieces of this many characters, drawn by hash from whole texts.
SAMPLE_PIECES = 4000
PIECE_BYTES = 4 << 10
BLOCK_BYTES = 1 << 20        # compressed bytes after which a block is closed
LEVEL = 3
WORD_CACHE = 400_000         # distinct words in each of the two generations a worker remembers

# The splitting rule of the byte-level tokenizer, with its letter and number classes
# spelled out for the characters of _PLAIN (printable ASCII, tab, line ends, Latin-1 and Latin Extended letters).
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_PLAIN = re.compile("[^\\x20-\\x7e\\t\\n\\r¡-¬®-ɏ]")
_SPLIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\\s{_LETTER}{_NUMBER}]+|\\s+(?!\\S)|\\s+")
# Byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for characters from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_BLANK = chr(_BYTE_CHARS[0x20])


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def shown(word: str) -> str:
    """A word in the byte-level alphabet."""
    if word.isascii() and word.isprintable():
        return word.replace(" ", _BLANK)
    return word.encode().decode("latin-1").translate(_BYTE_CHARS)


class Words(dict):
    """Word -> packed ids; a missing word is encoded once.  When full, the older half is forgotten."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word) or self.encode(word)
        if len(self) >= WORD_CACHE:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Texts -> little-endian id arrays, with a word cache."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer
        self.tk = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2") if max(self.tk.get_vocab_size(), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = self.pack([end_id])
        self.model, self.words = self.tk.model, Words(self._word)
        # only a byte-level splitter with this rule may be replaced by _SPLIT
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.split = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
                      and not spec.get("normalizer"))

    def _word(self, word: str) -> bytes:
        """Ids of one split word, straight from the library's model (no second splitting)."""
        return self.pack([t.id for t in self.model.tokenize(shown(word))])

    def pack(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text and the end id."""
        get, out = self.words.__getitem__, []
        for t in texts:
            if self.split and not _PLAIN.search(t) and not any(s in t for s in self.special):
                out.append(b"".join(map(get, _SPLIT.findall(t))) + self.end)
            else:
                out.append(self.pack(self.tk.encode(t, add_special_tokens=False).ids) + self.end)
        return out


_encoders: dict = {}


def _encoder(path: str, end_id: int) -> Encoder:
    """One encoder per Python worker (the word cache lives on between tasks)."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _texts(batch: pa.RecordBatch, step: int = 200):
    """(first, stop, texts) of a batch, null as empty."""
    col = batch.column("text")
    for i in range(0, batch.num_rows, step):
        yield i, min(i + step, batch.num_rows), [t or "" for t in col.slice(i, step).to_pylist()]


def train_dictionary(docs: DataFrame, path: str, end_id: int = END_ID, size: int = DICT_BYTES) -> bytes:
    """zstd dictionary from pieces of serialized ids; b"" when there is too little to train on.

    Every document's text counts as ceil(characters / PIECE_BYTES) pieces, and each piece is drawn by a hash of
    (doc_id, text, piece) at one rate, so any part of a text may be chosen and the result does not depend on
    partitions.  Only drawn pieces are encoded.  The rate bounds the expected number of pieces;
    equal rows hash alike, so a drawn (doc_id, text) counts once however often its row repeats.
    """
    scale = 1 << 30
    n_pieces = F.greatest(F.ceil(F.length("text") / F.lit(PIECE_BYTES)), F.lit(1)).cast("long")
    total = docs.agg(F.sum(n_pieces).alias("n")).first()["n"] or 1
    limit = min(scale, max(1, scale * SAMPLE_PIECES // total))
    drawn = F.filter(F.sequence(F.lit(0).cast("long"), n_pieces - 1),
                     lambda k: F.pmod(F.xxhash64("doc_id", "text", k), F.lit(scale)) < limit)
    start = (F.lit(PIECE_BYTES) * F.col("piece") + 1).cast("int")
    pieces = (docs.filter(F.col("text").isNotNull()).select("doc_id", "text", F.explode(drawn).alias("piece"))
              .select("doc_id", "piece", F.substring("text", start, F.lit(PIECE_BYTES)).alias("text")).distinct())

    def run(batches):
        enc = _encoder(path, end_id)
        for batch in batches:
            for i, j, texts in _texts(batch):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "piece")), pa.array(enc.encode(texts), pa.binary())],
                                                 names=["doc_id", "piece", "ids"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn_ids = pieces.mapInArrow(run, f"doc_id {kind}, piece long, ids binary")
    data = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], bytes(r["ids"])) for r in drawn_ids.collect())
    try:
        return zstandard.train_dictionary(size, [x[3] for x in data]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` (doc_id, text) as (blocks, dictionary) tables; both are returned as read back."""
    spark = docs.sparkSession
    raw = train_dictionary(docs, path, end_id)
    sha = hashlib.sha256(raw).hexdigest()
    dictionary = write_table(spark.createDataFrame([(sha, bytearray(raw))], "dict_sha256 string, dictionary binary"), "token-dict")
    # range partitions in doc_id order; texts travel once, and what is written is already compressed
    rows = (docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
            .repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
            .withColumn("part", F.spark_partition_id()))
    shared = spark.sparkContext.broadcast(raw)          # DICT_BYTES at most

    def run(batches):
        enc = _encoder(path, end_id)
        zst = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        ids: list = []
        sizes: list = []
        frames: list = []
        part, block, before, held = 0, 0, 0, 0

        def close():
            offs = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            known = [d for d in ids if d is not None] or [None]
            return pa.RecordBatch.from_pylist([{
                "part": part, "block": block, "before": before, "first_doc": known[0], "last_doc": known[-1], "dict_sha256": sha, "id_bytes": enc.kind.itemsize,
                "doc_ids": ids, "n_tokens": sizes, "offsets": offs, "payload": b"".join(frames)}], schema=kind)
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            names = batch.column("doc_id").to_pylist()
            for i, j, texts in _texts(batch):
                for d, b in zip(names[i:j], enc.encode(texts)):
                    frame = zst.compress(b)
                    ids.append(d)
                    sizes.append(len(b) // enc.kind.itemsize)
                    frames.append(frame)
                    held += len(frame)
                    if held >= BLOCK_BYTES:
                        yield close()
                        before += sum(sizes)
                        ids, sizes, frames, held, block = [], [], [], 0, block + 1
        if ids:
            yield close()
    kind = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
                      ("dict_sha256", pa.string()), ("id_bytes", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                      ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
    blocks = rows.mapInArrow(run, "part int, block long, before long, first_doc long, last_doc long, dict_sha256 string, id_bytes int, "
                                  "doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary")
    return write_table(blocks, "token-blocks"), dictionary


def starts(blocks: DataFrame) -> DataFrame:
    """``blocks`` plus ``start``: the ids of all documents before each block.

    Totals per part (as many as shuffle partitions) give the parts' starts; a block knows its place in its part.
    """
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum(size).alias("n")).collect())
    rows, at = [], 0
    for p, n in totals:
        rows.append((p, at))
        at += n
    base = blocks.sparkSession.createDataFrame(rows, "part int, base long")
    # one row per part: the bound of the broadcast is the number of shuffle partitions; payloads stay where they are
    return blocks.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def _frames(blocks: DataFrame, raw: bytes, kernel, schema: str) -> DataFrame:
    """Run ``kernel(row, decompressor)`` over every block, after checking its dictionary."""
    sha = hashlib.sha256(raw).hexdigest()

    def run(batches):
        zst = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["dict_sha256"] != sha:
                    raise ValueError("a block names another dictionary")
                yield kernel(row, zst)
    return blocks.mapInArrow(run, schema)


def read_tokens(blocks: DataFrame, dictionary: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every stored document: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    raw = bytes(dictionary.first()["dictionary"])
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kind = pa.schema(fields + ([("ids", pa.list_(pa.int64()))] if with_ids else []))

    def kernel(row, zst):
        at, sizes, crcs, ids = row["start"], [], [], []
        for a, b, n in zip(row["offsets"], row["offsets"][1:], row["n_tokens"]):
            data = np.frombuffer(zst.decompress(row["payload"][a:b]), f"<u{row['id_bytes']}")
            if len(data) != n:
                raise ValueError("a frame's length differs from the index")
            sizes.append(len(data))
            crcs.append(zlib.crc32(data.astype("<u4").tobytes()))
            if with_ids:
                ids.append(data.astype(np.int64))
        begin = at + np.cumsum(sizes) - sizes
        cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(begin), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
        return pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else []), schema=kind)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return _frames(starts(blocks), raw, kernel, schema)


def fetch(spark: SparkSession, blocks: DataFrame, dictionary: DataFrame, doc_id: int) -> list[np.ndarray]:
    """Ids of one document: only blocks whose range holds it are read, and of them only its frames are unpacked."""
    raw = bytes(dictionary.first()["dictionary"])
    zst = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    at = F.explode(F.filter(F.sequence(F.lit(1), F.size("doc_ids")), lambda i: F.element_at("doc_ids", i) == doc_id))
    hit = (blocks.filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).withColumn("at", at)
           .select("part", "block", "at", "id_bytes", F.expr("substring(payload, int(offsets[at-1]) + 1, int(offsets[at] - offsets[at-1]))").alias("frame")))
    return [np.frombuffer(zst.decompress(bytes(r["frame"])), f"<u{r['id_bytes']}") for r in hit.orderBy("part", "block", "at").collect()]


@query("op7_token_files")
def token_files(spark, sf_dir):
    """Encode, write and read back all documents."""
    return read_tokens(*write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))
