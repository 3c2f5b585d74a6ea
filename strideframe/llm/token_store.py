"""Token ids in binary shards: one zstandard frame a document, one shared dictionary, an index for single documents.

A store is a folder in a file system that driver and executors share:

    dictionary        the zstandard dictionary, trained on the serialized ids of a bounded sample of documents
    shard-P-S.tok     documents in ascending order of doc_id; P counts ranges of ids, S shards of a range
    manifest/         a Parquet row for each shard: its numbers P and S, its file, documents and tokens

A shard: 8 bytes "IDSHARD1", 32 bytes SHA-256 of the dictionary, 8 bytes bytes-per-id, 8 bytes number of documents n; then n
doc_ids (signed 64 bit), n bytes telling whether the doc_id is there, n + 1 frame offsets and n token counts (unsigned 64
bit); then the frames, each a document's ids as little-endian integers, compressed alone with the dictionary. All numbers
are little-endian. A reader checks the hash before it decodes and reaches any document through its offset: read_one takes a few
bytes of the index and one frame from a file of any size.

Tokenizing: ids never cross white space, so that a task encodes each distinct word once and puts documents together from
the words' ids. Tasks write under a temporary name and rename, so a task that runs twice leaves the same file.

Edge cases: a null text has no tokens but the end id; a null doc_id is kept and sorts first; rows with equal ids are all
kept, in the order of a hash of their texts, so that an id of many rows is spread over ranges. An empty table gives a store without shards. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_text, file_system, hash_below, in_short_batches, new_path, slices

MAGIC = b"IDSHARD1"
SAMPLE_DOCS, DICTIONARY_BYTES, LEVEL = 1500, 64 * 1024, 3
#: Most documents and, by the sample, characters of a range of ids, which one task writes.
DOCS_PER_RANGE, CHARS_PER_RANGE = 32_000, 48_000_000
SHARD_BYTES, SLICE = 32 * 1024 * 1024, 8_000_000
#: Characters of a sampled document that the dictionary learns from; the dictionary changes sizes only, never ids.
LEARNED_CHARS = 20_000
#: White space to Python that the tokenizer takes for ordinary characters.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Marks that are cut off a word's end.
MARKS = ".,;:!?|%&#*$()"


class Numbers(dict):
    """Words by order of their first sight; fresh: those since it was last emptied."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class WordEncoder:
    """Encodes texts through a tokenizers file, asking the library once for each distinct word.

    Known words stay between calls, up to a bound. A new word that is letters with marks behind them is looked up as its
    lower-case letters and its marks, which the tokenizer takes apart anyway; letters-only words go to the library many at
    a time, as one text in which every word's last token carries the end-of-word suffix.
    """

    def __init__(self, tokenizer_path: str, end_id: int | None, known_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.known_words = Tokenizer.from_file(tokenizer_path), end_id, known_words
        self.id_bytes = 2 if max(self.tokenizer.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.index = Numbers()
        self.cores: dict[str, np.ndarray] = {}
        self.flat, self.sizes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def _ask(self, parts: list[str]) -> None:
        """Put the ids of parts without white space into self.cores."""
        letters = [p for p in parts if p.isalpha()]
        ids = np.array(self.tokenizer.encode(" ".join(letters), add_special_tokens=False).ids, dtype=np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(letters):
            self.cores.update(zip(letters, np.split(ids, cuts[:-1]) if letters else [], strict=True))
            parts = [p for p in parts if not p.isalpha()]
        for p, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            self.cores[p] = np.array(e.ids, dtype=np.uint32)

    def _learn(self, words: list[str]) -> None:
        split = []
        for w in words:
            plain = w.isascii() or (max(w) < "\u0130" and unicodedata.is_normalized("NFC", w))
            low = w.lower() if plain else w
            core = low.rstrip(MARKS) if plain else low
            split.append((core, low[len(core) :]) if plain and core.isalpha() else (w, ""))
        new = [p for p in dict.fromkeys(chain.from_iterable(split)) if p and p not in self.cores]
        for k in range(0, len(new), 5000):
            self._ask(new[k : k + 5000])
        none = np.zeros(0, dtype=np.uint32)
        parts = [self.cores[p] if p else none for p in chain.from_iterable(split)]
        sizes = np.array([len(x) for x in parts], dtype=np.int64).reshape(-1, 2).sum(axis=1)
        self.flat, self.sizes = np.concatenate([self.flat, *parts]), np.concatenate((self.sizes, sizes))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        end = np.array([] if self.end_id is None else [self.end_id], dtype=np.uint32)
        if len(self.index) > self.known_words:
            self._forget()
        number, rows = self.index.__getitem__, []
        for t in texts:
            words = [] if not t else [t] if ODD_SPACE.search(t) else t.split()
            rows.append(np.fromiter(map(number, words), np.int64, len(words)))
        fresh, self.index.fresh = self.index.fresh, []
        self._learn(fresh)
        starts = np.cumsum(self.sizes) - self.sizes
        out = []
        for at in rows:
            n = self.sizes[at]
            spots = np.arange(int(n.sum())) + np.repeat(starts[at] - (np.cumsum(n) - n), n)
            out.append(np.concatenate((self.flat[spots], end)))
        return out


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _zdict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray], dictionary: bytes, id_bytes: int) -> bytes:
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(dictionary))
    return pack_frames(doc_ids, [packer.compress(x.astype(f"<u{id_bytes}").tobytes()) for x in ids], [len(x) for x in ids], dictionary, id_bytes)


def pack_frames(doc_ids: list[int | None], frames: list[bytes], counts: list[int], dictionary: bytes, id_bytes: int) -> bytes:
    n = len(doc_ids)
    head = MAGIC + hashlib.sha256(dictionary).digest() + np.array([id_bytes, n], dtype="<u8").tobytes()
    index = np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes() + np.array([i is not None for i in doc_ids], dtype="u1").tobytes()
    at = len(head) + len(index) + 8 * (2 * n + 1)
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<u8") + np.uint64(at)
    return b"".join((head, index, offsets.tobytes(), np.array(counts, dtype="<u8").tobytes(), *frames))


def read_one(uri: str, k: int, dictionary: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of document k of a shard file, of which only the head, its index entries and its frame are read."""
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        head = f.read_at(56, 0)
        _check(head, dictionary)
        id_bytes, n = map(int, np.frombuffer(head, "<u8", 2, 40))
        if not 0 <= k < n:
            raise IndexError(k)
        key = int(np.frombuffer(f.read_at(8, 56 + 8 * k), "<i8")[0]) if f.read_at(1, 56 + 8 * n + k) == b"\1" else None
        begin, end = map(int, np.frombuffer(f.read_at(16, 56 + 9 * n + 8 * k), "<u8"))
        frame = f.read_at(end - begin, begin)
    return key, _ids(zstandard.ZstdDecompressor(dict_data=_zdict(dictionary)), frame, id_bytes)


def _check(head: bytes, dictionary: bytes) -> None:
    if head[:8] != MAGIC or head[8:40] != hashlib.sha256(dictionary).digest():
        raise ValueError("not a shard of this dictionary")


def _ids(unpacker: zstandard.ZstdDecompressor, frame: bytes, id_bytes: int) -> np.ndarray:
    return np.frombuffer(unpacker.decompress(frame), dtype=f"<u{id_bytes}").astype("<u4")


class Shard:
    """Reader of one shard; documents are decoded one by one."""

    def __init__(self, data: bytes, dictionary: bytes):
        _check(data, dictionary)
        self.data, self.unpacker = data, zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))
        self.id_bytes, n = map(int, np.frombuffer(data, "<u8", 2, 40))
        known = np.frombuffer(data, "u1", n, 56 + 8 * n)
        self.doc_ids = [int(i) if k else None for i, k in zip(np.frombuffer(data, "<i8", n, 56), known, strict=True)]
        self.offsets = np.frombuffer(data, "<u8", n + 1, 56 + 9 * n).astype(np.int64)
        self.counts = np.frombuffer(data, "<u8", n, 64 + 17 * n).astype(np.int64)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        return _ids(self.unpacker, self.data[self.offsets[k] : self.offsets[k + 1]], self.id_bytes)


def put(uri: str, data: bytes) -> None:
    """Write a file of a shared file system whole or not at all."""
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{os.getpid()}-{os.urandom(4).hex()}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


MANIFEST = "range long, number long, shard string, docs long, tokens long"


def write(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int | None = None, docs_per_range: int = DOCS_PER_RANGE, chars_per_range: int = CHARS_PER_RANGE, limit: int = SHARD_BYTES) -> bytes:
    """Write the store of (doc_id, text) into the folder; returns the dictionary."""
    docs = in_short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = docs.count()
    begun = F.substr("text", F.lit(1), F.lit(LEARNED_CHARS)).alias("text")
    drawn = docs.filter(hash_below(F.col("doc_id"), SAMPLE_DOCS / max(n, 1), 13)).select(begun, F.length("text").alias("chars")).limit(2 * SAMPLE_DOCS).toPandas()
    encoder = WordEncoder(tokenizer_path, end_id)
    id_bytes = encoder.id_bytes
    dictionary = train_dictionary([x.astype(f"<u{id_bytes}").tobytes() for part in slices(drawn["text"]) for x in encoder.encode(part)])
    put(f"{folder}/dictionary", dictionary)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, number = WordEncoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(dictionary))
        doc_ids, frames, counts, size = [], [], [], 0

        def flush() -> pd.DataFrame:
            name = f"shard-{part}-{number}.tok"
            put(f"{folder}/{name}", pack_frames(doc_ids, frames, counts, dictionary, id_bytes))
            return pd.DataFrame({"range": [part], "number": [number], "shard": [name], "docs": [len(doc_ids)], "tokens": [sum(counts)]})

        for b in batches:
            at = 0
            for texts in slices(b["text"], SLICE):
                keys = b["doc_id"].iloc[at : at + len(texts)]
                at += len(texts)
                for key, ids in zip(keys, encoder.encode(texts), strict=True):
                    doc_ids.append(None if pd.isna(key) else int(key))
                    frames.append(packer.compress(ids.astype(f"<u{id_bytes}").tobytes()))
                    counts.append(len(ids))
                    size += len(frames[-1])
                    if size >= limit:
                        yield flush()
                        doc_ids, frames, counts, size, number = [], [], [], 0, number + 1
        if doc_ids:
            yield flush()

    chars = n * float(drawn["chars"].fillna(0).mean()) if len(drawn) else 0.0
    ranges = max(1, -(-n // docs_per_range), math.ceil(chars / chars_per_range))
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(ranges, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").select(as_text(), "text")
    ordered.mapInPandas(shards, MANIFEST).write.parquet(f"{folder}/manifest")
    return dictionary


def read(spark: SparkSession, folder: str, dictionary: bytes) -> DataFrame:
    """doc_id, start, ids (array of long) of every document of the store."""
    return _read(spark, folder, dictionary, "ids array<long>", lambda ids: ids.astype(np.int64))


def digests(spark: SparkSession, folder: str, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded ids."""
    return _read(spark, folder, dictionary, "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()))


def _read(spark: SparkSession, folder: str, dictionary: bytes, column: str, of) -> DataFrame:
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # One row a range, tens of megabytes of text each, is small enough to number in one task; shards are numbered in their range.
    ranges = manifest.groupBy("range").agg(F.sum("tokens").alias("tokens"))
    behind = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("range", behind(Window.orderBy("range")).alias("first"))
    manifest = manifest.join(ranges, "range").select("shard", (F.col("first") + behind(Window.partitionBy("range").orderBy("number"))).alias("base"))
    name = column.split()[0]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                shard = Shard(bytes(content), dictionary)
                start = np.concatenate(([0], np.cumsum(shard.counts)[:-1]))
                for k in range(0, len(shard), 2000):
                    span = range(k, min(k + 2000, len(shard)))
                    yield pd.DataFrame({"shard": path.rpartition("/")[2], "doc_id": pd.array([shard.doc_ids[i] for i in span], dtype="Int64"), "own": start[span], "n_tokens": shard.counts[span], name: [of(shard.ids(i)) for i in span]})

    if manifest.isEmpty():
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {column}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content")
    found = files.mapInPandas(decode, f"shard string, doc_id long, own long, n_tokens long, {column}")
    return found.join(manifest, "shard").select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", name)


def encode_and_read_back(docs: DataFrame, tokenizer_path: str, *, end_id: int) -> DataFrame:
    folder = new_path(docs.sparkSession, "tokens")
    return digests(docs.sparkSession, folder, write(docs, tokenizer_path, folder, end_id=end_id))
