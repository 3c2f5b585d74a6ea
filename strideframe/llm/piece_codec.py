"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The vocabulary of a SentencePiece model gives pieces with scores. A text is normalised as an identity model does (a space in
front, spaces as U+2581), cut into words (marks and what follows them; no piece reaches over a word's end) and each distinct
word of a batch is segmented once. Words of equal length advance together: at every position the hashes of all substrings
that end there probe the sorted hashes of the pieces, and vectorised maxima keep the best score and its length as
backpointer. Characters without a piece cost PENALTY more than the worst piece and become byte pieces.

This is the segmentation of greatest total score. For a model of type BPE the library merges greedily by rank instead; its
ids can differ, and both decode to the same text. Ties go to the longer last piece. Edge cases: null and empty texts have no
pieces and decode to the empty text; U+2581 in a text is a space, as in the library. Extra columns are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, free_name, id_type, in_short_batches, slices

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
PENALTY = 10.0
#: Words whose segmentation a task keeps between batches.
KNOWN_WORDS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def _key(prefix_end: np.ndarray, prefix_begin: np.ndarray, size: int) -> np.ndarray:
    """Hash of the substrings between two prefixes, from the prefixes' polynomial hashes."""
    power = np.uint64(pow(int(BASE), size, 1 << 64))
    x = prefix_end - prefix_begin * power + np.uint64(size * 0xD6E8FEB86659FD93 % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """(words, length + 1) polynomial hashes of all prefixes; codes: (words, length) code points."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + (codes[:, j].astype(np.uint64) + np.uint64(1))
    return out


class PieceCodec:
    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        self.bytes = []
        normal = []
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
            else:
                self.bytes.append(b"" if special[i] else p.replace(MARK, " ").encode())
                if not special[i]:
                    normal.append(i)
        self.unknown = model.unk_id()
        by_size: dict[int, list[int]] = {}
        for i in normal:
            by_size.setdefault(len(self.pieces[i]), []).append(i)
        self.sizes = sorted(by_size)
        keys = []
        for size, ids in sorted(by_size.items()):
            codes = np.array([list(map(ord, self.pieces[i])) for i in ids], dtype=np.uint32).reshape(-1, size)
            h = _prefixes(codes)
            keys.append(_key(h[:, size], h[:, 0], size))
        ids, key = np.concatenate([np.array(i) for _, i in sorted(by_size.items())]), np.concatenate(keys)
        order = np.argsort(key)
        self.keys, self.ids = key[order], ids[order].astype(np.int64)
        self.scores = np.array([model.get_score(int(i)) for i in self.ids])
        self.worst = float(self.scores.min()) - PENALTY
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.lengths, self.totals = (np.zeros(0, dtype=k) for k in (np.int64, np.int64, np.int64, np.float64))

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, where each word's begin, how many they are, total scores)."""
        starts, lengths, totals = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
        flat, at = [np.zeros(0, dtype=np.int64)], 0
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, members in by_size.items():
            rows = max(1, 400_000 // max(size, 1))
            for k in range(0, len(members) if size else 0, rows):
                part = members[k : k + rows]
                codes = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), size)
                ids, counts, totals[part] = self._viterbi(codes)
                starts[part], lengths[part] = at + np.cumsum(counts) - counts, counts
                flat.append(ids)
                at += len(ids)
        return np.concatenate(flat), starts, lengths, totals

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in turn, how many each has, total scores."""
        n, size = codes.shape
        h = _prefixes(codes)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.ones((n, size + 1), dtype=np.int32)
        piece = np.full((n, size + 1), -1, dtype=np.int64)
        for j in range(1, size + 1):
            best[:, j] = best[:, j - 1] + self.worst  # a character of no piece
            for length in self.sizes:  # rising: of equal scores the longest stays
                if length > j:
                    break
                key = _key(h[:, j], h[:, j - length], length)
                spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                score = np.where(self.keys[spot] == key, best[:, j - length] + self.scores[spot], -np.inf)
                better = score > -np.inf if length == 1 else score >= best[:, j]
                if better.any():
                    best[better, j] = score[better]
                    back[better, j] = length
                    piece[better, j] = self.ids[spot[better]]
        at = np.full(n, size)
        rows, ends = np.arange(n), []
        steps_row, steps_piece = [], []
        while len(rows):
            p = piece[rows, at]
            steps_row.append(rows)
            steps_piece.append(p)
            ends.append(at)
            at = at - back[rows, at]
            on = at > 0
            rows, at = rows[on], at[on]
        row, ids, end = np.concatenate(steps_row), np.concatenate(steps_piece), np.concatenate(ends)
        order = np.lexsort((end, row))
        row, ids, end = row[order], ids[order], end[order]
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            parts = [self._as_bytes(codes[row[k], end[k] - 1]) for k in odd]
            more = np.ones(len(ids), dtype=np.int64)
            more[odd] = [len(p) for p in parts]
            row, ids = np.repeat(row, more), np.repeat(ids, more)
            ids[ids < 0] = np.concatenate(parts)
        return ids, np.bincount(row, minlength=n), best[:, size]

    def _as_bytes(self, code: int) -> np.ndarray:
        ids = self.byte_ids[list(chr(code).encode("utf-8", "replace"))]
        return ids if (ids >= 0).all() else np.array([self.unknown])

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids and total score of each text; every distinct word is segmented once."""
        if len(self.index) > KNOWN_WORDS:
            self._forget()
        index, known = self.index, len(self.index)
        rows = [np.array([index.setdefault(w, len(index)) for w in WORD.findall(MARK + t.replace(" ", MARK))] if t else [], dtype=np.int64) for t in texts]
        flat, starts, lengths, totals = self.segment(list(islice(index, known, None)))
        self.starts, self.flat = np.concatenate((self.starts, starts + len(self.flat))), np.concatenate((self.flat, flat))
        self.lengths, self.totals = np.concatenate((self.lengths, lengths)), np.concatenate((self.totals, totals))
        out, total = [], np.zeros(len(texts))
        for i, at in enumerate(rows):
            n = self.lengths[at]
            out.append(self.flat[np.arange(int(n.sum())) + np.repeat(self.starts[at] - (np.cumsum(n) - n), n)])
            total[i] = self.totals[at].sum()
        return out, total

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join([self.bytes[i] for i in ids])
        return data.decode("utf-8", "replace")[1 if data[:1] == b" " else 0 :]


_codecs: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """One codec for each file and Python process."""
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


def encode(docs: DataFrame, model_path: str, *, text: str = "text", ids: str = "ids", score: str = "piece_score") -> DataFrame:
    """Add the piece ids (array of int) and their total score."""

    @F.pandas_udf("ids array<int>, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [codec(model_path).encode(part) for part in slices(texts, 8_000_000)]
            yield pd.DataFrame({"ids": [x.astype(np.int32) for part, _ in got for x in part], "score": np.concatenate([np.zeros(0), *(s for _, s in got)])})

    found = free_name(docs, "_pieces")
    out = in_short_batches(docs).withColumn(found, run.asNondeterministic()(F.col(text)))
    return out.withColumns({ids: F.col(f"{found}.ids"), score: F.col(f"{found}.score")}).drop(found)


def decode(docs: DataFrame, model_path: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of piece ids; null ids give a null text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if r is None else codec(model_path).decode(r) for r in rows], dtype=object)

    return docs.withColumn(text, run(F.col(ids)))


def round_trips(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), piece_score, and whether decoding gives the text back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_path)
        for b in batches:
            at = 0
            for part in slices(b["text"], 8_000_000):
                keys = b["doc_id"].iloc[at : at + len(part)]
                at += len(part)
                ids, scores = own.encode(part)
                yield pd.DataFrame({
                    "doc_id": keys.to_numpy(), "n_pieces": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], "piece_score": scores,
                    "round_trip": [own.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(ids, part, strict=True)],
                })

    found = in_short_batches(docs).select(as_text(), "text").mapInPandas(run, "doc_id string, n_pieces long, ids_crc32 long, piece_score double, round_trip boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(id_type(docs)))
