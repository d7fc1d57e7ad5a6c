"""Packing of tokenised texts into sequences by vector bin packing.

A piece asks for tokens, one segment and its loss-bearing tokens; a sequence has limits on all three.
The dot-product heuristic puts into the open sequence the waiting text whose demand has the largest
product with what is left; a text that no longer fits is cut.  Sequences leave full, or (at a task's
end, or where segments run out) with a power of two of tokens, so nothing is padded.

Texts are tokenised by distinct white-space-delimited words: each is encoded once per worker.  Packing
is local to a task: no shuffle, a window of bounded size, and a recomputed task gives the same rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refquarry.llm.common import SPACES, as_bytes, byte_table, chunks, table, tidy, words

LENGTH = 2048
SEGMENTS = 256
END_ID = 1
#: the byte that ends a word for the byte-pair engine
_END = b"\x7f"
#: distinct words a worker remembers before it starts afresh
REMEMBERED = 400_000
#: texts that wait for a place at most
WINDOW = 512


class Encoder:
    """ids of texts as one array with offsets, from a tokenizer that never joins across ASCII white space.

    Words of ordinary Latin characters are split by the tokenizer's own pattern and merged by a
    byte-pair engine that has the tokenizer's vocabulary as ranks, with a byte for the word's end;
    all others go to the tokenizer itself.  Both give the same ids.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        spelled = json.loads(source)
        pattern = spelled["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        letter = _byte_letters()
        suffix = spelled["model"]["end_of_word_suffix"]
        special = {x["content"] for x in spelled["added_tokens"]}
        ranks = {}
        for word, i in spelled["model"]["vocab"].items():
            if word not in special:
                body = word.removesuffix(suffix)
                ranks[bytes(letter[c] for c in body) + _END * (body != word)] = i
        self.engine = tiktoken.Encoding("words", pat_str=r"[^\x7f]+\x7f", mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(rf"{pattern}|\n")
        self.odd = regex.compile(r"[^\x21-\x7e\xa1-\u024f]|<\|")
        self.newline = ranks[b"\n" + _END]
        self.known: dict[int, int] = {}
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of distinct words, one after another, and how many each has."""
        plain = [not self.odd.search(t) for t in texts]
        joined = "\n".join(t for t, p in zip(texts, plain, strict=True) if p).lower()
        ids = np.array(self.engine.encode_ordinary("\x7f".join(self.pieces.findall(joined)) + "\x7f") if joined else [], np.uint32)
        breaks = ids == self.newline
        counts = np.bincount(np.cumsum(breaks)[~breaks], minlength=sum(plain)) if any(plain) else np.zeros(0, np.int64)
        ids = ids[~breaks]
        if all(plain):
            return ids, counts
        n = np.zeros(len(texts), np.int64)
        n[np.array(plain, bool)] = counts
        parts, at = [], 0
        rest = iter(self.tokenizer.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        for i, p in enumerate(plain):
            if p:
                parts.append(ids[at : at + n[i]])
                at += n[i]
            else:
                parts.append(np.array(next(rest).ids, np.uint32))
                n[i] = len(parts[-1])
        return np.concatenate(parts), n

    def encode(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined, doc, starts, ends, h = words(blobs, byte_table(SPACES, lower=False))
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
            self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        hashes = distinct.tolist()
        new = [i for i, x in enumerate(hashes) if x not in self.known]
        if new:
            ids, n = self._words([joined[a:b].decode("utf-8") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            self.known.update(zip((hashes[i] for i in new), range(len(self.at) - 1, len(self.at) - 1 + len(new)), strict=True))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
            self.flat = np.concatenate([self.flat, ids])
        which = np.fromiter((self.known[x] for x in hashes), np.int64, len(hashes))[inverse]
        begin, n = self.at[which], self.at[which + 1] - self.at[which]
        before = np.cumsum(n) - n
        ids = self.flat[np.repeat(begin - before, n) + np.arange(int(n.sum()))]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(doc, n, len(blobs)).astype(np.int64))])


def _byte_letters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if printable Latin-1, else U+0100 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: one encoder for each tokenizer that a worker has used, so that later tasks find its words
_encoders: dict[int, Encoder] = {}


def encoder_of(source: str) -> Encoder:
    key = zlib.crc32(source.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(source)
    return _encoders[key]


class Packer:
    """Sequences from texts put in one by one; yields (key, start, ids, tokens of the text, sequence, offset)."""

    def __init__(self, first_sequence: int, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LENGTH, window: int = WINDOW):
        self.limit = np.array([length, segments, loss], float)
        self.length, self.segments, self.window = length, segments, window
        self.next = first_sequence
        self.waiting: list[list] = []  # key, ids of the text, from, to, first loss-bearing id
        self.demand = np.zeros((2 * window, 3))
        self.open: list[tuple] = []
        self.left = self.limit.copy()

    def _demand(self, item: list) -> tuple[float, float, float]:
        return item[3] - item[2], 1, max(0, item[3] - max(item[2], item[4]))

    def _close(self, tokens: int) -> Iterator[tuple]:
        """Ends the open sequence with its first `tokens` tokens; what is behind them waits again."""
        at = 0
        for key, ids, start, end, loss_from in self.open:
            take = min(end - start, tokens - at)
            if take:
                yield key, start, ids[start : start + take], len(ids), self.next, at
                at += take
            if start + take < end:
                self._wait([key, ids, start + take, end, loss_from])
        self.next += 1
        self.open, self.left = [], self.limit.copy()

    def _wait(self, item: list) -> None:
        if len(self.waiting) == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.demand[len(self.waiting)] = self._demand(item)
        self.waiting.append(item)

    def _take(self, i: int) -> list:
        item = self.waiting[i]
        last = self.waiting.pop()
        if i < len(self.waiting):
            self.waiting[i] = last
            self.demand[i] = self.demand[len(self.waiting)]
        return item

    def put(self, key, ids: np.ndarray, loss_from: int = 0) -> Iterator[tuple]:
        at = 0
        if self.limit[2] >= self.length:
            while len(ids) - at >= self.length:  # long texts fill sequences of their own
                yield key, at, ids[at : at + self.length], len(ids), self.next, 0
                self.next += 1
                at += self.length
        if at < len(ids):
            self._wait([key, ids, at, len(ids), loss_from])
        while len(self.waiting) >= self.window:
            yield from self._place()

    def _place(self) -> Iterator[tuple]:
        d = self.demand[: len(self.waiting)]
        worth = (d / self.limit) @ (self.left / self.limit)
        fits = (d <= self.left).all(axis=1)
        whole = bool(fits.any()) and self.left[1] > 1
        i = int(np.where(fits, worth, -1).argmax() if whole else d[:, 0].argmax())
        key, ids, start, end, loss_from = self._take(i)
        n = end - start
        if not whole:  # cut: as many ids as tokens and loss-bearing tokens allow
            n = min(n, int(self.left[0]), max(0, loss_from - start) + int(self.left[2]))
        if n:
            self.open.append((key, ids, start, start + n, loss_from))
            self.left -= (n, 1, max(0, start + n - max(start, loss_from)))
        if start + n < end:
            self._wait([key, ids, start + n, end, loss_from])
        used = self.length - int(self.left[0])
        if used == self.length:
            yield from self._close(used)
        elif self.left[1] < 1 or (not whole and used):
            yield from self._close(1 << (used.bit_length() - 1))

    def finish(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._place()
        while self.open:
            used = self.length - int(self.left[0])
            yield from self._close(1 << (used.bit_length() - 1))
            while self.waiting:
                yield from self._place()


def _pack(source: str, length: int, segments: int, loss: int):
    def run(batches):
        encoder = encoder_of(source)
        packer = Packer(TaskContext.get().partitionId() << 40, length, segments, loss)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

        def row(piece):
            key, start, ids, total, sequence, offset = piece
            return key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset

        rows = []
        for batch in batches:
            keys, blobs = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))
            loss_from = batch.column("loss_from").to_pylist()
            for a, b in chunks(blobs, 1 << 21):
                ids, at = encoder.encode(blobs[a:b])
                for i in range(a, b):
                    rows.extend(map(row, packer.put(keys[i], np.append(ids[at[i - a] : at[i - a + 1]], np.uint32(END_ID)), loss_from[i])))
                if len(rows) > 5000:
                    yield batch_of(rows)
                    rows = []
        rows.extend(map(row, packer.finish()))
        if rows:
            yield batch_of(rows)

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, loss_from: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; rows that repeat an id are packed each for themselves
    (null ids too); an empty table gives no rows.  The tokenizer file is read by the driver.
    A sequence holds at most `loss` loss-bearing tokens (by default as many as tokens).  The column
    `loss_from` has the place of each text's first loss-bearing token; without it, or where it is null or
    negative, all of the text's tokens bear loss.
    """
    if loss is not None and loss < 1:
        raise ValueError("loss must be 1 or more")
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        source = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches):
        return _pack(shipped.value, length, segments, length if loss is None else loss)(batches)

    first = F.lit(0) if loss_from is None else F.greatest(F.lit(0), F.coalesce(F.col(loss_from), F.lit(0)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", first.cast("long").alias("loss_from"))
    return rows.mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
