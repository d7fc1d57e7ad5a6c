"""SentencePiece byte-pair encoding and decoding by suffix-array matching.

The distinct words of a batch are written one after another and indexed by a suffix array (suffixes are
compared over the longest piece's length).  Every piece of the vocabulary is looked up by binary search;
its range of suffixes gives its occurrences, which are edges from a start to an end.  Edges are kept by
position, and relaxation replaces, word by word, the two neighbouring symbols that the best edge spans
(best score, then leftmost) until no edge spans two: the byte-pair result.  Characters without a piece
become byte pieces.

Words longer than LONG characters, where one relaxation after another in step with all other words
would be slow, are relaxed with a heap over the same edges.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refquarry.llm.common import as_bytes, byte_table, chunks, mix, table, words

SPACE = "▁"
LONG = 48
#: codes that one suffix array covers
INDEX_CODES = 1 << 20
#: distinct words a worker remembers before it starts afresh
REMEMBERED = 300_000


class Pieces:
    """A byte-pair model's vocabulary, ready for matching and decoding."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(texts[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(SPACE, " ").encode("utf-8") for i, t in enumerate(texts)]
        self.longest = max(len(texts[i]) for i in usual)
        alphabet = sorted({c for i in usual for c in texts[i]})
        self.code = {c: k + 1 for k, c in enumerate(alphabet)}  # 0 ends a word, the largest code has no piece
        self.none = 0xFFFF
        scores = np.array([sp.get_score(i) for i in range(n)])
        order = np.unique(-scores, return_inverse=True)[1]
        self.rank = np.append(order, np.iinfo(np.int64).max)  # the last entry: no piece
        self.ids = np.array(usual)
        self.length = np.array([len(texts[i]) for i in usual])
        keys = np.zeros((len(usual), self.longest), ">u2")
        for row, i in enumerate(usual):
            keys[row, : len(texts[i])] = [self.code[c] for c in texts[i]]
        top = keys.copy()
        for row, k in enumerate(self.length):
            top[row, k:] = 0xFFFF
        self.low, self.high = (np.ascontiguousarray(k).view(f"S{2 * self.longest}").ravel() for k in (keys, top))
        self.single = {texts[i]: i for i in usual if len(texts[i]) == 1}

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """Row p, column k - 1: the piece of k characters that starts at position p, or -1.  codes ends with `longest` zeros."""
        n = len(codes) - self.longest
        windows = np.lib.stride_tricks.sliding_window_view(codes.astype(">u2"), self.longest)[:n]
        keys = np.ascontiguousarray(windows)
        halves = keys.view(">u8").astype(np.uint64)
        suffixes = np.lexsort(tuple(halves[:, k] for k in range(halves.shape[1] - 1, -1, -1)))
        ordered = keys[suffixes].view(f"S{2 * self.longest}").ravel()
        lo, hi = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        count = np.maximum(hi - lo, 0)
        before = np.cumsum(count) - count
        at = suffixes[np.repeat(lo - before, count) + np.arange(int(count.sum()))]
        out = np.full((n, self.longest), -1, np.int32)
        out[at, np.repeat(self.length - 1, count)] = np.repeat(self.ids, count)
        return out

    def _symbols(self, edges, starts, ends, texts, offset) -> list[int]:
        ids = []
        for a, b in zip(starts, ends, strict=True):
            piece = int(edges[a, b - a - 1])
            ids += [piece] if piece >= 0 else [self.bytes[x] for x in texts[a - offset : b - offset].encode("utf-8")]
        return ids

    def _heap(self, edges: np.ndarray, first: int, last: int) -> tuple[list[int], list[int]]:
        """Relaxes one long word; symbols as a linked list of starts."""
        end = {p: p + 1 for p in range(first, last)}
        before = {p: p - 1 for p in range(first + 1, last)}
        ready: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = end.get(a)
            if b is not None and b < last and end[b] - a <= self.longest and (piece := edges[a, end[b] - a - 1]) >= 0:
                heapq.heappush(ready, (int(self.rank[piece]), a, end[b]))

        for p in range(first, last - 1):
            offer(p)
        while ready:
            _, a, b = heapq.heappop(ready)
            middle = end.get(a)
            if middle is None or middle >= last or end.get(middle) != b:
                continue
            del end[middle]
            end[a] = b
            if b < last:
                before[b] = a
                offer(a)
            if a > first:
                offer(before[a])
        return sorted(end), [end[p] for p in sorted(end)]

    def encode_words(self, texts: list[str]) -> list[list[int]]:
        """ids of each word (with its space marks)."""
        out: list[list[int]] = []
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) < INDEX_CODES):
                size += len(texts[to]) + 1
                to += 1
            out += self._encode_some(texts[at:to])
            at = to
        return out

    def _encode_some(self, texts: list[str]) -> list[list[int]]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lengths + 1) - lengths - 1
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds, inverse = np.unique(points, return_inverse=True)
        codes = np.array([0 if p == 0 else self.code.get(chr(p), self.none) for p in kinds.tolist()], np.uint16)[inverse]
        ends_of = np.zeros(len(points), bool)
        ends_of[first + lengths] = True
        codes[(points == 0) & ~ends_of] = self.none
        edges = self.edges(np.append(codes, np.zeros(self.longest, np.uint16)))
        out: list[list[int]] = [[] for _ in texts]
        for i in np.flatnonzero(lengths > LONG).tolist():
            starts, ends = self._heap(edges, int(first[i]), int(first[i] + lengths[i]))
            out[i] = self._symbols(edges, starts, ends, joined, 0)
        active = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        owner = np.repeat(active, lengths[active])
        inside = np.cumsum(lengths[active]) - lengths[active]
        start = np.repeat(first[active] - inside, lengths[active]) + np.arange(len(owner))
        end = start + 1
        finished = []
        big = self.rank[-1]
        while len(owner):
            same = owner[1:] == owner[:-1]
            span = end[1:] - start[:-1]
            can = same & (span <= self.longest)
            cost = np.full(len(owner), big)
            at = np.flatnonzero(can)
            cost[at] = self.rank[edges[start[at], span[at] - 1]]
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            best = np.repeat(np.minimum.reduceat(cost, head), np.diff(np.append(head, len(owner))))
            done = best == big
            if done.any():
                finished.append((owner[done], start[done], end[done]))
                owner, start, end, cost, best = owner[~done], start[~done], end[~done], cost[~done], best[~done]
                if not len(owner):
                    break
            hit = np.flatnonzero(cost == best)
            hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]  # the leftmost of each word
            end[hit] = end[hit + 1]
            keep = np.ones(len(owner), bool)
            keep[hit + 1] = False
            owner, start, end = owner[keep], start[keep], end[keep]
        if finished:
            owner, start, end = (np.concatenate(x) for x in zip(*finished, strict=True))
            piece = edges[start, end - start - 1]
            for i, a, p in zip(owner.tolist(), start.tolist(), piece.tolist(), strict=True):
                if p >= 0:
                    out[i].append(p)
                else:
                    out[i] += [self.bytes[x] for x in joined[a].encode("utf-8")]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces as bytes, space marks as spaces, without the mark put before a text."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """Encodes texts word by word, each distinct word once."""

    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.known: dict[int, int] = {}
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, blobs: list[bytes]) -> list[np.ndarray]:
        mark = SPACE.encode()
        joined, doc, starts, ends, h = words(blobs, byte_table(b" ", lower=False), b" ")
        sizes = np.fromiter((len(b) + 1 for b in blobs), np.int64, len(blobs))
        opens = np.cumsum(sizes) - sizes
        first = np.ones(len(starts), bool)
        first[1:] = doc[1:] != doc[:-1]
        spaces = starts - np.where(first, opens[doc] - 1, np.concatenate([[0], ends[:-1]]))
        h = np.where(spaces == 1, h, mix(h + spaces.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        distinct, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
            self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        hashes = distinct.tolist()
        new = [i for i, x in enumerate(hashes) if x not in self.known]
        if new:
            texts = [SPACE * int(spaces[i]) + joined[starts[i] : ends[i]].decode("utf-8") for i in one[new].tolist()]
            got = self.pieces.encode_words(texts)
            n = np.fromiter(map(len, got), np.int64, len(got))
            self.known.update(zip((hashes[i] for i in new), range(len(self.at) - 1, len(self.at) - 1 + len(new)), strict=True))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
            self.flat = np.concatenate([self.flat, np.array([x for g in got for x in g], np.uint32)])
        which = np.fromiter((self.known[x] for x in hashes), np.int64, len(hashes))[inverse]
        begin, n = self.at[which], self.at[which + 1] - self.at[which]
        before = np.cumsum(n) - n
        ids = self.flat[np.repeat(begin - before, n) + np.arange(int(n.sum()))]
        cut = np.concatenate([[0], np.cumsum(np.bincount(doc, n, len(blobs)).astype(np.int64))])
        out = [ids[cut[i] : cut[i + 1]] for i in range(len(blobs))]
        for i, b in enumerate(blobs):
            if mark in b or b.endswith(b" "):  # space marks of its own, or spaces at its end: as one word
                out[i] = np.array(self.pieces.encode_words([(SPACE + b.decode("utf-8")).replace(" ", SPACE)])[0], np.uint32)
        return out


_encoders: dict[int, Encoder] = {}


def encoder_of(model: bytes) -> Encoder:
    key = zlib.crc32(model)
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: texts by which a model is tried: spaces, compatibility characters, characters without a piece
PROBES = ("", " ", "a  b ", "\ufb01\u2460 \u212b A\u030a", "The quick brown fox, 1999!", "\u65e5\u672c\U0001f600\U00010348", "aaaa bbb\n\tc")
_tried: set[int] = set()


def _shipped(spark, model: str | None):
    """The model for the workers; one that these operators would not encode as its library does (not byte-pair, a normaliser, no byte pieces) is an error."""
    import sentencepiece

    with open(model or default_model(), "rb") as f:
        data = f.read()
    if zlib.crc32(data) not in _tried:
        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        fits = all(sp.is_byte(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256))
        if not fits or any(e.tolist() != sp.encode(t) for e, t in zip(Encoder(data).encode([t.encode() for t in PROBES]), PROBES, strict=True)):
            raise ValueError("the model must be byte-pair, without a normaliser, with byte pieces")
        _tried.add(zlib.crc32(data))
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, model: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id and ids (array) of each row's text; with digest: doc_id, n_ids, ids_crc32, n_chars, round_trip instead.

    Null and empty texts have no ids; rows that repeat an id are encoded each for themselves; an empty
    table gives no rows.  round_trip tells whether decoding gives the text again (not for texts that
    hold the space mark U+2581 itself).
    """
    shipped = _shipped(docs.sparkSession, model)

    def run(batches):
        e = encoder_of(shipped.value)
        for batch in batches:
            blobs = as_bytes(batch.column("text"))
            for a, b in chunks(blobs, 1 << 21):
                part = batch.slice(a, b - a)
                ids = e.encode(blobs[a:b])
                if not digest:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])
                    continue
                texts = [x.decode("utf-8") for x in blobs[a:b]]
                trip = [decode_ids(e.pieces, x) == t for x, t in zip(ids, texts, strict=True)]
                columns = [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(trip)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids_crc32", "n_chars", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "n_ids long, ids_crc32 long, n_chars long, round_trip boolean" if digest else "ids array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {rest}")


def decode_ids(pieces: Pieces, ids: np.ndarray) -> str:
    return pieces.decode(ids.tolist())


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of each row's ids; null ids give null, no ids the empty text."""
    shipped = _shipped(rows.sparkSession, model)

    def run(batches):
        pieces = encoder_of(shipped.value).pieces
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op8_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", F.col("text")), digest=True)
