"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, connected groups.

A line is normalised to its lower-case words of letters and digits.  Equal normalised lines are one
line, however short; lines without any word always stay.  Each distinct line has a SimHash of its words
and pigeonhole blocks: what is edited lies in some blocks, and the others agree.

* An edited stretch of at most a fifth of a line leaves its first or its last two fifths as they are.
  The blocks are the bytes at either end, of two lengths from a grid, so that lines of near lengths
  have a length in common.  One edited stretch is always found.
* Several edits leave runs of words between them.  Every run of a length that grows with the line
  gives a block: the smallest hash of its word n-grams (winnowing), a few for a line of any length.

Lines that share a block and whose hashes are near (LIMITS) are verified: lines of BAG_FROM words or
more by the words that they have in common, which the hashes estimate, then all by edit similarity; verified lines form groups, and of each group (and of each repeated line) only the first
occurrence stays, by document id (rows that share one by a hash of their text) and then place.
Blocks of the hash's own bits cannot do it: a line of ten words with one replaced differs in about
eight bits of 64, and blocks that leave eight bits free are too short to tell lines apart.

A repeated line leaves a task once, so a common line is a row for each task.  Names, blocks and hashes
travel without texts; documents are read again for the blocks of first occurrences and for the texts
of lines that may be near others, and bitmaps of fixed size keep most other lines out of that.  Within
a task verified lines are joined in a forest, so a group gives a tree of links and not all pairs; large
blocks are divided into shards that visit each other, and equal groups under several blocks are
verified once.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refquarry.llm.common import Workspace, as_bytes, bitmap, byte_table, chunks, in_bitmap, mix, small_batches, span_hashes, table, words
from refquarry.llm.components import components
from refquarry.llm.ngram_join import Forest

SIMILARITY = 0.8
#: classes of lines by their number of words, and in how many bits of 61 the hashes of near lines differ at most (the smaller line's class counts;
#: unrelated ones differ in 29, give or take 4); the SimHash of one to three words (or of a script without spaces) says little, so any two are near
CLASSES = np.array([4, 8, 16, 32, 64, 128])
LIMITS = np.array([64, 22, 20, 17, 15, 13, 11, 11], np.uint8)
#: of lines of so many words, near ones have this share of the longer one's words in common
BAG_FROM, BAG_SHARE = 8, 0.6
#: lengths in bytes of the blocks at a line's ends grow by this factor
GRID = 1.25
#: the smallest lines that winnowing reads, in words; the sizes above double
LEAST_WORDS = 8
SHARD_LINES = 8192
BUCKET_KEYS = 1 << 19
SEND_AT = 1 << 18
#: groups up to this size are verified beside others with the same smallest line
SMALL_GROUP = 64
#: names that a task remembers before it starts afresh, which costs rows and changes no result
REMEMBERED = 100_000
NON_WORD = bytes(b for b in range(128) if not chr(b).isalnum())
_PLAIN = bytes(10 if b == 10 else 32 if b in NON_WORD else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def normalised(text: bytes) -> list[bytes]:
    """Each line's lower-case words, a space between them."""
    return [b" ".join(x.split()) for x in text.translate(_PLAIN).split(b"\n")]


def _names(lines: list[bytes]) -> np.ndarray:
    """128-bit names of lines as two columns of whole numbers; the first is the line's node."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">i8").astype(np.int64).reshape(-1, 2)


def _occurrences(batches):
    """A task's first occurrence of each line (node, rest of its name, doc_id, row, line), and the places of the others (no node)."""
    held: dict[bytes, tuple] = {}
    others: list[tuple] = []

    def batch_of():
        places = [*held.values(), *others]
        names = np.frombuffer(b"".join(held), ">i8").astype(np.int64).reshape(-1, 2)
        blank = pa.nulls(len(others), pa.int64())
        got = pa.RecordBatch.from_arrays([*(pa.concat_arrays([pa.array(names[:, i]), blank]) for i in (0, 1)), pa.array([None if x[0] else x[1] for x in places], pa.int64()), *(pa.array([x[i] for x in places], pa.int64()) for i in (2, 3))], names=["node", "rest", "doc_id", "row", "line"])
        held.clear()
        others.clear()
        return got

    name = xxhash.xxh3_128_digest
    for batch in batches:
        for i, r, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), as_bytes(batch.column("text")), strict=True):
            for k, line in enumerate(normalised(text)):
                if not line:
                    continue
                place, key = (i is None, i or 0, r, k), name(line)
                known = held.get(key)
                if known is None:
                    held[key] = place
                elif place < known:
                    held[key] = place
                    others.append(known)
                elif place > known:
                    others.append(place)
            if len(held) + len(others) >= REMEMBERED:
                yield batch_of()
    yield batch_of()


def _place():
    """A place as one number: a hash of the text with the line's number in its upper half."""
    return F.col("row").bitwiseXOR(F.shiftleft("line", 32)).alias("place")


def _lines_at(batch, able: np.ndarray) -> list[bytes]:
    """The lines of a batch (row, text) whose places are in a bitmap, each once."""
    texts = [x.split(b"\n") for x in as_bytes(batch.column("text"))]
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(batch.column("row").fill_null(0).to_numpy(), n) ^ (number << 32)
    every = [x for t in texts for x in t]
    some = (b" ".join(every[i].translate(_PLAIN).split()) for i in np.flatnonzero(in_bitmap(able, at.view(np.uint64))).tolist())
    return [x for x in dict.fromkeys(some) if x]


#: for each byte, its bits as eight bytes of 0 or 1: words are counted by adding these up, eight bits of the hash at a time
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def simhashes(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of each line, with its class in the lowest three bits: h has the word hashes of all lines, n the number of words of each (one or more)."""
    at = np.cumsum(n) - n
    out = np.zeros((len(n), 8), np.uint8)
    for k, column in enumerate(h.view(np.uint8).reshape(-1, 8).T):
        votes = np.add.reduceat(_SPREAD[column], at).view(np.uint8).reshape(-1, 8)
        out[:, k] = np.packbits(votes > (n // 2)[:, None], axis=1, bitorder="little")[:, 0]
    for i in np.flatnonzero(n > 255).tolist():  # bytes do not hold their counts
        bits = np.unpackbits(h[at[i] : at[i] + n[i]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[i] = np.packbits(bits.sum(axis=0, dtype=np.int64) > n[i] // 2, bitorder="little")
    return out.view(np.uint64).ravel() << np.uint64(3) | np.searchsorted(CLASSES, n, "right").astype(np.uint64)


def near(a, b):
    """Whether SimHashes are near."""
    low = np.uint64(7)
    return np.bitwise_count((a ^ b) >> np.uint64(3)) <= LIMITS[np.minimum(a & low, b & low)]


def _grid(most: int) -> list[int]:
    """Lengths of end blocks up to `most`: 2, 3, ..., each at least GRID times the one before."""
    out = [2]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * GRID)))
    return out


def end_blocks(size: np.ndarray, spans) -> tuple[np.ndarray, np.ndarray]:
    """(line index, key) of the blocks at both ends of lines of these sizes, one byte apart: the two largest lengths of the grid within two fifths of a line."""
    start = np.cumsum(size + 1) - size - 1
    grid = np.array(_grid(int(size.max(initial=0))))
    top = np.searchsorted(grid, 2 * size // 5, "right") - 1
    of, keys = [], []
    for t in (top, top - 1):
        able = np.flatnonzero(t >= 0)
        a, g = start[able], grid[t[able]]
        e = a + size[able]
        of += [able, able]
        keys += [spans(a, a + g), ~spans(e - g, e)]
    return np.concatenate(of), np.concatenate(keys)


def _smallest(v: np.ndarray, w: int) -> np.ndarray:
    """Smallest value of each window of w (a power of two) values."""
    step = 1
    while step < w:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return v


def run_blocks(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line index, key): of each line, the smallest n-gram hashes of its runs, by the size classes that it is in or near below."""
    of, keys = [], []
    low, k, w = LEAST_WORDS, 3, 4
    while len(n) and n.max() >= 3 * low // 4:
        inside = (n >= 3 * low // 4) & (n < 2 * low)
        some = np.flatnonzero(inside)
        if len(some):
            words_ = h[np.repeat(inside, n)]
            line = np.repeat(some, n[some])
            v = words_[: len(words_) - k + 1].copy()
            for j in range(1, k):
                v = v * _STEP + words_[j : len(words_) - k + 1 + j]
            least = _smallest(mix(v ^ np.uint64(low)), w)
            own = line[: len(least)]
            keep = own == line[k + w - 2 :]  # the run lies within one line
            keep[1:] &= (least[1:] != least[:-1]) | (own[1:] != own[:-1]) | ~keep[:-1]
            of.append(own[keep])
            keys.append(least[keep])
        low, k, w = 2 * low, min(k + 1, 8), 2 * w
    return (np.concatenate(of), np.concatenate(keys)) if of else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def blocks(lines: list[bytes]):
    """For slices of lines: where the slice begins, its SimHashes, and (line in the slice, key) of all its blocks."""
    tables = byte_table(b" \n", lower=False)
    for a, b in chunks(lines):
        part = lines[a:b]
        joined, line, _, _, h = words(part, tables)
        n = np.bincount(line, minlength=len(part))
        (o1, k1), (o2, k2) = end_blocks(np.fromiter(map(len, part), np.int64, len(part)), span_hashes(joined, tables[1])), run_blocks(h, n)
        yield a, simhashes(h, n), np.concatenate([o1, o2]), np.concatenate([k1, k2])


def _pack(able: np.ndarray, buckets: int):
    """Blocks by bucket, of the lines whose places are in the bitmap: keys, and the nodes and SimHashes of their lines."""

    def send(keys, nodes, sims):
        keys, nodes, sims = (np.concatenate(x) for x in (keys, nodes, sims))
        bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
        at = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[at], prepend=-1, append=buckets))
        rows = [(int(bucket[at[i]]), *(x[at[i:j]].tobytes() for x in (keys, nodes, sims))) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names=["bucket", "keys", "nodes", "sims"])

    def run(batches):
        keys, nodes, sims, held = [], [], [], 0
        for batch in batches:
            lines = _lines_at(batch, able)
            node = _names(lines)[:, 0]
            for a, sim, of, key in blocks(lines):
                keys.append(key)
                nodes.append(node[a + of])
                sims.append(sim[of])
                held += len(key)
                if held >= SEND_AT:
                    yield send(keys, nodes, sims)
                    keys, nodes, sims, held = [], [], [], 0
        if held:
            yield send(keys, nodes, sims)

    return run


def _near(rows: pa.Table) -> pa.Table:
    """Of one bucket, a row for each block whose lines may be near: a hash of its lines, the key, a home, and the nodes and SimHashes of lines that another one is near to.

    Blocks of more than a shard's lines go on whole in several rows; verification divides them.
    """
    keys, nodes, sims = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("nodes", np.int64), ("sims", np.uint64)))
    at = np.lexsort((nodes, keys))
    keys, nodes, sims = keys[at], nodes[at], sims[at]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
    keys, nodes, sims = keys[fresh], nodes[fresh], sims[fresh]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.diff(edge)
    start = edge[:-1]
    two = start[size == 2]
    two = two[near(sims[two], sims[two + 1])]  # most blocks have two lines
    ends = [(a, a + 2, None) for a in two.tolist()]
    for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        if n > SHARD_LINES:
            ends += [(i, min(a + n, i + SHARD_LINES), None) for i in range(a, a + n, SHARD_LINES)]
            continue
        some = np.zeros(n, bool)
        for i in range(n - 1):
            close = near(sims[a + i + 1 : a + n], sims[a + i])
            if close.any():
                some[i] = True
                some[i + 1 :] |= close
        if some.any():
            ends.append((a, a + n, some))
    out: list[tuple] = []
    for a, b, some in ends:
        lines, hashes = (nodes[a:b], sims[a:b]) if some is None else (nodes[a:b][some], sims[a:b][some])
        key, packed = int(keys[a].view(np.int64)), lines.tobytes()
        out.append((xxhash.xxh3_64_intdigest(packed) >> 1, key, int(lines[0]) if len(lines) <= SMALL_GROUP else key, packed, hashes.tobytes()))
    return pa.table([*(pa.array([r[i] for r in out], pa.int64()) for i in range(3)), *(pa.array([r[i] for r in out], pa.binary()) for i in (3, 4))], names=["lines", "key", "home", "nodes", "sims"])


def _unpack(batches):
    for batch in batches:
        nodes = [np.frombuffer(x, np.int64) for x in batch.column("nodes").to_pylist()]
        n = [len(x) for x in nodes]
        every = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (nodes, [np.frombuffer(x, np.int64) for x in batch.column("sims").to_pylist()])]
        yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("key", "home")), *map(pa.array, every)], names=["key", "home", "node", "sim"])


def edit_distance(a: str, b: str, most: float = float("inf")) -> float:
    """Levenshtein distance, a column of the table at a time as bits of whole numbers (steps up and down from one row to the next); infinite once it is sure to be above `most`."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    ones = (1 << len(b)) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    up, down, lag, at = ones, 0, len(b) - len(a), where.get
    for j, c in enumerate(a):
        if not j & 15 and j + lag > 0:  # what the cell on the last diagonal has bounds the distance: each step away from it has to be taken back
            row = (1 << j + lag) - 1
            if j + (up & row).bit_count() - (down & row).bit_count() > most:
                return float("inf")
        match = at(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right = (down | ~(diagonal | up)) << 1 | 1
        left = (diagonal & up) << 1
        up = (left | ~(diagonal | right)) & ones
        down = diagonal & right & ones
    return len(a) + up.bit_count() - down.bit_count()


def _common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _bounded(a: list[str], b: list[str], most: float) -> bool:
    """Whether the words can be aligned from left to right at a cost of at most `most` characters: where they differ, on to the next two words in a row that both have."""
    i = j = cost = 0
    places: dict[tuple[str, str], list[int]] = {}
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        if not places:
            for k in range(j, len(b) - 1):
                places.setdefault((b[k], b[k + 1]), []).append(k)
        step = None
        for p in range(len(a) - i - 1):
            if step is not None and p >= sum(step):
                break
            there = places.get((a[i + p], a[i + p + 1]), ())
            k = bisect_left(there, j)
            if k < len(there) and (step is None or p + there[k] - j < sum(step)):
                step = p, there[k] - j
        if step is None:
            break
        cost += max(len(" ".join(a[i : i + step[0]])), len(" ".join(b[j : j + step[1]]))) + 1
        if cost > most:
            return False
        i, j = i + step[0], j + step[1]
    return cost + max(len(" ".join(a[i:])), len(" ".join(b[j:]))) + 1 <= most


def similar(a: str, b: str) -> bool:
    """Edit similarity of SIMILARITY or more.

    What both begin or end with has no part in the distance and is cut off first; an alignment of words
    bounds the distance from above, characters that one has more often than the other from below.
    """
    longest = max(len(a), len(b))
    most = longest - SIMILARITY * longest + 1e-9
    if abs(len(a) - len(b)) > most:
        return False
    if _bounded(a.split(" "), b.split(" "), most):
        return True
    k = _common_prefix(a, b)
    a, b = a[k:], b[k:]
    k = _common_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if max(len(a), len(b)) <= most:
        return True
    if max(sum(max(0, a.count(c) - b.count(c)) for c in set(a)), sum(max(0, b.count(c) - a.count(c)) for c in set(b))) > most:
        return False
    return edit_distance(a, b, most) <= most


def _bag(text: str) -> set:
    """A line's words; one that comes again counts anew."""
    seen: dict[str, int] = {}
    out = set()
    for w in text.split(" "):
        k = seen[w] = seen.get(w, 0) + 1
        out.add(w if k == 1 else (w, k))
    return out


def _verify(batches):
    """Rows sorted by home, shard and role; links between lines of a shard, or of a shard and its visitors, that join different trees of their home."""
    home, shard, members, forest, apart, out = None, None, [], Forest(), set(), []
    sims, trees = np.zeros(64, np.uint64), np.zeros(64, np.int64)
    for batch in batches:
        for where, key, salt, role, node, sim, text in zip(*(batch.column(c).to_pylist() for c in ("home", "key", "salt", "role", "node", "sim", "text")), strict=True):
            if where != home:
                home, forest, apart = where, Forest(), set()
                shard = None
            if (key, salt) != shard:
                shard, members = (key, salt), []
            value, bag, n = np.uint64(sim & 0xFFFFFFFFFFFFFFFF), None, len(members)
            mine = forest.root(node)
            able = np.flatnonzero(near(sims[:n], value) & (trees[:n] != mine))  # lines of one tree are not compared
            while len(able):
                at, able = able[0], able[1:]
                other, line = members[at][:2]
                pair = (other, node) if other < node else (node, other)
                if other == node or pair in apart:
                    continue
                bag = _bag(text) if bag is None else bag
                words_ = members[at][2] = members[at][2] or _bag(line)  # made when first asked for
                longest = max(len(words_), len(bag))
                if (longest < BAG_FROM or len(words_ & bag) >= BAG_SHARE * longest) and similar(line, text):
                    forest.join(other, node)
                    theirs, mine = mine, forest.root(node)
                    trees[:n][(trees[:n] == trees[at]) | (trees[:n] == theirs)] = mine
                    able = able[trees[able] != mine]
                    out.append((other, node))
                elif len(apart) < REMEMBERED:
                    apart.add(pair)
            if not role:
                if n == len(sims):
                    sims, trees = (np.concatenate([x, np.zeros_like(x)]) for x in (sims, trees))
                sims[n], trees[n] = value, mine
                members.append([node, text, bag])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
            out = []
    yield pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["a", "b"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text as row: what tells rows of one id, or of none, from each other."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """node, text of the lines at places, once each, and of others where the bitmap is full."""
    able = bitmap(places)

    def run(batches):
        for batch in batches:
            lines = _lines_at(batch, able)
            yield pa.RecordBatch.from_arrays([pa.array(_names(lines)[:, 0]), pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())], names=["node", "text"])

    return docs.select("row", "text").mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def similar_lines(docs: DataFrame, distinct: DataFrame, ws: Workspace) -> DataFrame:
    """a, b: a spanning forest of each block's similar lines, for documents (row, text) and the first occurrences of their lines (node, row, line)."""
    spark = docs.sparkSession
    buckets = int(max(16, -(-10 * distinct.count() // BUCKET_KEYS)))
    packed = docs.select("row", "text").mapInArrow(_pack(bitmap(distinct.select(_place())), buckets), "bucket int, keys binary, nodes binary, sims binary")
    alike = ws.cut(packed.groupBy("bucket").applyInArrow(_near, "lines long, key long, home long, nodes binary, sims binary"), "near")
    del packed
    ws.release()
    once = alike.groupBy("lines").agg(F.min("key").alias("key"))  # the same lines under several blocks
    keyed = ws.cut(alike.join(once, ["lines", "key"]).mapInArrow(_unpack, "key long, home long, node long, sim long"), "keyed")
    size = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SHARD_LINES).alias("salts"))
    placed = keyed.join(size, "key").withColumn("salt", F.pmod(F.col("node"), F.col("salts")).cast("long"))
    members = placed.select("home", "key", "salt", F.lit(0).alias("role"), "node", "sim")
    visitors = placed.where("salts > 1").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).where("to < salt")
    visitors = visitors.select("home", "key", F.col("to").alias("salt"), F.lit(1).alias("role"), "node", "sim")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    told = _texts(docs, distinct.join(keyed.select("node").distinct(), "node", "left_semi").select(_place()))
    told = members.union(visitors).join(told, "node").withColumn("home", F.xxhash64("home", "salt"))
    links = ws.cut(told.repartition(parts, "home").sortWithinPartitions("home", "key", "salt", "role", "node").mapInArrow(_verify, "a long, b long"), "links")
    for name in ("near", "keyed"):
        ws.drop(name)
    return links


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row and drop (the dropped lines' numbers, sorted) of documents that lose lines."""
    with small_batches(docs.sparkSession):
        return _dropped(docs)


def _dropped(docs: DataFrame) -> DataFrame:
    ws = Workspace(docs.sparkSession, "lines")
    docs = _keyed(docs)
    lines = ws.cut(docs.mapInArrow(_occurrences, "node long, rest long, doc_id long, row long, line long"), "occurrences")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row", "line")
    by_name = Window.partitionBy("node", "rest").orderBy(place)  # a name has one row for each task
    ranked = lines.where("node is not null").withColumns({"first": F.row_number().over(by_name) == 1, "later": F.rank().over(by_name) > 1})
    ranked = ws.cut(ranked.select("doc_id", "row", "line", "node", "first", "later"), "ranked")
    ws.release()
    distinct = ranked.where("first")
    links = similar_lines(docs, distinct.select("node", "row", "line"), ws)
    gone = lines.where("node is null").select("doc_id", "row", "line").union(ranked.where("later").select("doc_id", "row", "line"))
    if not links.isEmpty():
        grouped = ws.cut(distinct.select("node", place.alias("place")).join(components(links, ws), "node").select("component", "place"), "grouped")
        kept = grouped.groupBy("component").agg(F.min("place").alias("kept"))
        gone = gone.union(grouped.join(kept, "component").where("place <> kept").select("place.doc_id", "place.row", "place.line"))
    return gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line")).alias("drop"))


def _with_dropped(rows: DataFrame, gone: DataFrame) -> DataFrame:
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "row": "gone_row"})
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated lines, n_lines, n_dropped for each row.

    Null stays null (no lines), the empty text is one line; lines without any word stay.
    Rows that repeat an id with the same text count as one document, and with other texts (null ids too)
    as documents of their own; an empty table gives no rows.  Ties stay with the smallest place.  Long
    lines are compared whole, in time that grows with the product of two lines' lengths over 64; a
    task holds the lines of one text.  Further columns take no part, whatever their names.
    """
    parts = F.split("text", "\n")
    rows = _with_dropped(_keyed(docs), dropped_lines(docs))
    stay = F.filter(parts, lambda x, i: ~F.array_contains("drop", i.cast("long")))
    return rows.select(
        "doc_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (their numbers, comma-joined) for each document."""
    docs = table(spark, sf_dir, "documents")
    counted = _keyed(docs).select("doc_id", "row", F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    return _with_dropped(counted, dropped_lines(docs)).select(
        "doc_id", "n_lines", F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join(F.col("drop").cast("array<string>"), ","), F.lit("")).alias("dropped")
    )
