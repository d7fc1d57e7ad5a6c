"""Set-similarity self-join on word n-grams by T-occurrence search.

A document's set is its distinct 5-word shingles (64-bit hashes).  Two sets link when their Jaccard
similarity reaches 0.75; the result is one row per document with the size of its set and its
component under those links.

1. Equal sets are one node.  Every task also reports its most frequent shingles; at most HOT_TOKENS
   of them, summed over the corpus, stand last in the global order (any order keeps the result exact).
2. Two linked sets share at least l tokens among the first s - ceil(0.75 s) + l of each in that order
   (s its size), for any l; l grows with s, so that a passage in common is too little.  Those prefixes
   go, packed, to buckets; tokens that stand in one set only are dropped.
3. Each node with l shared tokens or more has a home, the most frequent token of its prefix; homes of many
   nodes are divided into shards of bounded size.  A task searches within each of its shards by
   T-occurrence with DivideSkip and returns a spanning forest of the links, not all pairs.
4. Leaders of a home's shards are searched together; components are formed; then a node visits each
   other shard in which nodes of other (larger) components share l of its prefix tokens.
   No pair of different components that could link is left out, so components are exact.

Hashing is to 64 bits for shingles and 128 bits for whole sets; candidate search takes 64 bits of the
latter, where a collision can only add candidates.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refquarry.llm.common import SPACES, Workspace, as_bytes, bitmap, byte_table, in_bitmap, mix, shingle_sets, small_batches, table, tidy
from refquarry.llm.components import components

K = 5
#: similarity as a ratio of whole numbers, so that the test is exact
NUM, DEN = 75, 100
#: prefixes are a fifth of the set longer than one token in common needs
WIDER = 5
HOT_TOKENS = 65_536
HOT_LEAST = 24
#: what one task reports of its own most frequent shingles
HOT_PER_TASK = 8192
SHARD_NODES = 2048
SHARD_TOKENS = 1 << 21
#: prefix entries that a bucket holds, about
BUCKET_ENTRIES = 1 << 20
#: packed entries that a task keeps before it sends them
SEND_AT = 1 << 18
#: inverted lists with more entries are long: as many of them as the overlap allows are probed and not merged
LONG = 8


def least_overlap(a: int, b: int) -> int:
    """Smallest intersection with which sets of sizes a and b link."""
    return -(-NUM * (a + b) // (DEN + NUM))


def _sets(batch, text: str = "text"):
    return shingle_sets(as_bytes(batch.column(text)), byte_table(SPACES, lower=True), K)


def _signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _describe(batches):
    """kind 0: a document's node and set size; kind 1: a frequent shingle of this task and its count."""
    counts: Counter = Counter()
    pending: list[np.ndarray] = []
    held, seen = 0, set()

    def add():
        nonlocal held
        if pending:
            tokens, n = np.unique(np.concatenate(pending), return_counts=True)
            often = n >= 3
            counts.update(dict(zip(tokens[often].tolist(), n[often].tolist(), strict=True)))
            pending.clear()
            held = 0
            if len(counts) > 8 * HOT_PER_TASK:
                kept = counts.most_common(4 * HOT_PER_TASK)
                counts.clear()
                counts.update(dict(kept))

    names = ["kind", "doc_id", "node", "n", "token"]
    for batch in batches:
        nodes, sizes = [], []
        for tokens in _sets(batch):
            sizes.append(len(tokens))
            node = _signature(tokens) if len(tokens) else None
            nodes.append(node)
            if node is not None and node not in seen:
                if len(seen) < 1_000_000:
                    seen.add(node)
                pending.append(tokens)
                held += len(tokens)
                if held > 1 << 20:
                    add()
        zero = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), zero], names=names)
    add()
    hot = [(t, n) for t, n in counts.most_common(HOT_PER_TASK)]
    if hot:
        tokens = np.array([t for t, _ in hot], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(hot), np.int32)), pa.nulls(len(hot), pa.int64()), pa.nulls(len(hot), pa.binary()), pa.array([n for _, n in hot], pa.int64()), pa.array(tokens)], names=names)


def shared_least(s: int) -> int:
    """How many tokens a set of size s shares at least, within prefixes, with any set that it links to (none of which is smaller than 0.75 s)."""
    return max(1, -(-NUM * s // DEN) // WIDER)


def prefix(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first tokens in the global order: by hash, those in `hot` (sorted) last."""
    s = len(tokens)
    n = s - -(-NUM * s // DEN) + max(1, s // WIDER)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
        cold = tokens[~is_hot]
        return cold[:n] if len(cold) >= n else np.concatenate([cold, tokens[is_hot][: n - len(cold)]])
    return tokens[:n]


def _pack(hot: np.ndarray, buckets: int):
    """Prefix tokens by bucket: 32 remaining bits of each token, the index of its node, and the nodes (their first 64 bits)."""

    def send(tokens, owners, nodes):
        m = mix(np.concatenate(tokens))
        o = np.concatenate(owners)
        b = ((m >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        at = np.argsort(b, kind="stable")
        t, o, b = m.astype(np.uint32)[at], o[at], b[at]
        edge = np.flatnonzero(np.diff(b, prepend=-1, append=buckets))
        nodes = np.array(nodes, np.uint64)
        rows = []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own, local = np.unique(o[i:j], return_inverse=True)
            rows.append((int(b[i]), t[i:j].tobytes(), local.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32).tobytes(), nodes[own].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 4))], names=["bucket", "tokens", "owners", "nodes"])

    def run(batches):
        seen: set[bytes] = set()
        tokens, owners, nodes, held = [], [], [], 0
        for batch in batches:
            for s in _sets(batch):
                node = _signature(s) if len(s) else None
                if node is None or node in seen:
                    continue
                if len(seen) < 1_000_000:  # copies that one task holds are sent once; more would cost memory, not change the result
                    seen.add(node)
                p = prefix(s, hot)
                tokens.append(p)
                owners.append(np.full(len(p), len(nodes), np.int64))
                nodes.append(int.from_bytes(node[:8], "big"))
                held += len(p)
                if held >= SEND_AT:
                    yield send(tokens, owners, nodes)
                    tokens, owners, nodes, held = [], [], [], 0
        if held:
            yield send(tokens, owners, nodes)

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """Of one bucket, the (node, token) entries whose token stands in more than one node."""
    tokens, nodes = [], []
    for t, o, n in zip(*(rows.column(c).to_pylist() for c in ("tokens", "owners", "nodes")), strict=True):
        tokens.append(np.frombuffer(t, np.uint32))
        nodes.append(np.frombuffer(n, np.uint64)[np.frombuffer(o, np.uint16 if len(o) == 2 * len(tokens[-1]) else np.uint32)])
    t, n = np.concatenate(tokens), np.concatenate(nodes)
    at = np.lexsort((n, t))
    t, n = t[at], n[at]
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1])
    t, n = t[fresh], n[fresh]
    edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
    df = np.repeat(np.diff(edge), np.diff(edge))
    keep = df > 1
    bucket = rows.column("bucket")[0].as_py()
    return pa.table([pa.array(n[keep].view(np.int64)), pa.array((np.int64(bucket) << 32) | t[keep].astype(np.int64)), pa.array(df[keep].astype(np.int32))], names=["node", "token", "df"])


def _heap_merge(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Members that stand in at least `least` of the sorted lists, with how often."""
    members, counts, last, n = [], [], -1, 0
    for x in heapq.merge(*(a.tolist() for a in lists)):
        if x == last:
            n += 1
            continue
        if n >= least:
            members.append(last)
            counts.append(n)
        last, n = x, 1
    if n >= least:
        members.append(last)
        counts.append(n)
    return np.array(members, np.int64), np.array(counts, np.int64)


class Index:
    """Inverted lists over whole sets, and T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        at = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[at], owner[at]
        edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]])) if len(tokens) else np.zeros(1, np.int64)
        self.tokens, self.start = tokens[edge[:-1]], edge

    def search(self, s: np.ndarray, but: int = -1) -> np.ndarray:
        """Members, without the one named, whose set links with s: short lists are merged by a heap, and what the merge leaves is looked up in the long ones."""
        if not len(s) or not len(self.tokens):
            return np.zeros(0, np.int64)
        least = least_overlap(len(s), -(-NUM * len(s) // DEN))
        i = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        i = i[self.tokens[i] == s]
        lengths = self.start[i + 1] - self.start[i]
        other = (lengths > 1) | (self.owner[self.start[i]] != but)
        i, lengths = i[other], lengths[other]
        if len(i) < least:
            return np.zeros(0, np.int64)
        i = i[np.argsort(lengths, kind="stable")]
        skip = min(least - 1, int((lengths > LONG).sum()))
        lists = [self.owner[self.start[x] : self.start[x + 1]] for x in i]
        short, long_ = lists[: len(lists) - skip], lists[len(lists) - skip :]
        ids, n = _heap_merge(short, least - skip)
        fits = (NUM * self.sizes[ids] <= DEN * len(s)) & (NUM * len(s) <= DEN * self.sizes[ids]) & (ids != but)
        ids, n = ids[fits], n[fits]
        for k, members in enumerate(long_):
            if not len(ids):
                break
            n = n + (members[np.minimum(np.searchsorted(members, ids), len(members) - 1)] == ids)
            if k % 16 == 15:
                able = n + (len(long_) - 1 - k) >= least
                ids, n = ids[able], n[able]
        linked = DEN * n >= NUM * (len(s) + self.sizes[ids] - n)
        return ids[linked]


class Forest:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (p := self.parent.get(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            self.parent[y] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _search_shard(members: list, visitors: list):
    """Links that join different components of a shard's members (name, component, set), within them or with visitors."""
    index = Index([m[2] for m in members])
    forest = Forest()
    for i, (name, component, s) in enumerate(visitors or members):
        mine = component if visitors else name
        for j in index.search(s, -1 if visitors else i).tolist():
            other = members[j][1] if visitors else members[j][0]
            if other != mine and forest.join(mine, other):
                yield name, members[j][0]


def _search(batches):
    """Rows sorted by shard and role (0 member, 1 visitor); a shard's rows may span batches, and only one shard is held."""
    key, members, visitors, out = None, [], [], []
    visited = False

    def flush():
        if visitors or not visited:
            out.extend(_search_shard(members, visitors))

    def batch_of():
        got = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out.clear()
        return got

    for batch in batches:
        for shard, role, name, component, s in zip(*(batch.column(c).to_pylist() for c in ("shard", "role", "id", "component")), _sets(batch), strict=True):
            if shard != key:
                flush()
                key, members, visitors, visited = shard, [], [], False
            (visitors if role else members).append((name, component, s))
            if len(visitors) >= SHARD_NODES:  # visitors come after all members; they are searched in blocks
                flush()
                visitors, visited = [], True
        if len(out) > 10_000:
            yield batch_of()
    flush()
    yield batch_of()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the documents in a table of ids and, where its bitmap is full, of others; texts travel, for they are smaller than their sets."""
    able = bitmap(ids)

    def run(batches):
        for batch in batches:
            at = batch.column("doc_id")
            yield batch.filter(pa.array(in_bitmap(able, at.fill_null(0).to_numpy().view(np.uint64)) & at.is_valid().to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(tidy(run), docs.schema).withColumnRenamed("doc_id", "id")


def _in_shards(docs: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """Links of rows (shard, role, id, component) within their shards."""
    told = _texts(docs, rows.select("id")).join(rows, "id").select("shard", "role", "id", "component", "text")
    return told.repartition(parts, "shard").sortWithinPartitions("shard", "role", "id").mapInArrow(tidy(_search), "a long, b long")


def _only(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """rows whose token is in the table; a bitmap keeps most others out of the join."""
    able = bitmap(tokens)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(able, batch.column("token").to_numpy().view(np.uint64))))

    return rows.mapInArrow(tidy(run), rows.schema).join(tokens, "token", "left_semi")


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row.

    Null and blank texts have an empty set and link with nothing; rows that repeat an id count as one
    document; rows without an id belong to no component (null).  An empty table gives no rows.  Long
    texts count whole; a task holds one shard's sets.  Further columns take no part, whatever their names.
    Equal sets are tied: the smallest id names the component.
    """
    with small_batches(docs.sparkSession):
        return _components(docs)


def _components(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    ws = Workspace(spark, "ngram")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = ws.cut(docs.mapInArrow(tidy(_describe), "kind int, doc_id long, node binary, n long, token long"), "described")
    of_docs = described.where("kind = 0").select("doc_id", "node", F.col("n").alias("n_shingles"))
    frequent = described.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST)
    hot = np.array([r["token"] for r in frequent.orderBy(F.desc("n"), "token").limit(HOT_TOKENS).select("token").collect()], np.int64).view(np.uint64)
    hot = np.sort(hot)
    reps = of_docs.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("s"))
    entries = (of_docs.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0) * (DEN - NUM + DEN // WIDER) // DEN
    buckets = max(16, -(-entries // BUCKET_ENTRIES))
    packed = docs.mapInArrow(tidy(_pack(hot, int(buckets))), "bucket int, tokens binary, owners binary, nodes binary")
    shared = ws.cut(packed.groupBy("bucket").applyInArrow(_shared, "node long, token long, df int"), "shared")
    del packed
    ws.release()

    enough = F.greatest(F.lit(1), F.floor(F.ceil(F.col("size") * NUM / DEN) / WIDER))
    known_as = reps.select(F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long").alias("node"), "id", F.col("s").alias("size"))
    homes = shared.groupBy("node").agg(F.max(F.struct("df", "token")).alias("top"), F.count(F.lit(1)).alias("n"), F.sum(F.log2("df")).alias("worth")).join(known_as, "node")
    homes = ws.cut(homes.where(F.col("n") >= enough).select("node", "id", "size", "worth", F.col("top.token").alias("home")), "homes")
    load = homes.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SHARD_NODES), F.ceil(F.sum("size") / SHARD_TOKENS)).alias("salts"))
    active = homes.join(load, "home").select("node", "id", "size", "worth", F.struct("home", F.pmod(F.xxhash64("id"), F.col("salts")).cast("long").alias("salt")).alias("shard"), (F.col("salts") > 1).alias("divided"))
    active = ws.cut(active, "active")
    ws.drop("homes")
    ws.release()

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    member = active.select("shard", F.lit(0).alias("role"), "id", F.col("id").alias("component"))
    links = [ws.cut(_in_shards(docs, member, parts), "within")]
    ws.release()
    divided = active.where("divided")
    if not divided.isEmpty():
        # the sets with most in common with their shard stand for it: among divided homes, each shard's members whose prefix is shared most
        leaders = divided.groupBy("shard").agg(F.max(F.struct("worth", "id")).alias("top"))
        led = leaders.select(F.struct("shard.home", F.lit(-1).cast("long").alias("salt")).alias("shard"), F.lit(0).alias("role"), F.col("top.id").alias("id"), F.col("top.id").alias("component"))
        links.append(ws.cut(_in_shards(docs, led, parts), "leaders"))
    found = links[0] if len(links) == 1 else links[0].union(links[1])
    first = components(found, ws, "cc1")
    weights = first.groupBy("component").count().withColumnRenamed("count", "w")
    known = active.join(first.withColumnRenamed("node", "id"), "id", "left").select("node", "id", "size", "shard", F.coalesce("component", "id").alias("component"))
    known = ws.cut(known.join(weights, "component", "left").select("node", "id", "size", "shard", "component", F.coalesce("w", F.lit(1)).alias("w")), "known")
    ws.drop("active")
    placed = shared.select("node", "token").join(known.select("node", "component", F.xxhash64("shard").alias("at")), "node").groupBy("token")
    several = placed.agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("at").alias("s0"), F.max("at").alias("s1")).where("c0 <> c1 and s0 <> s1").select("token")
    several = ws.cut(several, "several")  # few: a token's nodes mostly share a home
    ws.release()
    order = F.struct("w", "component").alias("order")
    apart = ws.cut(_only(several, shared.select("node", "token")).join(known, "node").select("token", "id", "size", "component", "shard", order), "apart")
    ws.drop("shared")
    there = apart.groupBy("token", F.col("shard").alias("to")).agg(F.max("order").alias("top"), F.min("size").alias("least"), F.max("size").alias("most"))
    sizes_meet = (F.col("least") * NUM <= F.col("size") * DEN) & (F.col("most") * DEN >= F.col("size") * NUM)
    visits = apart.join(there, "token").where((F.col("to") != F.col("shard")) & (F.col("top") > F.col("order")) & sizes_meet)
    visits = visits.groupBy("id", "size", "component", F.col("to").alias("shard")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough).select("shard", F.lit(1).alias("role"), "id", "component")
    visits = ws.cut(visits, "visits")
    ws.drop("apart")
    if not visits.isEmpty():
        members = known.join(visits.select("shard").distinct(), "shard").select("shard", F.lit(0).alias("role"), "id", "component")
        across = ws.cut(_in_shards(docs, members.union(visits), parts), "across")
        first = components(found.union(across), ws, "cc2")
    for name in ("known", "several", "visits"):
        ws.drop(name)
    labelled = reps.join(first.withColumnRenamed("node", "id"), "id", "left").select("node", F.coalesce("component", "id").alias("component"))
    return of_docs.join(labelled, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows whose document has the smallest id of its component, and rows without an id; all columns stay."""
    found = ngram_components(docs)
    gone = found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct().alias("gone")
    kept = docs.alias("kept")
    return kept.join(gone, F.col("kept.doc_id") == F.col("gone.doc_id"), "left_anti")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


#: shingle sets, links and the transitive closure of them; quadratic in a group's size, so for small tables
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 75 * (x.n + y.n - met)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""
