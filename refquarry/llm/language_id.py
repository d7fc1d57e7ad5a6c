"""Language identification by interpolated Kneser-Ney character models.

One model per language over n-grams of up to ORDER characters within a word.  They are kept as one
sorted array of 64-bit n-gram hashes for each order, with a column of log probabilities and of
back-off weights for each language.  A text's score under a
language is the cross-entropy per character of its words; the lowest wins.

Rejection is calibrated on labelled texts that trained nothing (a fifth of them, CALIBRATE of a language
at most): a text of n characters is unexplained when its cross-entropy is further above its language's
mean than MARGIN times the largest such distance among them, both measured in standard deviations of
texts of their length, sqrt(a + b / n).  How much evidence the characters of a text are worth, from
which `score` follows, is chosen on the same texts.

Words are hashed and counted per batch, and each distinct word is scored once, so cost follows the
number of distinct words.  Training takes a bounded sample (SAMPLE_PER_LANGUAGE documents and
WORDS_PER_LANGUAGE word types of each language, however many other languages there are); only those
counts reach the driver, and the arrays grow with the number of languages.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refquarry.llm.common import NON_LETTERS, as_bytes, byte_table, chunks, fold, mix, table, tidy, words

ORDER = 4
SAMPLE_PER_LANGUAGE = 800
WORDS_PER_LANGUAGE = 15_000
#: labelled texts of a language that calibrate its limit, and how many it has at least for a fifth of them to be set aside
CALIBRATE, CALIBRATE_FROM = 400, 25
DISCOUNT = 0.75
#: distinct words that a worker remembers before it starts afresh
REMEMBERED = 300_000
#: names of languages that are sent to every task
MOST_BROADCAST = 100_000
#: what the limit stands beyond the least explained calibrating text
MARGIN = 1.25
#: characters that a text's evidence may count as, at most, for its score
EVIDENCE = (5, 10, 20, 50, 100, 200, 400)
_K = np.uint64(0xD6E8FEB86659FD93)
_START, _END = 1, 2


def _ngram_hashes(codes: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` codes that end at each position in `at`."""
    h = np.full(len(at), order, np.uint64)
    for j in range(order - 1, -1, -1):
        h = mix(h * _K + codes[at - j] + np.uint64(1))
    return h


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[i] == wanted, i


def _spell(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words with their marks, each code's word, and its place in the word (0: the start mark)."""
    lengths = np.fromiter((len(w) + 2 for w in texts), np.int64, len(texts))
    codes = np.frombuffer("".join(f"{chr(_START)}{w}{chr(_END)}" for w in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    return codes, owner, np.arange(len(codes)) - (np.cumsum(lengths) - lengths)[owner]


class KneserNey:
    """One language's model over words.  For each order: n-gram hashes (sorted) with log P, context hash and suffix hash; contexts (sorted) with log back-off."""

    def __init__(self, counts: dict[str, int], vocabulary: int):
        codes, owner, place = _spell(list(counts))
        weight = np.fromiter(counts.values(), float, len(counts))[owner]
        self.grams, self.contexts = [], []
        p_lower = np.array([1.0 / vocabulary])
        lower = np.zeros(1, np.uint64)
        for k in range(1, ORDER + 1):
            # the longest n-grams and those that begin a word count as often as they occur, the others once for each character before them
            raw = np.flatnonzero((place >= 1) & ((place >= k - 1) if k == ORDER else (place == k - 1)))
            keys, n, at = _ngram_hashes(codes, raw, k), weight[raw], raw
            if k < ORDER:
                wider = np.flatnonzero((place >= 1) & (place >= k))
                _, one = np.unique(_ngram_hashes(codes, wider, k + 1), return_index=True)
                keys = np.concatenate([keys, _ngram_hashes(codes, wider[one], k)])
                n, at = np.concatenate([n, np.ones(len(one))]), np.concatenate([at, wider[one]])
            grams, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            n, at = np.bincount(inverse, n, len(grams)), at[first]
            before = _ngram_hashes(codes, at - 1, k - 1)
            contexts, of = np.unique(before, return_inverse=True)
            total, kinds = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts))
            back = DISCOUNT * kinds / total
            suffix = _ngram_hashes(codes, at, k - 1) if k > 1 else np.zeros(len(at), np.uint64)
            p = np.maximum(n - DISCOUNT, 0) / total[of] + back[of] * p_lower[_find(lower, suffix)[1]]
            self.grams.append((grams, np.log(p), before, suffix))
            self.contexts.append((contexts, np.log(back)))
            lower, p_lower = grams, p


class Identifier:
    """All languages' models: for each order one sorted hash array with a column of log probabilities (and back-offs) per language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        vocabulary = len({c for words_ in counts.values() for w in words_ for c in w}) + 2
        self.floor = float(np.log(1 / vocabulary))
        self.means, self.a, self.b, self.most = np.full(len(self.languages), np.inf), 0.01, 4.0, 6.0
        self.evidence = 50
        models = [KneserNey(counts[x], vocabulary) for x in self.languages]
        self.tables = []
        below, p_below = np.zeros(1, np.uint64), np.full((1, len(models)), self.floor)
        for k in range(ORDER if models else 0):
            contexts = np.unique(np.concatenate([m.contexts[k][0] for m in models]))
            backs = np.zeros((len(contexts), len(models)))
            for c, m in enumerate(models):
                backs[np.searchsorted(contexts, m.contexts[k][0]), c] = m.contexts[k][1]
            grams, one = np.unique(np.concatenate([m.grams[k][0] for m in models]), return_index=True)
            before, suffix = (np.concatenate([m.grams[k][i] for m in models])[one] for i in (2, 3))
            logs = backs[np.searchsorted(contexts, before)] + p_below[_find(below, suffix)[1]]
            for c, m in enumerate(models):
                logs[np.searchsorted(grams, m.grams[k][0]), c] = m.grams[k][1]
            self.tables.append((grams, logs, contexts, backs))
            below, p_below = grams, logs

    def unlike(self, best: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How far texts of n characters lie above the mean of their best language, in standard deviations of such texts."""
        return (entropy - self.means[best]) / np.sqrt(self.a + self.b / np.maximum(n, 1))

    def word_scores(self, texts: list[str]) -> np.ndarray:
        """For each word: summed log P under each language, then the number of predicted characters (0: no letter)."""
        out = np.zeros((len(texts), len(self.languages) + 1))
        rows = np.array([i for i, w in enumerate(texts) if w], np.int64)
        if not len(rows) or not self.languages:
            out[rows, -1] = 1
            return out
        codes, owner, place = _spell([texts[i] for i in rows])
        logs = np.zeros((len(codes), len(self.languages)))
        left = np.flatnonzero(place > 0)
        for k in range(ORDER, 0, -1):  # the longest known n-gram decides; each longer context without it backs off
            grams, at_k, contexts, backs = self.tables[k - 1]
            able = place[left] >= k - 1
            here = left[able]
            seen, i = _find(grams, _ngram_hashes(codes, here, k))
            logs[here[seen]] += at_k[i[seen]]
            here = here[~seen]
            known, i = _find(contexts, _ngram_hashes(codes, here - 1, k - 1))
            logs[here[known]] += backs[i[known]]
            left = np.concatenate([left[~able], here])
        logs[left] += self.floor
        for c in range(len(self.languages)):
            out[rows, c] = np.bincount(owner, logs[:, c], len(rows))
        out[rows, -1] = np.bincount(owner, minlength=len(rows)) - 1
        return out


def letters(word: bytes) -> str:
    text = word.decode("utf-8", "replace").lower()
    return text if text.isalpha() else "".join(c for c in text if c.isalpha())


def _texts(batch_column):
    """(first row, per-row word table) for each chunk: texts, doc index, starts, ends, hashes."""
    blobs = as_bytes(batch_column)
    tables = byte_table(NON_LETTERS, lower=True)
    for a, b in chunks(blobs):
        yield a, b, words(blobs[a:b], tables)


def _count_words(batches):
    """(lang, word, n) for sampled documents, added up within a task's batch."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        counts: dict[str, Counter] = defaultdict(Counter)
        for a, _, (joined, doc, starts, ends, h) in _texts(batch.column("text")):
            _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            text = [letters(joined[starts[i] : ends[i]]) for i in first]
            keys = doc.astype(np.int64) * len(text) + inverse
            pairs, n = np.unique(keys, return_counts=True)
            for key, k in zip(pairs.tolist(), n.tolist(), strict=True):
                w = text[key % len(text)]
                if w:
                    counts[langs[a + key // len(text)]][w] += k
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "word", "n"])


def _sums(identifier: Identifier):
    """A function from an Arrow text column to each text's summed log P under each language and its number of predicted characters."""
    known: dict[int, int] = {}
    store = [np.zeros((1024, len(identifier.languages) + 1))]

    def sums_of(column) -> np.ndarray:
        sums = np.zeros((len(column), len(identifier.languages) + 1))
        for a, b, (joined, doc, starts, ends, h) in _texts(column):
            distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            if len(known) + len(distinct) > REMEMBERED:
                known.clear()
            hashes = distinct.tolist()
            new = [i for i, x in enumerate(hashes) if x not in known]
            if new:
                rows = identifier.word_scores([letters(joined[starts[i] : ends[i]]) for i in first[new].tolist()])
                while len(known) + len(new) > len(store[0]):
                    store[0] = np.concatenate([store[0], np.zeros_like(store[0])])
                at = len(known)
                store[0][at : at + len(new)] = rows
                known.update((hashes[i], at + j) for j, i in enumerate(new))
            rows = store[0][np.fromiter((known[x] for x in hashes), np.int64, len(hashes))][inverse]
            for c in range(rows.shape[1]):
                sums[a:b, c] += np.bincount(doc, rows[:, c], b - a)
        return sums

    return sums_of


def _odds(entropy: np.ndarray, n: np.ndarray, evidence: int) -> np.ndarray:
    """Of each text, the languages' probabilities when its characters count as `evidence` independent ones at most."""
    p = np.exp(-np.minimum((entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(n, evidence)[:, None], 700))
    return p / p.sum(axis=1, keepdims=True)


def _score(identifier: Identifier):
    def run(batches):
        sums_of = _sums(identifier)
        for batch in batches:
            n_rows = batch.num_rows
            sums = sums_of(batch.column("text"))
            n = sums[:, -1]
            if identifier.languages:
                entropy = -sums[:, :-1] / np.maximum(n, 1)[:, None]
                best = entropy.argmin(axis=1)
                low = entropy[np.arange(n_rows), best]
                score = _odds(entropy, n, identifier.evidence)[np.arange(n_rows), best]
                names = [identifier.languages[i] for i in best]
                unlike = identifier.unlike(best, low, n) > identifier.most
            else:
                score, low, names, unlike = np.zeros(n_rows), np.zeros(n_rows), ["und"] * n_rows, np.zeros(n_rows, bool)
            no = (n == 0) | (not identifier.languages)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(["und" if x else y for x, y in zip(no, names, strict=True)]), pa.array(np.where(no, 0.0, score)), pa.array(low), pa.array(no | unlike)],
                names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return run


def calibrate(model: Identifier, langs: list[str], entropy: np.ndarray, n: np.ndarray) -> None:
    """Sets means, spread by length, limit and evidence from labelled texts that trained nothing."""
    best = entropy.argmin(axis=1)
    low = entropy[np.arange(len(n)), best]
    for c in range(len(model.languages)):
        model.means[c] = low[best == c].mean() if (best == c).any() else low.mean()
    square = (low - model.means[best]) ** 2
    long_ = n >= 256
    model.a = max(0.0025, float(square[long_].mean())) if long_.any() else model.a
    model.b = max(1.0, float((np.maximum(square - model.a, 0) * n)[~long_].mean())) if (~long_).any() else model.b
    model.most = MARGIN * max(4.0, float(model.unlike(best, low, n).max()))
    right = np.array([model.languages.index(x) for x in langs])
    model.evidence = max(EVIDENCE, key=lambda e: np.log(np.maximum(_odds(entropy, n, e)[np.arange(len(n)), right], 1e-9)).mean())


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Identifier:
    """Fits on rows with a language, a text and a crc32 fold (modulo 4) other than 2, at most per_language of each language expected."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang"))
    few = sizes.count() <= MOST_BROADCAST  # texts are shuffled by language only if there are more names than can be sent to all tasks
    rows = rows.join(F.broadcast(sizes) if few else sizes, "lang")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    aside = (F.col("of_lang") >= CALIBRATE_FROM) & (F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0)
    sample = rows.where(~aside & (part * F.col("of_lang") < per_language * 1.25))
    counts = sample.select("lang", "text").mapInArrow(tidy(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by: dict[str, dict[str, int]] = defaultdict(dict)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= WORDS_PER_LANGUAGE).select("lang", "word", "n").collect():
        by[r["lang"]][r["word"]] = r["n"]
    model = Identifier(dict(by))
    if not by:
        return model

    def measure(batches):
        sums_of = _sums(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(sums_of(batch.column("text"))), pa.list_(pa.float64()))], names=["lang", "sums"])

    able = F.col("lang").isin(*model.languages) if len(by) < 1000 else F.lit(True)
    measured = rows.where(aside & able & (part * F.col("of_lang") < CALIBRATE * 5)).select("lang", "text").mapInArrow(tidy(measure), "lang string, sums array<double>").collect()
    measured = [(r["lang"], r["sums"]) for r in measured if r["lang"] in by and r["sums"][-1]]
    if measured:
        sums = np.array([x for _, x in measured])
        calibrate(model, [x for x, _ in measured], -sums[:, :-1] / sums[:, -1:], sums[:, -1])
    return model


def predict(docs: DataFrame, model: Identifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for each row; `und` where the text is null or has no letter, or nothing was learnt.

    Ties go to the language that sorts first; repeated rows give repeated results; an empty table gives none.
    Long texts are read whole.  Without labelled texts to calibrate on (fewer than CALIBRATE_FROM of each
    language) nothing with letters is rejected.  Further columns take no part, whatever their names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(tidy(_score(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def drop_unexplained(docs: DataFrame, model: Identifier) -> DataFrame:
    """The rows with letters whose text some language explains, with all their columns."""
    score = _score(model)

    def run(batches):
        for b in batches:
            named = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows), pa.nulls(b.num_rows), b.column("text")], names=["doc_id", "held_out", "text"])
            for scored in score(iter([named])):
                yield b.filter(pa.compute.invert(scored.column("rejected")))

    return docs.mapInArrow(tidy(run), docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
