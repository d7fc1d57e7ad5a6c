"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is compressed whole, SEGMENT bytes at a time, with a dictionary trained on texts of each class.
The normalised size difference (bad - good) / (bad + good), sizes summed over the segments, is all that
the score is made of: a logistic curve of it alone gives the probability of label 1.  Segments keep the
dictionaries in force throughout a long text, which else would soon be compressed by its own history.

Dictionaries and curve are fitted on at most MOST_LABELS labelled rows outside the held-out fold, chosen
by a hash of the id, whatever their length; a dictionary is trained on all segments of half of them, or
on a sample by hash of about SAMPLE_BYTES where there are more bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refquarry.llm.common import as_bytes, fold, table
from refquarry.llm.toxicity import fit, training_rows

MOST_LABELS = 6000
DICTIONARY_BYTES = 112_640
#: bytes compressed at once, and bytes of segments that a dictionary is trained on, about
SEGMENT, SAMPLE_BYTES = 512, 6_000_000
LEVEL = 3
PREDICT_AT = 0.3
#: of ten times the difference, and the constant
WEIGHTS = np.array([4.0, 1.0])


class Compressor:
    """Sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for d in (good, bad):
            kind = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) if d else None
            if kind is not None:
                kind.precompute_compress(level=LEVEL)
            plain = {"write_content_size": False, "write_dict_id": False}
            self.by.append(zstandard.ZstdCompressor(dict_data=kind, **plain) if kind is not None else zstandard.ZstdCompressor(level=LEVEL, **plain))

    def difference(self, text: bytes) -> float:
        """(bad - good) / (bad + good), 0 for the empty text."""
        if not text:
            return 0.0
        good, bad = (sum(len(c.compress(text[i : i + SEGMENT])) for i in range(0, len(text), SEGMENT)) for c in self.by)
        return (bad - good) / (bad + good)


def _samples(rows: DataFrame, y: int) -> list[bytes]:
    """Segments of one class's texts, all or a sample by hash."""
    data = F.encode("text", "UTF-8")
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / SEGMENT).cast("int"))
    some = rows.where((F.col("y") == y) & (F.octet_length("text") > 0)).select(F.explode(F.transform(starts, lambda i: F.substring(data, i * SEGMENT + 1, F.lit(SEGMENT)))).alias("s"))
    total = some.agg(F.sum(F.octet_length("s")).alias("n")).first()["n"] or 0
    if total > SAMPLE_BYTES:
        some = some.where(F.pmod(F.xxhash64("s"), F.lit(1_000_003)) < int(1_000_003 * SAMPLE_BYTES / total))
    return [bytes(r["s"]) for r in some.orderBy(F.xxhash64("s"), "s").collect()]  # SAMPLE_BYTES, about


def _dictionary(samples: list[bytes]) -> bytes:
    if len(samples) < 64:
        return b"".join(samples)[-DICTIONARY_BYTES:]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Model:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels, "quality", fold("doc_id", 5) != 0, MOST_LABELS)
    # half of the rows make the dictionaries, the other half the curve: a text fits a dictionary made from itself too well
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    good, bad = (_dictionary(_samples(rows.where(half == 0), y)) for y in (1, 0))

    def differences(batches):
        c = Compressor(good, bad)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.difference(t) for t in as_bytes(b.column("text"))], pa.float64()), b.column("y")], names=["x", "y"])

    got = rows.where(half == 1).mapInArrow(differences, "x double, y int").collect()
    if not got:
        return Model(good, bad, WEIGHTS)
    return Model(good, bad, fit(10 * np.array([[r["x"]] for r in got]), np.array([r["y"] for r in got], float), WEIGHTS, hold=0.1))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null and empty texts get the score of a text whose sizes say nothing.

    Long texts are compressed whole.  Repeated rows give repeated results (a repeated label the larger
    one, in training), an empty table none; without labels every difference is 0.  Equal scores are equal
    decisions.  Further columns take no part, whatever their names.
    """

    def run(batches):
        c = Compressor(model.good, model.bad)
        for b in batches:
            x = 10 * np.array([c.difference(t) for t in as_bytes(b.column("text"))])
            p = 1 / (1 + np.exp(-np.clip(x * model.weights[0] + model.weights[1], -60, 60)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= PREDICT_AT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
