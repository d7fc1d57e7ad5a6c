"""Toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause.  Words become symbols (insult, stem, threat, modal, target, negation,
report, other) and pass five transducers, composed so that each reads what the one before it writes:

* insult: an insult stays one; of learnt stems a clause's first is a suspicion, each further one an insult;
* threat: a verb of violence after a modal verb is a threat, without one mere violence;
* negation: what follows a negation within two words is negated, and a threat is gone;
* reported speech: what follows a verb of saying is reported, and a threat is gone;
* target: what stands beside somebody addressed is aimed.

A clause's strongest output is its match, whose weight is the clause's score.  A text's score is a
logistic curve over its matched clauses: each kind's weight times the logarithm of one and the number
of clauses matched so, and the share of all clauses that are matched.

Base lexicons are fixed; words that mark the toxic class among training labels join the insults, and
stems that mark it in many inflected forms become the symbol stem; neither has a weight beside the
grammar.  Weights start from fixed values and are fitted on at most MOST_LABELS labelled rows (features
only reach the driver), with at most MOST_LEARNT words and as many stems.  Texts without any trigger
word are never tokenised.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refquarry.llm.common import Workspace, fold, table, tidy

MOST_LABELS = 8000
#: a learnt insult stands in this share of toxic training texts, and in a tenth of that share or less of the others
LEARNT_SHARE, LEARNT_LEAST, MOST_LEARNT = 0.10, 4, 500
#: a learnt stem stands at least twice in this share of toxic training texts, begins so many different words, and has so many characters
STEM_SHARE, STEM_FORMS, STEM_LENGTHS = 0.02, 8, range(3, 9)
PREDICT_AT = 0.3

# The base lexicons of the grammar.
INSULTS = "idiot idiots moron morons loser losers scum trash pathetic worthless stupid disgusting clown clowns imbecile dumb fool garbage filth vermin ugly idiota imbécil estúpido estúpida basura idiote imbécile stupide ordure crétin dummkopf trottel abschaum widerlich".split()
THREATS = "kill hurt destroy murder strangle stab shoot beat burn töten umbringen matar tuer".split()
MODALS = "will would shall should must gonna going wanna want ought werde wirst wird sollte muss vais vas va dois voy debo debería".split()
TARGETS = "you your yours yourself they them their he him she her these those du dich dir ihr euch tú te usted ustedes tu toi vous ils".split()
NEGATIONS = "not no never nobody isn't aren't nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says called calls wrote quoted claimed claims reported sagte nannte dit appelé dijo llamó".split()

#: what a clause may match, the strongest first, with the weights that are fitted from there
OUTPUTS = {"aimed_threat": 3.4, "aimed_insult": 3.3, "insult": 2.6, "threat": 1.6, "aimed_stem": 1.0, "stem": 0.8, "reported_insult": 0.8, "negated_insult": 0.5, "reported_stem": 0.2, "negated_stem": 0.1, "violence": 0.0}
_RANK = {o: i for i, o in enumerate(OUTPUTS)}
#: the share of matched clauses, as log(1 + percent)
FURTHER = {"share": 0.3}
START_BIAS = -3.0
_BREAKS = frozenset(".,;:!?\n")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.,;:!?\n]", re.UNICODE)


class Transducer:
    """States and arcs (state, symbol) -> (state, output); a missing arc stays and copies the symbol."""

    def __init__(self, arcs: dict[tuple[str, str], tuple[str, str]], start: str = "s"):
        self.arcs, self.start = arcs, start

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.arcs.get((state, symbol), (state, symbol))


class Composed:
    """Each transducer reads what the one before it writes; product states are built when first reached."""

    def __init__(self, *parts: Transducer):
        self.parts, self.start = parts, tuple(p.start for p in parts)
        self.arcs: dict[tuple[tuple[str, ...], str], tuple[tuple[str, ...], str]] = {}

    def step(self, state, symbol):
        if (state, symbol) not in self.arcs:
            out, states = symbol, []
            for part, s in zip(self.parts, state, strict=True):
                s, out = part.step(s, out)
                states.append(s)
            self.arcs[state, symbol] = tuple(states), out
        return self.arcs[state, symbol]


def grammar() -> Composed:
    insult = {("s", "stem"): ("m", "stem"), ("m", "stem"): ("m", "insult")}
    threat = {("s", "modal"): ("m", "other"), ("m", "modal"): ("m", "other"), ("m", "threat"): ("s", "threat"), ("s", "threat"): ("s", "violence")}
    negation = {("s", "negation"): ("3", "other"), ("3", "negation"): ("3", "other")}
    for here, then in (("3", "2"), ("2", "1"), ("1", "s")):  # reaches over two words
        negation |= {(here, x): (then, x) for x in ("other", "target", "report", "threat", "violence")}
        negation[here, "negation"] = ("3", "other")
        negation |= {(here, x): ("s", f"negated_{x}") for x in ("insult", "stem")}
    negation |= {(here, x): ("s", "other") for here in "23" for x in ("threat", "violence")}
    report = {("s", "report"): ("r", "other"), ("r", "insult"): ("r", "reported_insult"), ("r", "stem"): ("r", "reported_stem"), ("r", "report"): ("r", "other"), ("r", "threat"): ("r", "other"), ("r", "violence"): ("r", "other")}
    target = {(here, "target"): ("a", "other") for here in "sa"} | {("a", x): ("a", f"aimed_{x}") for x in ("insult", "stem", "threat")} | {("a", "violence"): ("w", "violence")}
    target |= {("s", x): (x[0] + "1", x) for x in ("insult", "stem")} | {(x[0] + "1", "target"): ("a", f"aimed_{x}") for x in ("insult", "stem")}
    target |= {(here, x): ("w", x) for here in ("s", "w") for x in ("threat", "violence")} | {("w", "target"): ("a", "aimed_threat")}
    return Composed(*map(Transducer, (insult, threat, negation, report, target)))


class Lexicon:
    def __init__(self, learnt: list[str], stems: list[str]):
        self.symbol = {w: s for s, ws in (("modal", MODALS), ("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("threat", THREATS), ("insult", [*INSULTS, *learnt])) for w in ws}
        self.stems, self.lengths = frozenset(stems), sorted({len(x) for x in stems})
        triggers = sorted({*INSULTS, *THREATS, *learnt, *stems}, key=len)
        self.triggers = [w for i, w in enumerate(triggers) if not any(x in w for x in triggers[:i])]

    def read(self, word: str) -> str:
        symbol = self.symbol.get(word)
        if symbol is None:
            symbol = "stem" if any(word[:k] in self.stems for k in self.lengths) else "other"
        return symbol


def clauses(text: str, lexicon: Lexicon, machine: Composed) -> tuple[Counter, int]:
    """How many clauses match each output as their strongest, and how many there are."""
    found, n, best, state, empty = Counter(), 0, None, machine.start, True
    for word in [*_WORD.findall(text), "\n"]:
        if word in _BREAKS:
            if not empty:
                n += 1
                if best is not None:
                    found[best] += 1
            best, state, empty = None, machine.start, True
            continue
        empty = False
        state, out = machine.step(state, lexicon.read(word))
        if out in _RANK and (best is None or _RANK[out] < _RANK[best]):
            best = out
    return found, n


def features(text: str | None, lexicon: Lexicon, machine: Composed) -> list[float]:
    """log(1 + clauses) of each output, and the further ones."""
    low = (text or "").lower()
    found, n = clauses(low, lexicon, machine) if any(w in low for w in lexicon.triggers) else (Counter(), 0)
    return [*(float(np.log1p(found[o])) for o in OUTPUTS), float(np.log1p(100.0 * found.total() / max(n, 1)))]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, start: np.ndarray, hold: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton's method, drawn towards `start` (so few labels move them little)."""
    w = start.copy()
    x = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(25):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w)), x.T @ (y - p) - hold * (w - start))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep, most: int = MOST_LABELS) -> DataFrame:
    """text and label y of at most `most` labelled documents outside the held-out fold, chosen by a hash of the id."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y")


def _word_counts(batches):
    """How many toxic and other texts have each word (kind 0) or have a prefix in two words or more (kind 1); the texts themselves under ''."""
    counts = {(k, y): Counter() for k in (0, 1) for y in (0, 1)}
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            found = [w for w in _WORD.findall((text or "").lower()) if len(w) > 2]
            y = int(y > 0)
            counts[0, y].update({"", *found})
            prefixes = Counter(w[:k] for w in found for k in STEM_LENGTHS if len(w) > k)
            counts[1, y].update(p for p, n in prefixes.items() if n > 1)
    rows = [(k, w, n, counts[k, 0][w]) for k in (0, 1) for w, n in counts[k, 1].items()] + [(k, w, 0, n) for k in (0, 1) for w, n in counts[k, 0].items() if w not in counts[k, 1]]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "word", "pos", "neg"])


class Model:
    def __init__(self, learnt: list[str], stems: list[str], weights: np.ndarray):
        self.learnt, self.stems, self.weights = learnt, stems, weights


START = np.array([*OUTPUTS.values(), *FURTHER.values(), START_BIAS])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels, "toxic", fold("doc_id", 4) != 2)
    counts = rows.mapInArrow(tidy(_word_counts), "kind int, word string, pos long, neg long").groupBy("kind", "word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ws = Workspace(docs.sparkSession, "toxicity")
    counts = ws.cut(counts, "counts")
    total = counts.where("kind = 0 and word = ''").first()
    if not total or not total["pos"]:
        return Model([], [], START)
    pos, neg = total["pos"], total["neg"]
    rare = (F.col("neg") + 0.5) / (neg + 1) <= 0.1 * F.col("pos") / pos
    found = counts.where((F.col("kind") == 0) & (F.col("word") != "") & (F.col("pos") >= max(LEARNT_LEAST, LEARNT_SHARE * pos)) & rare).orderBy(F.desc("pos"), "word").limit(MOST_LEARNT).collect()
    learnt = [r["word"] for r in found]
    forms = counts.where("kind = 0 and pos > 0").select(F.explode(F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEM_LENGTHS])).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("forms"))
    stems: list[str] = []
    able = counts.where((F.col("kind") == 1) & (F.col("pos") >= max(LEARNT_LEAST, STEM_SHARE * pos)) & rare).join(forms.where(F.col("forms") >= STEM_FORMS), "word")
    for r in able.orderBy(F.desc("pos"), F.desc(F.length("word")), "word").limit(10 * MOST_LEARNT).collect():
        if not any(r["word"].startswith(x) or x.startswith(r["word"]) for x in stems) and not any(w.startswith(r["word"]) for w in learnt):
            stems.append(r["word"])
    stems = stems[:MOST_LEARNT]
    ws.drop()

    def matrix(batches):
        lexicon, machine = Lexicon(learnt, stems), grammar()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t, lexicon, machine) for t in b.column("text").to_pylist()], pa.list_(pa.float64())), b.column("y")], names=["x", "y"])

    got = rows.mapInArrow(tidy(matrix), "x array<double>, y int").groupBy("x", "y").count().collect()
    x = np.repeat(np.array([r["x"] for r in got]), [r["count"] for r in got], axis=0)
    y = np.repeat(np.array([r["y"] for r in got], float), [r["count"] for r in got])
    return Model(learnt, stems, fit(x, y, START))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null and empty texts get the score of a text without matches.

    Long texts are read whole.  Repeated rows give repeated results (a repeated label the larger one, in
    training), an empty table none; without labels the fixed weights stand.  Equal scores are equal
    decisions.  Further columns take no part, whatever their names.
    """

    def run(batches):
        lexicon, machine = Lexicon(model.learnt, model.stems), grammar()
        for b in batches:
            x = np.array([features(t, lexicon, machine) for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(START) - 1)
            p = _sigmoid(x @ model.weights[:-1] + model.weights[-1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= PREDICT_AT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows below the limit, with all their columns; the text is read in place and nothing is shuffled."""

    def run(batches):
        lexicon, machine = Lexicon(model.learnt, model.stems), grammar()
        for b in batches:
            x = np.array([features(t, lexicon, machine) for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(START) - 1)
            yield b.filter(pa.array(_sigmoid(x @ model.weights[:-1] + model.weights[-1]) < PREDICT_AT))

    return docs.mapInArrow(tidy(run), docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
