"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes: insults with weights, learned from labels as whole words and as stems, and short fixed lists of
verbs of violence with their inflections, intentions, targets, negations and reporting verbs. Five transducers read a
clause side by side, as one composed machine:

* *insult* gives the weight of each insult,
* *threat* gives a threat where an intention, a verb of violence and its target follow in an order that one of the
  languages has ("will kill you", "werde dich töten"), a milder one without an intention ("they killed you") and for a
  wish that the target dies,
* *target* and *negation* tell whether one was read among the last few words,
* *report* tells whether somebody else's words are given: a reporting verb that is not the writer's own.

What an insult or a threat counts depends on the others. The sums over matched clauses are the features of a logistic
regression; threats that no label speaks of count through the worst clause of a text.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, written

#: Labelled documents that lexicon and weights are learned from, at most; those with the smallest hashes.
TRAIN_ROWS = 20_000
#: Evidence (log-likelihood ratio) and log odds that a word or a stem needs.
EVIDENCE, WORD_ODDS, STEM_ODDS = 20.0, 3.0, 4.0
STEMS = (4, 5, 6)
PREDICT = 0.3
#: Tokens within which a target or a negation bears on an insult, and an intention on a verb.
NEAR = 4
#: What the kinds of matches weigh in a clause: insults by their own weight, threats by these.
SHARES = {"plain": 1.0, "targeted": 1.5, "negated": 0.3, "reported": 0.6}
THREATS = {"threats": 8.0, "mild": 3.0, "denied": 0.8}
KINDS = (*SHARES, *THREATS)
FEATURES = ("worst", *KINDS, "share")

VIOLENCE, INTENT, DIE, TARGET, NEGATION, REPORT, SELF, FILLER, INSULT, OTHER = (
    "violence intent die target negation report self filler insult other".split()
)
# fixed values: words of the classes; verbs of violence as stems with the endings that they take
WORDS = {
    INTENT: "will i'll we'll they'll he'll she'll gonna going shall would should must let let's want wanna werde werden wird wirst "
    "soll sollst sollte will möchte vais va allons vont devrais veux voy va vamos van quiero debería",
    DIE: "perish rot stirb stirbt sterben krepier krepieren verrecke verrecken meurs meurt mourir crève crever "
    "muere muérete morir morirte",
    TARGET: "you your yours them they him she u du dich dir ihr euch sie tu te toi vous ils elles ustedes vosotros",
    NEGATION: "not no never neither nor don't isn't aren't won't wouldn't didn't cannot can't nicht kein keine nie niemals ne jamais aucun "
    "nunca jamás ningún",
    REPORT: "said says wrote writes called calls claimed told quoted reported sagte schrieb nannte dit écrit "
    "appelé dijo escribió llamó",
    SELF: "i we ich wir je nous yo nosotros",
    FILLER: "all of both the to just fucking damn really alle beide einfach gerade tous todos a",
}
STEMS_OF_VIOLENCE = {
    "kill hurt destroy beat punch stab shoot burn crush murder strangle smash": "s es ed ing er ers",
    "töt umbring schlag verletz erschieß erstech verprügel": "e st t en et te ten end",
    "tu frapp poignard égorg massacr": "er e es ez ent erai era erons ant é ée",
    "mat golpe destru quem apuñal": "ar o as a an aré ará aremos arte arlos arla aros ando ir iré iremos yendo",
}
_CLASSES = {w: name for name, words in WORDS.items() for w in words.split()}
_CLASSES |= {stem + end: VIOLENCE for stems, ends in STEMS_OF_VIOLENCE.items() for stem in stems.split() for end in ends.split()}
_CLASSES |= {w: VIOLENCE for w in "kill hurt destroy beat punch stab shoot shot burn crush murder strangle smash bringe umgebracht killing".split()}
#: "die" is an article in another language; after these it is the verb.
_BEFORE_DIE = frozenset("should must shall gonna to would".split())
#: Verbs that hold their own target, as Spanish infinitives do.
_HOLDS = frozenset("matarte matarlos mataros golpearte".split())
#: Words that a clause without an insult is looked at for.
_STARTS = frozenset(w for w, name in _CLASSES.items() if name in (VIOLENCE, DIE))
_TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]")
_ENDS = frozenset(".!?;\n")


def _near(name: str):
    """A transducer that says whether the class was read among the last ``NEAR`` tokens; its state counts down."""
    return 0, lambda state, read: (NEAR if read == name else max(0, state - 1), state > 0)


def _reported():
    """A transducer that says whether somebody's words are given. State: 0 not, 1 the writer was just named, 2 given."""

    def step(state: int, read: str) -> tuple[int, bool]:
        if read == REPORT and state == 0:
            return 2, False
        return (1 if read == SELF else 0) if state != 2 else 2, state == 2

    return 0, step


def _insult():
    """A transducer without memory: the kind of token whose weight counts."""
    return None, lambda state, read: (None, read == INSULT)


def _threat():
    """A transducer that gives ``threats``, ``mild`` or nothing.

    State: tokens for which an intention, a target and a verb of violence still bear, and whether that verb was
    intended. A verb bears on the next word only, fillers left aside.
    """

    def step(state: tuple, read: str) -> tuple[tuple, str | None]:
        intent, target, verb, meant = state
        out = None
        if read == TARGET and verb:
            out, verb = "threats" if meant else "mild", 0
        elif read == VIOLENCE and target and intent:  # the target came first
            out = "threats"
        elif read == DIE and target:
            out = "mild"
        intent = NEAR if read == INTENT else max(0, intent - 1)
        if read == VIOLENCE:
            verb, meant = (0, False) if out else (1, intent > 0)
        elif read != FILLER:
            verb, meant = 0, False
        target = 3 if read == TARGET else target if read == FILLER else max(0, target - 1)
        return (intent, target, verb, meant), out

    return (0, 0, 0, False), step


class Grammar:
    """The transducers composed into one machine, whose transitions are worked out as they are met."""

    def __init__(self) -> None:
        parts = [_insult(), _threat(), _near(TARGET), _near(NEGATION), _reported()]
        self.start = tuple(state for state, _ in parts)
        self.steps = [step for _, step in parts]
        self.table: dict = {}

    def step(self, state: tuple, read: str) -> tuple[tuple, tuple]:
        found = self.table.get((state, read))
        if found is None:
            pairs = [step(s, read) for s, step in zip(state, self.steps)]
            found = self.table[state, read] = tuple(p[0] for p in pairs), tuple(p[1] for p in pairs)
        return found

    def clause(self, classes: list[tuple[str, float]]) -> dict[str, float]:
        """The weight of each kind of match in a clause, whose tokens are classes with weights."""
        forward, state = [], self.start
        for name, _ in classes:
            state, out = self.step(state, name)
            forward.append(out)
        backward, state = [], self.start
        for name, _ in reversed(classes):  # a target may follow an insult
            state, out = self.step(state, name)
            backward.append(out[2])
        sums = dict.fromkeys(KINDS, 0.0)
        for (_, weight), (insult, threat, target, negated, reported), after in zip(classes, forward, reversed(backward)):
            if insult:
                sums["negated" if negated else "reported" if reported else "targeted" if target or after else "plain"] += weight
            if threat:
                sums["denied" if negated or reported else threat] += 1
        return sums


def severity(sums: dict[str, float]) -> float:
    """What a clause weighs."""
    return sum(sums[kind] * share for kind, share in (SHARES | THREATS).items())


class Lexicon(dict):
    """Weights of words, by the learned words and stems; remembers what it was asked."""

    LIMIT = 500_000

    def __init__(self, entries: dict[str, float]) -> None:
        super().__init__()
        self.entries = entries

    def __missing__(self, word: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        known = self.entries
        weight = known.get(word, 0.0) or max(
            (known.get(word[:n] + "*", 0.0) for n in STEMS if len(word) > n), default=0.0
        )
        self[word] = weight
        return weight


def classified(words: list[str], lexicon: Lexicon) -> list[tuple[str, float]]:
    """The classes of the words of a clause with their weights; a verb that holds its target is both."""
    out, before = [], ""
    for word in words:
        if lexicon[word]:
            out.append((INSULT, lexicon[word]))
        elif word == "die" and before in _BEFORE_DIE:
            out.append((DIE, 0.0))
        else:
            out.append((_CLASSES.get(word, OTHER), 0.0))
        if word in _HOLDS:
            out.append((TARGET, 0.0))
        before = word
    return out


def features(text: str | None, lexicon: Lexicon, grammar: Grammar) -> list[float]:
    """The features of a text, all 0 for a null or empty one."""
    words = _TOKENS.findall(text.lower().replace("’", "'")) if text else []
    sums, worst, matched, done = dict.fromkeys(KINDS, 0.0), 0.0, 0, 0
    hits = [i for i, w in enumerate(words) if lexicon[w] or w in _STARTS or w == "die" and i and words[i - 1] in _BEFORE_DIE]
    for i in hits:
        if i < done:
            continue
        start = next((j + 1 for j in range(i, done - 1, -1) if words[j] in _ENDS), done)
        done = next((j for j in range(i, len(words)) if words[j] in _ENDS), len(words))
        found = grammar.clause(classified(words[start:done], lexicon))
        if any(found.values()):
            matched += 1
            sums = {kind: sums[kind] + found[kind] for kind in KINDS}
            worst = max(worst, severity(found))
    clauses = sum(1 for w in words if w in _ENDS) + 1
    return [worst, *(math.log1p(sums[kind]) for kind in KINDS), matched / clauses]


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 when divided by 4; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _lexicon(train: DataFrame) -> dict[str, float]:
    """Words and stems that stand in far more toxic documents than others, with their log odds."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w for w in _TOKENS.findall((text or "").lower()) if w not in _ENDS}
            for entry in words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}:
                seen.setdefault(entry, [0, 0])[toxic] += 1
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (1, 0))],
            names=["entry", "a", "b"],
        )

    train = written(train.dropDuplicates(["text", "toxic"]), "texts")  # copies prove nothing twice
    toxic, clean = train.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not toxic or not clean:
        return {}
    counts = arrow_map(train.select("text", "toxic"), count, "entry string, a long, b long").groupBy("entry").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    odds = f"ln(((a + 0.5) / ({toxic} - a + 0.5)) / ((b + 0.5) / ({clean} - b + 0.5)))"
    part = lambda seen, rate: f"if({seen} > 0, {seen} * ln({seen} / ({rate})), 0)"
    both, n = "(a + b)", toxic + clean
    evidence = " + ".join(
        part(seen, rate) for seen, rate in (
            ("a", f"{both} * {toxic} / {n}"), ("b", f"{both} * {clean} / {n}"),
            (f"({toxic} - a)", f"({n} - {both}) * {toxic} / {n}"), (f"({clean} - b)", f"({n} - {both}) * {clean} / {n}"),
        )
    )
    rows = counts.where("a >= 3").select("entry", F.expr(odds).alias("odds"), F.expr(f"2 * ({evidence})").alias("g"))
    least = F.when(F.col("entry").endswith("*"), STEM_ODDS).otherwise(WORD_ODDS)
    best = rows.where((F.col("odds") >= least) & (F.col("g") >= EVIDENCE)).orderBy(F.col("g").desc(), "entry")
    return {r["entry"]: r["odds"] for r in best.collect()}  # no more than the labelled texts have


def _measured(rows: DataFrame, entries: dict[str, float], more: str) -> DataFrame:
    """``rows(text, ...)`` with the feature array ``f`` in place of the text; ``more`` are the other columns' types."""
    names = [c for c in rows.columns if c != "text"]
    lexicon, grammar = Lexicon(entries), Grammar()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t, lexicon, grammar) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.float64()))], names=[*names, "f"]
        )

    return arrow_map(rows, run, f"{more}, f array<double>")


def toxicity(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", toxic: str = "toxic"
) -> DataFrame:
    """``(key, held_out, score, predicted, features)`` per row; score is 0 to 1, predicted 1 from ``PREDICT`` on.

    Labels are learned from rows that are not held out, ``TRAIN_ROWS`` at most, those with the smallest hashes; key, language and source are no
    input of a score. A key with several labels counts as toxic if one of them says so. Null labels are no
    labels. Null and empty texts match nothing and get the score of a text without matches. Without labels of both
    kinds all scores are the share of toxic labels, or 0. Texts of any length are read whole; a score equal to ``PREDICT``
    is predicted 1. Repeated rows are scored alike, each of them. Other columns are not read. An empty table stays empty.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull() & ~held_out(F.col(key)))
    chosen = known.groupBy(F.col(key).alias("__id")).agg(F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    chosen = written(chosen.orderBy(F.xxhash64("__id"), "__id").limit(TRAIN_ROWS), "labelled")
    train = written(
        docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), F.col("__key") == F.col("__id")).select("text", "toxic"),
        "train",
    )
    entries = _lexicon(train)
    share = train.agg(F.avg("toxic")).first()[0] or 0.0
    weights, base = [0.0] * len(FEATURES), None
    if 0 < share < 1:
        points = written(_measured(train, entries, "toxic int"), "points").select(array_to_vector("f").alias("x"), "toxic")
        model = LogisticRegression(featuresCol="x", labelCol="toxic", maxIter=50, regParam=1e-4).fit(points)
        weights, base = model.coefficients.toArray().tolist(), float(model.intercept)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    found = _measured(rows, entries, f"key {kind}, held_out boolean")
    if base is None:
        score = F.lit(float(share))
    else:
        total = sum((F.col("f")[i] * w for i, w in enumerate(weights)), F.lit(base))
        score = 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))
    return found.select(
        F.col("key").alias(key), "held_out", score.alias("score"), (score >= PREDICT).cast("int").alias("predicted"),
        F.col("f").alias("features"),
    )


def auc(scores: list[float], truth: list[int]) -> float:
    """Area under the curve, ties counted half."""
    order = np.argsort(scores, kind="stable")
    s, y = np.asarray(scores)[order], np.asarray(truth)[order]
    _, first, count = np.unique(s, return_index=True, return_counts=True)
    ranks = np.repeat(first + (count + 1) / 2, count)
    good = int(y.sum())
    return (ranks[y == 1].sum() - good * (good + 1) / 2) / (good * (len(y) - good)) if 0 < good < len(y) else math.nan
