import math
import random
import zlib

import pytest

from ledgerline.llm.toxicity import (
    DIE, FILLER, INSULT, INTENT, KINDS, NEGATION, OTHER, REPORT, SELF, TARGET, VIOLENCE, Grammar, Lexicon, auc, features, toxicity,
)
from tests.llm.conftest import SMALL


def clause(*classes):
    found = Grammar().clause([(c, 2.0 if c == INSULT else 0.0) for c in classes])
    return {k: v for k, v in found.items() if v}


def plain_clause(classes):
    """The rules of the grammar, read off the whole clause at once."""
    sums = dict.fromkeys(KINDS, 0.0)
    names = [c for c, _ in classes]
    report = next((i for i, c in enumerate(names) if c == REPORT and (i == 0 or names[i - 1] != SELF)), len(names))
    used = set()
    for i, (name, weight) in enumerate(classes):
        reported, negated = i > report, NEGATION in names[max(0, i - 4) : i]
        if name == INSULT:
            near = TARGET in names[max(0, i - 4) : i] + names[i + 1 : i + 5]
            sums["negated" if negated else "reported" if reported else "targeted" if near else "plain"] += weight
        kind = None
        if name == TARGET:
            before = [k for k in range(i) if names[k] != FILLER]
            if before and names[before[-1]] == VIOLENCE and before[-1] not in used:
                verb = before[-1]
                kind = "threats" if INTENT in names[max(0, verb - 3) : verb + 1] else "mild"
        elif name in (VIOLENCE, DIE):
            left, k = 3, i - 1
            while k >= 0 and left > 0 and names[k] != TARGET:
                left -= names[k] != FILLER
                k -= 1
            aimed = k >= 0 and left > 0 and names[k] == TARGET
            if aimed and (name == DIE or INTENT in names[max(0, i - 4) : i]):
                kind = "mild" if name == DIE else "threats"
                if name == VIOLENCE:
                    used.add(i)
        if kind:
            sums["denied" if negated or reported else kind] += 1
    return sums


def test_machine_equals_the_rules():
    rng = random.Random(11)
    names = [INSULT, VIOLENCE, INTENT, DIE, TARGET, NEGATION, REPORT, SELF, FILLER, OTHER, OTHER]
    for _ in range(5_000):
        classes = [(c, rng.choice([1.0, 2.5]) if c == INSULT else 0.0) for c in rng.choices(names, k=rng.randrange(9))]
        assert Grammar().clause(classes) == plain_clause(classes), classes


def test_clauses():
    assert clause(OTHER, INSULT) == {"plain": 2}
    assert clause(TARGET, OTHER, INSULT) == {"targeted": 2} == clause(INSULT, OTHER, TARGET)
    assert clause(TARGET, NEGATION, OTHER, INSULT) == {"negated": 2}
    assert clause(REPORT, OTHER, OTHER, OTHER, OTHER, OTHER, INSULT) == {"reported": 2}
    assert clause(TARGET, OTHER, OTHER, OTHER, OTHER, INSULT) == {"plain": 2}
    assert clause(INTENT, VIOLENCE, TARGET) == {"threats": 1} and clause(VIOLENCE, OTHER) == {}
    assert clause(SELF, REPORT, INTENT, VIOLENCE, TARGET) == {"threats": 1}  # the writer's own words
    assert clause(REPORT, INTENT, VIOLENCE, TARGET) == {"denied": 1} == clause(NEGATION, VIOLENCE, TARGET)


def test_sentences():
    """Threats in four languages, their inflections, and what only looks like one."""
    read = lambda text: features(text, Lexicon({"stinker": 3.0}), Grammar())
    kinds = lambda text: {k: round(math.expm1(v)) for k, v in zip(KINDS, read(text)[1:]) if v}
    for text in ("I will kill you", "I'll kill all of you", "ich werde dich töten", "je vais te tuer", "voy a matarte", "they are going to hurt them",
                 "We’ll strangle him"):
        assert kinds(text) == {"threats": 1}, text
    for text in ("they killed you", "killing you now", "ich töte dich", "you should die", "shot them", "du sollst sterben"):
        assert kinds(text) == {"mild": 1}, text
    for text in ("I'll shoot a photo of you", "the fire will burn", "you beat the record", "they die of age. You live", "nobody here"):
        assert kinds(text) in ({}, {"mild": 1}) and "threats" not in kinds(text), text
    assert kinds("sie wollen die Tür öffnen, du die Fenster") == {} == kinds("you and the die are cast")
    assert kinds("I'll shoot a photo of you") == {} and kinds("he said they will kill you") == {"denied": 1} == kinds("I won't hurt you")
    order = ["I will kill you", "they killed you", "he said they will kill you", "a fine day"]
    worst = [read(t)[0] for t in order]
    assert worst == sorted(worst, reverse=True) and len(set(worst)) == 4
    assert read("You stinker")[0] > read("a stinker")[0] > read("he called him a stinker")[0] > read("no stinker")[0] > read("x")[0] == 0


@pytest.fixture(scope="module")
def middle(spark):
    folder = SMALL.replace("0.001", "0.1")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(middle):
    docs, labels = middle
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity(docs, labels).collect() if r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    # the score is the regression's, the same function of the features for all rows
    by_features = {}
    for r in rows:
        assert by_features.setdefault(tuple(r.features), r.score) == r.score
    out = [r for r in rows if r.held_out]
    assert auc([r.score for r in out], [truth[r.doc_id] for r in out]) > 0.93
    hit = sum(r.predicted and truth[r.doc_id] for r in out)
    assert hit >= 0.85 * sum(truth[r.doc_id] for r in out) and hit >= 0.9 * sum(r.predicted for r in out)


def test_odd_rows(spark, odd, empty, labels, no_labels):
    for known in (labels, no_labels):
        found = toxicity(odd, known).collect()
        assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.doc_id in (1, 2, 3)}) == 1
    assert {r.score for r in toxicity(odd, no_labels).collect()} == {0.0}
    assert toxicity(empty, labels).collect() == []
