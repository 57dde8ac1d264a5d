"""Toxicity by a weighted finite-state grammar over clauses.

Words are first read into classes: insult, threat, target, negation, reported speech. Four small
transducers run side by side over the classes of a clause, and their composition weighs what the
insult and threat transducers accept:

* the target transducer raises a hit that stands near a person;
* the negation transducer lowers a hit in the scope of a negation;
* the reported-speech transducer lowers a hit behind a verb of saying or inside quotation marks.

Function words are fixed lists for four languages. The insult words are learnt: word starts, read
as a prefix automaton, whose documents are nearly all labelled toxic. A logistic curve over the
matched clauses turns their weights into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, keep_rows, key_and_bytes, query, store, table
from .labelled import labelled_sample, training_rows, with_verdict

# fixed values: function words of the grammar
TARGETS = frozenset("you your u yours he she they him her them this these that those everyone people du dich dir ihr euch er sie "
                    "der die diese tu te toi vous il elle ils elles ce cette ces usted ustedes tú ti él ella ellos este esta".split())
NEGATIONS = frozenset("not no never nor don't isn't aren't wasn't nobody nicht kein keine nie niemals ne pas jamais aucun nunca "
                      "ningún ninguna tampoco".split())
REPORTING = frozenset("said says say called calls wrote writes claimed quoted tweeted sagte sagt nannte schrieb dit disait écrit "
                      "appelé dijo dice llamó escribió".split())
THREATS = frozenset("kill hurt destroy punish shoot beat töten umbringen schlagen tuer frapper détruire matar golpear destruir".split())
QUOTES = "\"“”„«»"

PER_CLASS, SHORTEST, LONGEST = 3000, 3, 9
THREAT_WEIGHT, NEAR_TARGET, NEGATED, REPORTED, SCOPE = 2.0, 1.25, 0.4, 0.5, 3
CLEAN_COST = 10.0

_CLAUSES = re.compile(r"[.!?;:\n]+")
_TOKENS = re.compile(rf"[^\W\d_]+(?:'[^\W\d_]+)?|[{QUOTES}]")


def clause_weight(clause: str, insults: dict[str, float], lengths: tuple[int, ...]) -> float:
    """Run the composed transducers over one clause; 0 if nothing in it is accepted."""
    total, negated, quoted, reported, since_target, pending = 0.0, 0, False, False, SCOPE + 1, []
    for word in _TOKENS.findall(clause):
        if word in QUOTES:
            quoted = not quoted
            continue
        since_target += 1
        negated = max(0, negated - 1)
        weight = next((insults[word[:n]] for n in lengths if word[:n] in insults), 0.0)
        if word in THREATS:
            weight = max(weight, THREAT_WEIGHT)
        if weight:
            weight *= (NEGATED if negated else 1.0) * (REPORTED if quoted or reported else 1.0)
            if since_target <= SCOPE:
                weight *= NEAR_TARGET
            else:
                pending.append([weight, SCOPE + 1])  # a target may still follow
            total += weight
        if word in TARGETS:
            since_target = 0
            total += sum((NEAR_TARGET - 1) * w for w, left in pending if left > 0)
            pending = []
        pending = [[w, left - 1] for w, left in pending if left > 1]
        if word in NEGATIONS:
            negated = SCOPE + 1
        if word in REPORTING:
            reported = True
    return total


def clause_features(text: str, insults: dict[str, float], finder: re.Pattern | None) -> tuple[float, float, float]:
    """Strongest clause, sum over the clauses, and sum per 100 words, each damped by a logarithm."""
    text = text.lower()
    if not text or finder is None or finder.search(text) is None:
        return 0.0, 0.0, 0.0
    lengths = tuple(sorted({len(p) for p in insults}, reverse=True))
    weights = [clause_weight(c, insults, lengths) for c in _CLAUSES.split(text) if finder.search(c)]
    if not weights:
        return 0.0, 0.0, 0.0
    words = text.count(" ") + text.count("\n") + 1
    return math.log1p(max(weights)), math.log1p(sum(weights)), math.log1p(100 * sum(weights) / words)


def _finder(insults: dict[str, float]) -> re.Pattern | None:
    starts = sorted(set(insults) | THREATS, key=lambda p: (-len(p), p))
    return re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, starts)) + ")")


def learn_insults(sample: DataFrame, least_share: float = 0.003, least_docs: int = 3, purity: float = 0.97,
                  shortest: int = SHORTEST, longest: int = LONGEST) -> dict[str, float]:
    """Word starts -> weight (log odds) of the starts that nearly only toxic documents hold.

    A start is a candidate when at least ``least_share`` of the toxic texts hold it and at least
    ``purity`` of all texts with it, both classes brought to one size, are toxic. Candidates are taken
    greedily as long as one explains enough toxic texts that no earlier one explains; then follow
    frequent ones that no clean text holds.
    """
    def count(batches):
        seen = [Counter(), Counter()]
        for b in batches:
            for text, y in zip(b["text"], b["y"]):
                words = set(re.findall(r"[^\W\d_]+", text.decode("utf-8", "replace").lower()))
                seen[y].update({w[:n] for w in words for n in range(shortest, min(longest, len(w)) + 1)})
        keys = list(set(seen[0]) | set(seen[1]))
        for at in range(0, len(keys), 50_000):
            part = keys[at:at + 50_000]
            yield {"start": part, "toxic": [seen[1][k] for k in part], "clean": [seen[0][k] for k in part]}

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}
    counts = in_arrow(sample.select("text", "y"), count, "start string, toxic long, clean long").groupBy("start").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate1, rate0 = F.col("toxic") / n1, F.col("clean") / n0
    # at most longest - shortest + 1 starts per word and 1 / least_share such words per text length: a small list
    rows = counts.filter((F.col("toxic") >= max(least_docs, math.ceil(least_share * n1))) & (rate1 >= purity * (rate1 + rate0))).collect()
    docs = {r["start"]: (r["toxic"], r["clean"]) for r in rows}
    by_length = tuple(range(shortest, longest + 1))

    def held(batches):
        for b in batches:
            found = []
            for text in b["text"]:
                words = set(re.findall(r"[^\W\d_]+", text.decode("utf-8", "replace").lower()))
                found.append(sorted({w[:n] for w in words for n in by_length if w[:n] in docs}))
            yield {"starts": found}

    # the starts of at most per_class toxic texts; copies of one text count once
    texts = sample.filter("y = 1").select("text").distinct()
    open_texts = [set(r["starts"]) for r in in_arrow(texts, held, "starts array<string>").collect()]
    least = max(least_docs, math.ceil(least_share * len(open_texts)))
    chosen: dict[str, float] = {}
    while True:
        gain = Counter(s for t in open_texts for s in t)
        if not gain:
            break
        # the start that explains most texts not yet explained, less what it finds in clean texts; among equals the longest
        worth = {s: n - CLEAN_COST * docs[s][1] * n1 / n0 for s, n in gain.items() if n >= least}
        best = max(worth, key=lambda s: (worth[s], len(s), s), default=None)
        if best is None or worth[best] <= 0:
            break
        toxic, clean = docs[best]
        chosen[best] = math.log(((toxic + 0.5) / (n1 + 1)) / ((clean + 0.5) / (n0 + 1)))
        open_texts = [t for t in open_texts if best not in t]
    # words that always come with others explain no text alone; frequent and never clean, they count too
    floor = 0.25 * min((docs[s][0] for s in chosen), default=0)
    for s in sorted(docs, key=lambda s: (-docs[s][0], -len(s), s)):
        if chosen and docs[s][0] >= floor and not docs[s][1] and not any(s.startswith(c) or c.startswith(s) for c in chosen):
            chosen[s] = math.log(((docs[s][0] + 0.5) / (n1 + 1)) / (0.5 / (n0 + 1)))
    return {s: w for s, w in chosen.items() if not any(s[:n] in chosen for n in range(shortest, len(s)))}


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic weights (the last is the constant) by Newton steps with a small ridge; classes count alike."""
    if not len(y) or y.min() == y.max():
        return np.r_[np.zeros(x.shape[1]), -2.0 if not len(y) or y.max() == 0 else 2.0]
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), 1.0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)),
                               x.T @ (weight * (p - y)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Grammar:
    """The learnt insults and the curve, sent to the tasks with the code that applies them."""

    def __init__(self, insults: dict[str, float], weights: np.ndarray):
        self.insults, self.weights, self.finder = insults, weights, _finder(insults)

    def features(self, texts: list[bytes]) -> np.ndarray:
        return np.array([clause_features(t.decode("utf-8", "replace"), self.insults, self.finder) for t in texts], dtype=float).reshape(-1, 3)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights[:3] + self.weights[3], -700, 700)))


def learn_grammar(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, per_class: int = PER_CLASS,
                  id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Grammar:
    """Insults and curve from at most ``per_class`` labelled texts of each class, without those held out."""
    sample = store(labelled_sample(docs, labels, label, training_rows(modulus, held_out, id_col), per_class, id_col, text_col), "labelled")
    grammar = Grammar(learn_insults(sample), np.zeros(4))

    def run(batches):
        for b in batches:
            f = grammar.features(b["text"])
            yield {"y": b["y"], "f1": f[:, 0], "f2": f[:, 1], "f3": f[:, 2]}
    seen = in_arrow(sample.select("text", "y"), run, "y int, f1 double, f2 double, f3 double").collect()
    rows = np.array(sorted(tuple(r) for r in seen), dtype=float).reshape(-1, 4)
    return Grammar(grammar.insults, fit_curve(rows[:, 1:], rows[:, 0]))


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.3,
                   per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """Columns doc_id, held_out, score, predicted; one row per input row.

    The grammar and the curve are learnt from at most ``per_class`` labelled texts of each class whose
    crc32(id) mod ``modulus`` is not ``held_out``; every whole text is scored. Null and empty texts
    match no clause and get the score of a text without matches. A null id is scored and not held
    out. Without labels of both classes nothing can be learnt: only threats match then. Repeated
    rows keep one row each; extra columns are not read.
    """
    grammar = learn_grammar(docs, labels, modulus, held_out, per_class, id_col, text_col, label)

    def run(batches):
        for b in batches:
            yield {"id": b["id"], "score": grammar.scores(b["text"])}
    return with_verdict(in_arrow(key_and_bytes(docs, id_col, text_col), run, "id long, score double"), modulus, held_out, threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """Rows of ``docs`` that score below the threshold, all columns kept; nothing is shuffled but the sample."""
    grammar = learn_grammar(docs, labels, id_col=id_col, text_col=text_col, **learning)
    return keep_rows(docs, text_col, lambda texts: grammar.scores(texts) < threshold)


@query("op5_toxicity")
def op5(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
