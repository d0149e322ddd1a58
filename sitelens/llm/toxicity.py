"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. A bounded sample of labelled rows (FIT_ROWS, by hash of ``doc_id``) is turned
   into sets of signs: words, beginnings of words, and patterns of writing. Spark
   counts the signs by label; the MOST_SIGNS with the strongest association are
   the features of the classifier, and those that speak for toxicity, the seed
   lexicon and the patterns are the voters.
2. The label model is a mixture of two classes. A voter that does not fire
   abstains; that no word voter fires is a voter for the other class. For each
   voter the model estimates how often it fires in either class, and from what the classes leave unexplained
   how voters depend on each other; dependent voters share one voice. It gives a
   posterior label to each sampled row. The labels of the sample anchor its estimates.
3. A logistic regression learns the posteriors from all features, and is then
   calibrated on the labels (two numbers).

Everything learned has a fixed size. Scoring is one pass over whole texts,
without a shuffle. Null ids and null labels are not learned from; of several
labels of one document the highest counts.

Defined results: a null, empty or wordless text is scored by its lack of signs;
without labels the seed lexicon alone decides; rows are scored one by one, so
repeated rows stay; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.session import written

FIT_ROWS = 12_000
MOST_SIGNS, MOST_VOTERS = 4096, 300
LEAST_ROWS_OF_A_SIGN = 4
REJECT_FROM = 0.3
STEMS = (4, 5, 7)  # lengths of word beginnings, written with a closing star
SEEDS = ("idiot", "stupid", "moron", "loser", "pathetic", "worthless", "scum", "trash", "disgusting", "dumbass",
         "idiotisch", "dummkopf", "abschaum", "imbécile", "ordure", "idiota", "imbécil", "basura")
PATTERNS = {
    "#shouting": re.compile(r"(?:\b[^\W\d_a-z]{3,}\b\W+){4}"),
    "#exclaiming": re.compile(r"!{3,}"),
    "#asking": re.compile(r"\?{3,}"),
    "#addressing": re.compile(r"\b(?:you|du|tu|vous|usted)\b\W+(?:are|bist|es|êtes)\b", re.IGNORECASE),
}
WORD = re.compile(r"[^\W\d_]+")
UNSEEN_LOGIT = -4.0


def signs(text: str | None) -> set[str]:
    """Words, word beginnings (with one star, and with two where they occur at least twice), patterns."""
    text = text or ""
    words = Counter(WORD.findall(text.lower()))
    stems: dict[str, int] = {}
    for w, times in words.items():
        for n in STEMS:
            if len(w) >= n:
                stem = w[:n]
                stems[stem] = stems.get(stem, 0) + times
    out = set(words)
    out.update([f"{stem}*" for stem in stems])
    out.update([f"{stem}**" for stem, times in stems.items() if times > 1])
    out.update([name for name, pattern in PATTERNS.items() if pattern.search(text)])
    return out


class LabelModel:
    """Two classes of rows with independent voters, whose voices are thinned by their dependence."""

    def __init__(self, votes: np.ndarray, prior: float, anchor: np.ndarray, rounds: int = 20):
        """``anchor`` is the first guess of the shares and keeps half of the say in every round."""
        self.prior = prior
        self.voice = np.ones(votes.shape[1])
        share = np.clip(anchor, 0.02, 0.98)
        for turn in range(2 * rounds):
            self.estimate(votes, share)
            share = (self.posterior(votes) + anchor) / 2
            if turn == rounds:
                self.voice = 1 / (1 + self.dependence(votes, share))

    def estimate(self, votes: np.ndarray, share: np.ndarray) -> None:
        """How often each voter fires in the toxic and in the other class."""
        fire = lambda w: (w @ votes + 0.1) / (w.sum() + 1.0)
        self.toxic, self.clean = fire(share), fire(1 - share)

    def dependence(self, votes: np.ndarray, share: np.ndarray) -> np.ndarray:
        """For each voter the sum of its correlations with others inside the classes."""
        left = votes - share[:, None] * self.toxic - (1 - share[:, None]) * self.clean
        cov = left.T @ left / len(left)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(scale, scale), 0, 1)
        corr[corr < 0.15] = 0  # what chance brings about among many voters
        return corr.sum(1) - np.diag(corr)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logit = np.log(self.prior / (1 - self.prior)) + votes @ (self.voice * np.log(self.toxic / self.clean))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def votes_of(features: list[np.ndarray], width: int, voters: list[int]) -> np.ndarray:
    """1 where a row (given as the list of its features) has the voter's feature; only the voters get columns."""
    flat = np.concatenate(features)
    owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
    place = np.full(width, -1)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((len(features), len(voters)), order="F")  # by columns: sums of another order round differently
    speaks = place[flat] >= 0
    votes[owner[speaks], place[flat[speaks]]] = 1
    return votes


def logistic(features: list[np.ndarray], width: int, target: np.ndarray, strength: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of rows given as lists of their features, by gradient steps with momentum (Adam)."""
    flat = np.concatenate(features) if len(features) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = UNSEEN_LOGIT
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(owner, w[flat], len(features)) + w[-1])))
        error = p - target
        g = np.append(np.bincount(flat, error[owner], width), error.sum()) / max(len(features), 1)
        g[:-1] += strength * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


class Model:
    """Weight of each sign, bias, and the calibration of the sum."""

    def __init__(self, weights: dict[str, float], bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def logit(self, found: set[str]) -> float:
        return self.bias + sum(map(self.weights.get, found & self.weights.keys()))

    def score(self, text: str | None) -> float:
        x = self.slope * self.logit(signs(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, learn_from: Column) -> DataFrame:
    """(doc_id, toxic, signs) of at most FIT_ROWS labelled rows."""
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        learn_from & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)

    @F.pandas_udf("array<string>")
    def sign_lists(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(signs(t)))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # FIT_ROWS rows of two numbers: a proven bound
    return written(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", sign_lists("text").alias("signs")), "signs")


def associated(rows: DataFrame) -> pd.DataFrame:
    """The signs with the strongest association with either label, strongest first."""
    totals = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, n = totals["t"] or 0, totals["n"]
    a, b = F.col("a"), F.col("n") - F.col("a")
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (n - toxic + 1))
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / share)).otherwise(0.0)
    p = toxic / max(n, 1)  # twice the log-likelihood ratio against independence
    gain = 2 * (part(a, F.col("n") * p) + part(b, F.col("n") * (1 - p))
                + part(toxic - a, (n - F.col("n")) * p) + part(n - toxic - b, (n - F.col("n")) * (1 - p)))
    counted = rows.select("toxic", F.explode("signs").alias("sign")).groupBy("sign").agg(
        F.sum("toxic").alias("a"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_ROWS_OF_A_SIGN)
    rated = counted.select("sign", odds.alias("odds"), gain.alias("gain"))
    return rated.orderBy(F.desc("gain"), "sign").limit(MOST_SIGNS).toPandas()


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column) -> Model:
    rows = sample(docs, labels, learn_from)
    known = associated(rows)
    seeds = Model(dict.fromkeys(SEEDS, 3.0), UNSEEN_LOGIT)
    if known.empty:
        return seeds
    names = list(dict.fromkeys([*known["sign"], *SEEDS, *PATTERNS]))
    number = {s: i for i, s in enumerate(names)}
    held = docs.sparkSession.sparkContext.broadcast(number)

    @F.pandas_udf("array<int>")
    def numbers(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: [held.value[s] for s in x if s in held.value])

    drawn = rows.select("doc_id", "toxic", numbers("signs").alias("f")).toPandas().sort_values("doc_id")
    features, toxic = [np.array(f, np.int64) for f in drawn["f"]], drawn["toxic"].to_numpy(float)
    speaking = known[(known["odds"] > 1.5) & (known["gain"] > 20)]["sign"].head(MOST_VOTERS)
    voters = [number[s] for s in dict.fromkeys([*speaking, *SEEDS, *PATTERNS])]
    prior = float(np.clip(toxic.mean(), 0.005, 0.5))
    cast = votes_of(features, len(names), voters)
    cast = np.column_stack([cast, cast[:, :len(voters) - len(PATTERNS)].max(1) == 0])
    posterior = LabelModel(cast, prior, toxic).posterior(cast)
    del cast
    weights, bias = logistic(features, len(names), posterior, strength=2e-4, rounds=300)
    logits = np.array([bias + weights[f].sum() for f in features])
    (slope,), shift = platt(logits, toxic)
    return Model({s: float(w) for s, w in zip(names, weights, strict=True) if abs(w) > 1e-3}, bias, slope, shift)


def platt(logits: np.ndarray, toxic: np.ndarray) -> tuple[tuple[float], float]:
    """Slope (at least a small positive one) and shift that fit the labels best, by Newton steps."""
    x = np.stack([np.clip(logits, -15, 15), np.ones(len(logits))], 1)
    w = np.array([1.0, 0.0])
    target = (toxic * (toxic.sum() + 1) / (toxic.sum() + 2)) + (1 - toxic) / ((1 - toxic).sum() + 2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (w - [1, 0])), -1, 1)
    return (max(float(w[0]), 0.05),), float(w[1])


def score_column(docs: DataFrame, model: Model, text: Column) -> Column:
    """The score of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return texts.map(held.value.score)

    return scores(F.coalesce(text.cast("string"), F.lit("")))
