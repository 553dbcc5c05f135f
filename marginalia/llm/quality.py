"""Quality classifier: Naive Bayes support vectors.

A text is the set of its n-grams: words and word pairs, and runs of one to three word shapes that note whether a
word repeats the one before. Indicators are scaled by the class log-count ratio of their n-gram, and a linear
hinge-loss model is fitted to them by dual coordinate descent. Margins become scores by a sigmoid fitted to texts
that the model hasn't seen.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, GOLD, MIX_A, cut, distinct_sorted, drop, keeps, mix, release, text_pieces, task

GROUP_ROWS = 6000  # labelled rows that one model is fitted to, about; more rows make more groups, and the model is the mean of theirs
LEAST_OF_CLASS = 1500  # rows of each class in a group, about; those of a rarer class are in several groups
LEAST_TEXTS = 3  # of a group that an n-gram of its model is in
SMOOTHING, COST, EPOCHS = 1.0, 0.05, 12

_runs = regex.compile(r"(?P<title>\p{Lu}(?:\p{Ll}|\p{M})+)|(?P<upper>\p{Lu}+)|(?P<lower>\p{L}+)|(?P<digits>\p{N}+)").sub
_shape_of = {"title": "Xx", "upper": "X", "lower": "x", "digits": "9"}


def shape(word: str) -> str:
    """A word with its runs of letters and digits as classes: Haus -> Xx, THE!! -> X!!."""
    return _runs(lambda m: _shape_of[m.lastgroup], word)


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Hashes(dict):
    def __init__(self, of):
        super().__init__()
        self.make = of

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS // 4:
            self.clear()
        value = self[word] = _hash(self.make(word))
        return value


_words, _shapes = keeps("quality", _Hashes(str.lower)), keeps("quality", _Hashes(shape))


def features(text: str | None) -> np.ndarray:
    """The hashes of a text's n-grams, with repeats."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    s = np.fromiter(map(_shapes.__getitem__, words), np.uint64, n) | np.uint64(1)
    s[1:] -= (w[1:] == w[:-1]).astype(np.uint64)
    s2 = s[:-1] * GOLD + s[1:]
    return np.concatenate([w, mix(w[:-1] * GOLD + w[1:]), mix(s + MIX_A), mix(s2 * MIX_A), mix((s2[:-1] + np.uint64(7)) * GOLD + s[2:])])


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.keys, self.weights, self.bias, self.slope, self.shift = keys, weights, bias, slope, shift

    def margin(self, text: str | None) -> float:
        found = distinct_sorted(features(text))
        if not len(found) or not len(self.keys):
            return self.bias
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return float(self.weights[at[self.keys[at] == found]].sum()) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.shift, -30, 30))))


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights of the hinge-loss model by dual coordinate descent; rows hold column numbers, the last column is the bias."""
    w, alpha = np.zeros(len(scale)), np.zeros(len(rows))
    square = np.array([(scale[r] ** 2).sum() for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if square[i] == 0:
                continue
            r = rows[i]
            gradient = y[i] * (w[r] @ scale[r]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * y[i] * scale[r]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * cost:
            break
    return w


def fit(sets: list[np.ndarray], labels: np.ndarray) -> Model:
    """sets: distinct feature hashes of each text; labels: 0 or 1."""
    y = np.where(labels == 1, 1.0, -1.0)
    if not len(sets) or (y == y[0]).all():
        return Model(np.empty(0, np.uint64), np.empty(0), 0.0 if not len(sets) else float(y[0]))

    def train(which):
        every = np.sort(np.concatenate([sets[i] for i in which] or [np.empty(0, np.uint64)]))
        keys = distinct_sorted(every[LEAST_TEXTS - 1 :][every[LEAST_TEXTS - 1 :] == every[: max(0, len(every) - LEAST_TEXTS + 1)]])
        rows, good, bad = [], np.full(len(keys), SMOOTHING), np.full(len(keys), SMOOTHING)
        for i in which:
            at = np.minimum(np.searchsorted(keys, sets[i]), max(0, len(keys) - 1))
            at = at[keys[at] == sets[i]] if len(keys) else at[:0]
            (good if y[i] > 0 else bad)[at] += 1
            rows.append(np.append(at, len(keys)))
        ratio = np.append(np.log(good / good.sum()) - np.log(bad / bad.sum()), 1.0)
        w = descend(rows, ratio, y[which]) * ratio
        return Model(keys, w[:-1], float(w[-1]))

    def margins(model, which):
        out = []
        for i in which:
            at = np.minimum(np.searchsorted(model.keys, sets[i]), max(0, len(model.keys) - 1))
            out.append(model.weights[at[model.keys[at] == sets[i]]].sum() + model.bias if len(model.keys) else model.bias)
        return np.array(out)

    part = np.arange(len(sets)) % 5 == 4
    seen, unseen = np.flatnonzero(~part), np.flatnonzero(part)
    model = train(np.arange(len(sets)))
    if len(unseen) and len(set(y[seen])) == 2:
        m = margins(train(seen), unseen)
        a, b, t = 1.0, 0.0, (y[unseen] > 0) * 0.98 + 0.01
        for _ in range(200):  # gradient steps of logistic regression on one variable
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            a, b = max(0.05, a - ((p - t) * m).mean() * 0.3), b - (p - t).mean() * 0.3
        model.slope, model.shift = float(a), float(b)
    return model


def _fitted(rows: pa.Table) -> pa.Table:
    """The calibrated weights of the model of one group (doc_id, text, label), and its bias in a row without a key."""
    ids, labels, sets = rows.column("doc_id").to_pylist(), rows.column("label").to_pylist(), []
    try:
        for batch in rows.select(["text"]).to_batches():
            for _, texts in text_pieces(batch):
                sets += [distinct_sorted(features(t)) for t in texts]
        order = sorted(range(len(ids)), key=lambda i: (hashlib.blake2b(str(ids[i]).encode()).digest(), labels[i]))
        m = fit([sets[i] for i in order], np.array([labels[i] for i in order], np.int64))
    finally:
        release("quality")
    keys = pa.array(np.append(m.keys.view(np.int64), 0), mask=np.arange(len(m.keys) + 1) == len(m.keys))
    return pa.table({"key": keys, "weight": np.append(m.weights * m.slope, m.bias * m.slope + m.shift)})


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the texts of docs (doc_id, text) and all rows (doc_id, label) of labels with label 0 or 1.

    Rows are dealt by a hash of their ids into groups of about GROUP_ROWS; those of a class that would have fewer than
    LEAST_OF_CLASS in a group are in several. Each group has its model, and the result is the mean of their calibrated
    margins, over the n-grams that half of them know: as in one group, those of a small share of the texts or more,
    so that the model doesn't grow with the rows. An id that is labelled twice counts with its lower label. Without
    labelled texts all scores are 0.5.
    """
    rows = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min(F.col("label").cast("int")).alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    groups = -(-sum(counts.values()) // GROUP_ROWS)
    if not groups:
        return Model(np.empty(0, np.uint64), np.empty(0), 0.0)
    times = {k: min(groups, -(-LEAST_OF_CLASS * groups // n)) for k, n in counts.items()}
    home, copies = F.pmod(F.xxhash64("doc_id"), F.lit(groups)), F.when(F.col("label") == 1, times.get(1, 1)).otherwise(times.get(0, 1))
    texts = docs.select("doc_id", "text").join(rows.hint("merge"), "doc_id")  # labels may be of any number
    dealt = texts.withColumn("group", F.explode(F.transform(F.sequence(F.lit(0), copies - 1), lambda k: F.pmod(home + k, F.lit(groups)))))
    models = dealt.repartition(4 * groups, "group").groupBy("group").applyInArrow(lambda rows: _fitted(rows), "key long, weight double")
    sums = cut(models.groupBy("key").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")))
    bias = sums.where("key is null").first()
    if bias is None:
        return Model(np.empty(0, np.uint64), np.empty(0), 0.0)
    known = sums.where(f"key is not null and 2 * n >= {bias['n']}").select("key", "weight").toArrow()
    drop(sums)
    keys, weights = known.column("key").to_numpy().view(np.uint64), known.column("weight").to_numpy()
    order = np.argsort(keys)
    return Model(keys[order], (weights[order] / bias["n"]).astype(np.float32), bias["weight"] / bias["n"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: better), predicted of every row.

    A null or empty text has no n-grams and gets the score of the model's bias. Repeated and null ids come back as
    they are; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @task("quality")
    def run(batches):
        m = shared.value
        for batch in batches:
            for piece, texts in text_pieces(batch):
                s = [m.score(t) for t in texts]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
