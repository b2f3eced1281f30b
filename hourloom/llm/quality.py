"""Operator 1: quality classifier from weak labels.

Overlapping heuristic labellers vote good, junk or nothing on every text. Expectation-maximisation over the counts of
vote patterns, of all documents, estimates how each labeller votes on good and on junk texts and how common junk is; that gives
each pattern a posterior label. The labels of at most SAMPLE documents, chosen by a hash of doc_id, train a linear
scorer over hashed features (logistic loss; up to SHARDS models, trained on their own parts of the sample, PER_SHARD documents or more, and averaged). The
scorer judges all documents.

Cases: a null text or one without a word is rejected with score 0 and takes no part in training; a score of exactly one half is kept;
repeated rows count each and score alike; with fewer than two kinds of labels the scorer still trains and follows its bias; a very long
text is read whole by one task; an empty table gives an empty one; other columns stay, but for quality_score and quality_kept, which are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import materialise, slices, texts

SAMPLE, SHARDS, PER_SHARD, EPOCHS, DIMENSIONS, KEPT_WORDS, KEPT_NAMES = 20_000, 16, 1000, 4, 1 << 16, 200_000, 20_000
SYMBOLS = "#*$%&|<>@^~"
MEASURES = ("words", "symbols", "upper", "exclaims", "digits", "dup_lines", "tails", "stutter", "narrow")
#: labeller: measure, below which it votes good, above which it votes junk.
LABELLERS = {
    "symbols": (0.03, 0.15),
    "upper": (0.15, 0.40),
    "exclaims": (0.03, 0.20),
    "digits": (0.25, 0.60),
    "dup_lines": (0.10, 0.40),
    "tails": (0.03, 0.20),
    "stutter": (0.05, 0.25),
    "narrow": (0.50, 0.70),
}
ENDS = frozenset(SYMBOLS + "!")
#: Signs that end a word in ordinary prose.
SIGNS = frozenset(",.;:!?")


def measure(text: str) -> tuple[float, ...]:
    """MEASURES of a text: words; symbols, exclamation marks, words in capitals, words that end in either sign and words equal to the
    one before, per word; digits per character; lines equal to an earlier one, per line; and words in a block of 100 that
    the block has already, per word, as a mean over the blocks."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(MEASURES)
    count = text.count
    symbols, exclaims = sum(map(count, SYMBOLS)), count("!")
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    tails = sum(w[-1] in ENDS for w in words) if symbols or exclaims else 0
    narrow = n - sum(len(set(words[i : i + 100])) for i in range(0, n, 100))
    digits = sum(map(count, "0123456789")) / len(text)
    return (float(n), symbols / n, sum(map(str.isupper, words)) / n, exclaims / n, digits, 1 - len(set(lines)) / len(lines), tails / n, sum(map(eq, words, words[1:])) / n, narrow / n)


def votes(m: tuple[float, ...]) -> str:
    """A letter for each labeller: g, j or a dash."""
    if not m[0]:
        return "j" * len(LABELLERS)
    by = dict(zip(MEASURES, m))
    return "".join("g" if by[k] < good else "j" if by[k] > junk else "-" for k, (good, junk) in LABELLERS.items())


def estimate(patterns: dict[str, int], rounds: int = 50, strength: float = 0.01) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior probability of good for each pattern, the vote probabilities [labeller, class junk or good, vote] and the share of good.

    A prior worth strength of all documents says that votes are right four times in five and that labellers agree on the classes."""
    if not patterns:
        return {}, np.zeros((len(LABELLERS), 2, 3)), 0.5
    keys = list(patterns)
    weight = np.array([patterns[k] for k in keys], float)
    v = np.array([["j-g".index(c) for c in k] for k in keys])  # 0 junk, 1 nothing, 2 good
    seen = np.eye(3)[v]  # pattern, labeller, vote
    good = 1 / (1 + np.exp(-(1.0 * (v == 2).sum(1) - 4.0 * (v == 0).sum(1))))
    share = np.einsum("p,plv->lv", weight, seen) / weight.sum()
    prior = np.stack([share * [2.4, 1.0, 0.6], share * [0.6, 1.0, 2.4]], 1) + 1e-3
    prior /= prior.sum(2, keepdims=True)
    for _ in range(rounds):
        r = np.stack([1 - good, good], 1) * weight[:, None]
        mass = strength * weight.sum()
        p = (np.einsum("pc,plv->lcv", r, seen) + mass * prior) / (r.sum(0)[None, :, None] + mass)
        balance = (r[:, 1].sum() + 1) / (weight.sum() + 2)
        log = np.einsum("plv,lcv->pc", seen, np.log(p)) + np.log([1 - balance, balance])
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return dict(zip(keys, good.tolist())), p, float(balance)


class Features:
    """Hashed features: of each word its form, tail and lower case; of a text its measures in steps."""

    def __init__(self) -> None:
        self.kept: dict[str, tuple[int, int, int]] = {}
        self.slots: dict[str, int] = {}

    @staticmethod
    def slot(name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIMENSIONS

    def word(self, w: str) -> tuple[int, int, int]:
        signed = w[-1] in SIGNS
        body = w[:-1] if signed else w
        # Most words are letters, small but for the first one, with or without a sign after them.
        if body.isalpha() and body[1:].islower() and (body[0].isupper() or body[0].islower()):
            form = ("Xx" if body[0].isupper() else "x") + (w[-1] if signed else "")
        else:
            form = re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in w))
        return self.known(f"f:{form}"), self.known("t:" if w[-1].isalnum() else f"t:{w[-2:]}"), self.slot(f"w:{w.lower()}")

    def known(self, name: str) -> int:
        """The slot of a name that comes again and again."""
        if name not in self.slots:
            if len(self.slots) > KEPT_NAMES:
                self.slots = {}
            self.slots[name] = self.slot(name)
        return self.slots[name]

    def words(self, many: set[str]) -> dict[str, tuple[int, int, int]]:
        if len(self.kept) > KEPT_WORDS:
            self.kept = {}
        for w in many.difference(self.kept):
            self.kept[w] = self.word(w)
        return self.kept

    def text(self, m: tuple[float, ...]) -> list[int]:
        return [self.slot(f"m:{k}:{min(int(x * 20), 20)}") for k, x in zip(MEASURES[1:], m[1:])]

    def sparse(self, text: str, m: tuple[float, ...]) -> tuple[list[int], list[float]]:
        """Slots and values: word features weigh their share of the words, measures 1 / 4."""
        words = Counter(text.split())
        known = self.words(set(words))
        n = sum(words.values())
        out: Counter = Counter()
        for w, c in words.items():
            for s in known[w]:
                out[s] += c / n
        for s in self.text(m):
            out[s] += 0.25
        return list(out), [float(x) for x in out.values()]


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and votes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            each = [measure(t) for t in texts(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array([int(m[0]) for m in each], pa.int64()), pa.array([votes(m) for m in each], pa.string())], names=["doc_id", "n_words", "votes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, votes string")


def train_part(rows: pd.DataFrame, epochs: int = EPOCHS) -> np.ndarray:
    """Weights and, last, the bias from one part of the sample, by stochastic gradients in order of doc_id."""
    w = np.zeros(DIMENSIONS + 1)
    each = [(np.array([*s, DIMENSIONS]), np.array([*v, 1.0]), y) for s, v, y in zip(rows["slots"], rows["values"], rows["good"])]
    step = 0
    for _ in range(epochs):
        for s, v, y in each:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[s] @ v)))))
            w[s] -= 4.0 / (1 + step / 2000) * (p - y) * v
            step += 1
    return w


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, float]]:
    """The scorer's weights and the posterior of each vote pattern."""
    spark = docs.sparkSession
    marked = materialise(labelled(docs), "votes")
    patterns = {r["votes"]: r["n"] for r in marked.filter("n_words > 0").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 3 ** labellers rows
    good, _, _ = estimate(patterns)
    total = sum(patterns.values())
    share = min(1.0, sample / max(total, 1))
    parts = max(1, min(SHARDS, min(total, sample) // PER_SHARD))
    held = spark.sparkContext.broadcast(good)
    unit = F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    chosen = docs.select("doc_id", "text").filter(unit < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in slices(batches):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                m = measure(t)
                if m[0]:
                    rows.append((i, *f.sparse(t, m), held.value[votes(m)], int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)))
            yield pa.record_batch([pa.array([r[0] for r in rows], b.column(0).type), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.int64())], names=["doc_id", "slots", "values", "good", "own"])

    features = chosen.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, slots array<int>, values array<double>, good double, own long")  # own: of the text, an order for rows with one doc_id
    features = features.withColumn("part", F.pmod(F.xxhash64(F.lit(2), F.col("doc_id")), F.lit(parts)))

    def fit(key: tuple[int, ...], rows: pd.DataFrame) -> pd.DataFrame:
        w = train_part(rows.sort_values(["doc_id", "own"], kind="stable"))
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at, "w": w[at], "part": key[0]})

    fitted = features.groupBy("part").applyInPandas(fit, "slot long, w double, part long")  # the sample is bounded
    found = materialise(fitted, "weights")
    n = max(1, found.select("part").distinct().count())
    weights = np.zeros(DIMENSIONS + 1)
    for r in found.groupBy("slot").agg((F.sum("w") / n).alias("w")).collect():  # at most DIMENSIONS + 1 rows
        weights[r["slot"]] = r["w"]
    return weights, good


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with quality_score (0 to 1) and quality_kept."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("quality_score", "quality_kept")])
    held = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, w = Features(), held.value.tolist()  # Python's numbers add up faster one by one
        of: dict[str, float] = {}
        for b in slices(batches):
            out = []
            for t in texts(b.column(at)):
                words = t.split()
                if not words:
                    out.append(0.0)
                    continue
                if len(of) > KEPT_WORDS:
                    of = {}
                for x in set(words).difference(of):
                    i, j, k = f.word(x)
                    of[x] = w[i] + w[j] + w[k]
                z = w[DIMENSIONS] + math.fsum(map(of.__getitem__, words)) / len(words) + 0.25 * sum(w[s] for s in f.text(measure(t)))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            s = np.array(out)
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64()), pa.array(s >= 0.5, pa.bool_())], names=[*b.schema.names, "quality_score", "quality_kept"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, quality_score double, quality_kept boolean")


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    weights, _ = train(docs, sample)
    return score(docs, weights)


def query(docs: DataFrame) -> DataFrame:
    return classify(docs).select("doc_id", F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))
