"""Operator 10: language of texts by interpolated Kneser-Ney character models.

Texts are cut at white space; letters in lower case count, everything else is a border. A model of order 4 predicts each letter and
the border after it from three characters before it, borders among them (three stand before each piece). Single characters are counted by code point,
longer n-grams by a 64-bit hash, and counts cover every learned text, so the model grows with it. The highest order uses counts, lower
ones the number of different characters seen before; absolute discounts come from the counts of counts. Spark makes all of it, order by
order, from groups and joins of (language, n-gram).

Where the tables hold HELD entries or fewer in all, the driver puts them together and every task has them: per order sorted arrays of
hashes with the languages and log probabilities that each has, and the same of contexts with their back-off weights; HELD entries take 180 MB.
Larger tables stay in Spark: n-grams of the texts, each once, are joined with them order by order, and the sums go back to the texts by
joins. Logarithms are whole numbers of 2 ** -32 from the tables on, so sums are exact in any order and both ways give the same rates, languages and ties.

A text's language has the lowest cross-entropy per character. The score is the posterior of a flat prior, with at most
TRUST characters counting. One learned document in FOLD takes no part in the counts; these documents, which the model hasn't seen, say how
far the cross-entropy of real texts of a language strays from its mean, with the root of the text's characters (TRUST at most). rejected says that
a text strays more than REJECT times as far. A language without such documents rejects nothing.

Cases: a null text or one without a letter is und with score 0, and so is every text if nothing could be learned; null langs
are not learned from; a null doc_id counts as empty for the fold; ties go to the first language in order; repeated rows
count each; a very long text is scored whole, once per different word; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import materialise, slices, texts, unused

ORDER, POINTS = 4, 0x110000
KEPT, TRUST, REJECT, FOLD, BORDER = 200_000, 40, 5.0, 16, 32
#: Most entries (n-grams and contexts of all languages) that are broadcast.
HELD = 8 << 20
#: Probabilities of n-grams in languages that a task holds at once.
CELLS = 4 << 20
#: Parts of one nat, and the logarithm of the uniform distribution in them.
UNIT = 1 << 32
UNIFORM = round(math.log(1.0 / POINTS) * UNIT)

_lower: list[np.ndarray] = []


def lower() -> np.ndarray:
    """For each code point the letter in lower case, or BORDER."""
    if not _lower:
        table = np.full(0x110000, BORDER, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()) if len(c.lower()) == 1 else i
        _lower.append(table)
    return _lower[0]


def grams(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of the scored characters of words: hashes of the n-grams of 1 to ORDER characters that end there, hashes of their contexts
    of 0 to ORDER - 1 characters, and each character's word."""
    gap = " " * (ORDER - 1)
    raw = np.frombuffer((gap + gap.join(words) + gap).encode("utf-32-le", "surrogatepass"), "<u4")
    c = lower()[raw]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = ORDER - 1 + np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    at = np.flatnonzero((c != BORDER) | (np.r_[np.uint32(BORDER), c[:-1]] != BORDER))
    word = np.searchsorted(starts, at, "right") - 1
    c = c.astype(np.uint64)
    full, context = [c[at].astype(np.int64)], [np.zeros(len(at), np.int64)]
    h, g = mix(np.zeros(len(at), np.uint64), c[at]), np.zeros(len(at), np.uint64)
    for k in range(1, ORDER):
        h, g = mix(h, c[at - k]), mix(g, c[at - k])
        full.append(h.view(np.int64))
        context.append(g.view(np.int64))
    return full, context, word


def mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = (h ^ (c + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


KEYS = ["g4", "g3", "g2", "g1", "x3", "x2", "x1", "x0"]


def distinct_grams(words: Counter) -> list[np.ndarray]:
    """The KEYS of each different n-gram of order 4 in counted words, and its count."""
    full, context, word = grams(list(words))
    w = np.fromiter(words.values(), np.int64, len(words))[word]
    at, index, inverse = np.unique(full[-1], return_index=True, return_inverse=True)
    return [at, *(x[index] for x in (*full[-2::-1], *context[::-1])), np.bincount(inverse, w, len(at)).astype(np.int64)]


def counts(docs: DataFrame) -> DataFrame:
    """By language and n-gram of order 4: its endings, contexts and count."""

    def rows(lang: str, words: Counter) -> pa.RecordBatch:
        found = distinct_grams(words)
        return pa.record_batch([pa.array([lang] * len(found[0]), pa.string()), *map(pa.array, found)], names=["lang", *KEYS, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                held.setdefault(lang, Counter()).update(text.split())
            for lang, words in held.items():
                if len(words) > KEPT:
                    yield rows(lang, words)
                    held[lang] = Counter()
        for lang, words in held.items():
            if words:
                yield rows(lang, words)

    raw = docs.filter(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(run, "lang string, " + ", ".join(f"{c} long" for c in [*KEYS, "n"]))
    return raw.groupBy("lang", "g4").agg(*[F.min(c).alias(c) for c in KEYS[1:]], F.sum("n").alias("n"))


@dataclass
class Tables:
    """For each order from 1: lang, slot (the hash), p and log (of p, in UNITs) of every n-gram that a language has, and the same of every context and its weight."""

    langs: list[str]
    grams: list[DataFrame]
    contexts: list[DataFrame]

    def entries(self) -> int:
        return sum(t.count() for t in [*self.grams, *self.contexts])


def train(docs: DataFrame) -> Tables:
    top = materialise(counts(docs), "grams")
    types = {ORDER: top.withColumnRenamed("n", "c")}
    for k in range(ORDER - 1, 0, -1):  # an n-gram of a lower order counts the longer ones that end in it
        rest = [x for x in KEYS if int(x[1]) < k]
        types[k] = materialise(types[k + 1].groupBy("lang", f"g{k}").agg(*[F.min(x).alias(x) for x in rest], F.count(F.lit(1)).alias("c")), "grams")
    found, contexts, below = [], [], None
    for k in range(1, ORDER + 1):
        t = types[k].select("lang", F.col(f"g{k}").alias("slot"), F.col(f"x{k - 1}").alias("x"), "c", *([F.col(f"g{k - 1}").alias("lesser")] if k > 1 else []))
        n1, n2 = (F.count_if(F.col("c") == i) for i in (1, 2))
        d = t.groupBy("lang").agg(F.least(F.greatest(n1 / F.greatest(n1 + 2 * n2, F.lit(1)), F.lit(0.1)), F.lit(0.9)).alias("d"))
        sums = t.groupBy("lang", "x").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        context = materialise(sums.join(d, "lang").select("lang", "x", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight")), "contexts")
        both = t.join(context, ["lang", "x"])
        both = both.withColumn("q", F.lit(1.0 / POINTS)) if below is None else both.join(below.select("lang", F.col("slot").alias("lesser"), F.col("p").alias("q")), ["lang", "lesser"])
        below = materialise(both.select("lang", "slot", ((F.col("c") - F.col("d")) / F.col("total") + F.col("weight") * F.col("q")).alias("p")), "probabilities")
        log = F.round(F.log("p") * UNIT).cast("bigint").alias("log")
        found.append(below.select("*", log))
        contexts.append(context.select("lang", F.col("x").alias("slot"), F.col("weight").alias("p")).select("*", log))
    return Tables(sorted(r["lang"] for r in found[0].select("lang").distinct().collect()), found, contexts)


@dataclass
class Entries:
    """Of an order: sorted slots, where each one's entries start, and the entries' languages and values."""

    slots: np.ndarray
    starts: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(table: DataFrame, langs: list[str]) -> Entries:
        """From lang, slot and log, HELD rows at most."""
        t = table.select("lang", "slot", "log").toArrow()
        code = pa.array(range(len(langs)), pa.int32()).take(pa.compute.index_in(t.column("lang"), pa.array(langs, pa.string())).combine_chunks()).to_numpy().astype(np.uint16)
        slot, value = t.column("slot").to_numpy(), t.column("log").to_numpy()
        order = np.lexsort((code, slot))
        slots, starts = np.unique(slot[order], return_index=True)
        return Entries(slots, np.r_[starts, len(slot)].astype(np.uint32), code[order], value[order])

    def find(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of slots, language and value of every entry that they have."""
        at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
        rows = np.flatnonzero(self.slots[at] == slots)
        first = self.starts[at[rows]].astype(np.int64)
        n = self.starts[at[rows] + 1].astype(np.int64) - first
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(rows, n), self.lang[entry], self.value[entry]


@dataclass
class Model:
    langs: list[str]
    grams: list[Entries]
    contexts: list[Entries]

    @staticmethod
    def of(t: Tables) -> Model | None:
        return Model(t.langs, [Entries.of(x, t.langs) for x in t.grams], [Entries.of(x, t.langs) for x in t.contexts]) if t.langs else None

    def logs(self, full: list[np.ndarray], context: list[np.ndarray]) -> np.ndarray:
        """Of each n-gram in each language: from the uniform distribution up, a context's weight scales what its shorter one gives, and n-grams that a language has hold their own."""
        log = np.full((len(full[0]), len(self.langs)), UNIFORM, np.int64)
        for k in range(ORDER):
            row, lang, value = self.contexts[k].find(context[k])
            log[row, lang] += value
            row, lang, value = self.grams[k].find(full[k])
            log[row, lang] = value
        return log

    def units(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word in each language, in UNITs, and its scored characters."""
        full, context, word = grams(words)
        _, index, inverse = np.unique(full[-1], return_index=True, return_inverse=True)
        log = np.empty((len(index), len(self.langs)), np.int64)
        step = max(1, CELLS // max(1, len(self.langs)))
        for i in range(0, len(index), step):
            own = index[i : i + step]
            log[i : i + step] = self.logs([x[own] for x in full], [x[own] for x in context])
        n = np.bincount(word, minlength=len(words))
        sums = np.zeros((len(words), len(self.langs)), np.int64)
        some = np.flatnonzero(n)
        if len(some):
            sums[some] = np.add.reduceat(log[inverse], (np.cumsum(n) - n)[some], 0)  # characters come word by word
        return sums, n

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same in nats."""
        sums, n = self.units(words)
        return sums / UNIT, n


ADDED = ("lang_pred", "score", "entropy", "n_scored")


def classify(docs: DataFrame, tables: Tables) -> DataFrame:
    """docs with lang_pred, score, entropy (nats a character) and n_scored; only text is used."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    return by_arrays(docs, Model.of(tables)) if tables.entries() <= HELD else by_joins(docs, tables)


def by_arrays(docs: DataFrame, model: Model | None) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by HELD
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = held.value
        for b in slices(batches, 4 << 20):
            each = [x.split() for x in texts(b.column(at))]
            langs, scores, entropies = ["und"] * len(each), np.zeros(len(each)), np.full(len(each), np.nan)
            n = np.zeros(len(each), np.int64)
            number: dict[str, int] = {}
            flat = np.fromiter((number.setdefault(w, len(number)) for x in each for w in x), np.int64)
            if m and len(flat):
                sums, chars = m.units(list(number))
                sizes = np.array([len(x) for x in each])
                some, starts = np.flatnonzero(sizes), (np.cumsum(sizes) - sizes)[sizes > 0]
                n[some] = np.add.reduceat(chars[flat], starts)
                total = np.zeros((len(each), len(m.langs)), np.int64)
                for j in range(len(m.langs)):
                    total[some, j] = np.add.reduceat(sums[flat, j], starts)
                ok = n > 0
                rate = total[ok] / n[ok, None] / UNIT
                best = rate.argmax(1)
                near = np.exp((rate - rate.max(1, keepdims=True)) * np.minimum(n[ok], TRUST)[:, None])
                scores[ok], entropies[ok] = 1 / near.sum(1), -rate.max(1)
                for i, j in zip(np.flatnonzero(ok).tolist(), best.tolist()):
                    langs[i] = m.langs[j]
            yield pa.record_batch([*b.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(entropies, from_pandas=True), pa.array(n)], names=[*b.schema.names, *ADDED])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double, entropy double, n_scored long")


def by_joins(docs: DataFrame, tables: Tables) -> DataFrame:
    (rid,) = unused(docs.columns, "rid")
    docs = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4 << 20):
            for row, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                if words := Counter(text.split()):
                    found = distinct_grams(words)
                    yield pa.record_batch([pa.array(np.full(len(found[0]), row)), *map(pa.array, found)], names=["row", *KEYS, "n"])

    own = materialise(docs.select(rid, "text").mapInArrow(run, ", ".join(f"{c} long" for c in ["row", *KEYS, "n"])), "text-grams")
    kinds = {ORDER: materialise(own.select(KEYS).groupBy("g4").agg(*[F.min(c).alias(c) for c in KEYS[1:]]), "gram-kinds")}
    for k in range(ORDER - 1, 0, -1):
        kinds[k] = kinds[k + 1].groupBy(f"g{k}").agg(*[F.min(c).alias(c) for c in KEYS if int(c[1]) < k])
    langs, below = F.array(*map(F.lit, tables.langs)), None
    for k in range(1, ORDER + 1):  # what an order's own entries don't give comes from the order below, by the context's weight
        t = kinds[k].select(F.explode(langs).alias("lang"), F.col(f"g{k}").alias("g"), F.col(f"x{k - 1}").alias("x"), *([F.col(f"g{k - 1}").alias("lesser")] if k > 1 else []))
        t = t.join(tables.contexts[k - 1].select("lang", F.col("slot").alias("x"), F.col("log").alias("weight")), ["lang", "x"], "left")
        t = t.join(tables.grams[k - 1].select("lang", F.col("slot").alias("g"), "log"), ["lang", "g"], "left")
        t = t.withColumn("q", F.lit(UNIFORM)) if below is None else t.join(below.select("lang", F.col("g").alias("lesser"), F.col("log").alias("q")), ["lang", "lesser"])
        below = materialise(t.select("lang", "g", F.coalesce("log", F.coalesce("weight", F.lit(0)) + F.col("q")).alias("log")), "gram-scores")
    total = F.sum(F.col("n") * F.col("log")).cast("double")
    each = own.select("row", F.col("g4").alias("g"), "n").join(below, "g").groupBy("row", "lang").agg((total / F.sum("n") / F.lit(float(UNIT))).alias("rate"), F.sum("n").alias("n"))
    # A row per language; negative rates, so that the least is the best and the first in order wins a tie.
    rates = each.groupBy("row").agg(F.collect_list(F.struct((-F.col("rate")).alias("loss"), "lang")).alias("rates"), F.max("n").alias("n_scored"))
    best, trust = F.array_min("rates"), F.least("n_scored", F.lit(TRUST))
    near = F.aggregate("rates", F.lit(0.0), lambda s, x: s + F.exp((best["loss"] - x["loss"]) * trust))
    found = rates.select(F.col("row").alias(rid), best["lang"].alias("lang_pred"), (1 / near).alias("score"), best["loss"].alias("entropy"), "n_scored")
    instead = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "n_scored": F.lit(0)}
    return docs.join(found, rid, "left").withColumns({c: F.coalesce(c, v) for c, v in instead.items()}).drop(rid)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy and rejected. Learns from the folds of doc_id that are not held out."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    apart = ~held_out & (F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(FOLD)) == 0)
    docs = docs.select("doc_id", "text", "lang", held_out.alias("held_out"), apart.alias("apart"))
    tables = train(docs.filter("NOT held_out AND NOT apart"))
    seen = docs.select("doc_id", "text", "held_out", F.when(F.col("apart"), F.col("lang")).alias("tested"))
    found = materialise(classify(seen, tables).drop("text").withColumn("trust", F.sqrt(F.least("n_scored", F.lit(TRUST)).cast("double"))), "languages")
    known = found.filter(F.col("tested") == F.col("lang_pred"))
    # A row per language.
    means = materialise(known.groupBy("lang_pred").agg((F.sum(F.col("entropy") * F.col("n_scored")) / F.sum("n_scored")).alias("mean")), "means")
    away = (F.col("entropy") - F.col("mean")) * F.col("trust")
    usual = materialise(known.join(means, "lang_pred").groupBy("lang_pred", "mean").agg(F.sqrt(F.avg(away * away)).alias("spread")), "spreads")
    rejected = F.coalesce(away > REJECT * F.col("spread"), F.col("lang_pred") == "und")
    return found.join(usual, "lang_pred", "left").select("doc_id", "held_out", "lang_pred", "score", "entropy", rejected.alias("rejected"))


def query(docs: DataFrame) -> DataFrame:
    return identify(docs)
