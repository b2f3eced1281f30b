"""Operators 11 to 13 against brute force: small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import gc
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.llm import divergence, manifest, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# 11 ---------------------------------------------------------------------------------------------------------------------------


def brute_audit(rows):
    """Every number by itself, with Python's whole numbers."""
    groups, docs, total = defaultdict(Counter), defaultdict(Counter), {}
    for _, text, lang, source, _ in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        every = sum(own.values(), Counter())
        shares = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        q, p = shares(every), {s: shares(c) for s, c in own.items()}
        far = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(-far(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                out |= {(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(sorted(found)[:most], 1)}
    return out


def random_rows(seed, n, sources, vocabulary):
    r = random.Random(seed)
    words = [r.choice(["Ab", "aB", "é", "É", "ab", "x", "日本", "ω", "z9q", "straße"]) + r.choice("abcdeü") * r.randint(0, 2) for _ in range(vocabulary)]
    rows = [(i, r.choice([" ", "\n", "-", "\u0000", "7"]).join(r.choices(words, k=r.randint(0, 30))), r.choice(["en", "de", "", None]), r.choice(sources), 0) for i in range(n)]
    return rows + [(n, None, "fr", "a", None), (n + 1, "", "fr", None, None), (None, "only", "it", "b", 1), (n + 2, "word " * 3000, "en", sources[0], 1)]


def as_rows(df):
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


@pytest.mark.parametrize("seed, n, sources, vocabulary", [(1, 60, ["a", "b", None], 20), (2, 400, [f"s{i}" for i in range(9)], 60), (3, 30, ["one"], 5)])
def test_divergence_equals_brute_force(spark, seed, n, sources, vocabulary):
    rows = random_rows(seed, n, sources, vocabulary)
    got = divergence.audit(table(spark, rows).repartition(3).withColumns({c: F.lit("clash") for c in ("term", "p", "q", "block", "n")}))
    found = got.collect()
    assert as_rows(got) == brute_audit(rows) and len(found) == len(brute_audit(rows))


def test_divergence_with_small_tries_steps_and_pieces(spark, monkeypatch):
    """Tries that are written out again and again, blocks of a few terms, steps of a few pairs, texts in pieces: the same result. Workers must see the bounds, so the functions run here."""
    rows = random_rows(5, 200, [f"s{i}" for i in range(6)], 40)
    text = ("Ab cd é " * 50).encode()
    monkeypatch.setattr(divergence, "PIECE", 16)
    assert [w for part in divergence.pieces(text) for w in part] == text.lower().split() and len(list(divergence.pieces(text))) > 10
    assert list(divergence.pieces(b"x" * 100)) == [[b"x" * 100]] and list(divergence.pieces(b"")) == [[]]
    monkeypatch.setattr(divergence, "BLOCK", 3)
    assert as_rows(divergence.audit(table(spark, rows))) == brute_audit(rows)


def test_trie_is_in_order_of_bytes():
    r = random.Random(4)
    for _ in range(30):
        terms = [bytes(r.choices(b"ab\xc3\xff", k=r.randint(0, 6))) for _ in range(200)]
        trie = divergence.Trie()
        want = defaultdict(lambda: [0, 0])
        for i in range(4):
            counts = Counter(terms[i::4])
            trie.add(trie.leaf(list(counts)), i % 2, np.array(list(counts.values())), 1)
            for t, n in counts.items():
                want[t, i % 2][0] += n
                want[t, i % 2][1] += 1
        walked = list(trie.walk())
        assert [t for t, _ in walked] == sorted(set(terms))
        names = {leaf: t for t, leaf in walked}
        assert {(names[a], s): [n, d] for a, s, n, d in trie.settle().T.tolist()} == dict(want)


def test_trie_holds_arrays_and_long_terms():
    """No Python object stands for a node, whatever the number of terms; terms that end at, before and after each edge, and twins that differ in their last byte."""
    terms = [f"{i * 2654435761 % 10**9}".encode() for i in range(20_000)]
    trie = divergence.Trie()
    gc.collect()
    before = len(gc.get_objects())
    trie.leaf(terms)
    gc.collect()
    assert len(gc.get_objects()) - before < 1000 and [t for t, _ in trie.walk()] == sorted(set(terms))
    r = random.Random(8)
    for _ in range(30):
        trie, leaf = divergence.Trie(), {}
        for _ in range(3):
            some = [bytes(r.choices(b"ab\xc3\xff", k=r.choice([0, 1, 7, 8, 9, 16, 31, 32, 33, 90]))) for _ in range(60)]
            some += [t[:32] + b"a" * r.randint(0, 3) for t in some] + some[:5]
            for t, i in zip(some, trie.leaf(some).tolist()):
                assert leaf.setdefault(t, i) == i
        assert list(trie.walk()) == sorted(leaf.items()) and sorted(leaf.values()) == list(range(trie.size))


def test_terms_end_with_their_texts():
    import pyarrow as pa

    from hourloom.llm.common import utf8

    r = random.Random(9)
    for _ in range(200):
        texts = [r.choice([None, "", "Ab", "ab cd", " x", "y ", "É é", "  ", "a\x00b", "日本" * r.randint(0, 20)]) for _ in range(r.randint(0, 9))]
        terms, doc = divergence.cut(*utf8(pa.array(texts, pa.string())))
        want = [(i, w.encode()) for i, t in enumerate(texts) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))]
        assert list(zip(doc.tolist(), terms.to_pylist())) == want


@pytest.mark.parametrize("step, fewer", [(4000, True), (8, False)])
def test_walk_counts_pairs_by_kind(monkeypatch, step, fewer):
    """Values are worked out for kinds of pairs (sources and shares), not for each pair; candidates below a group's first 200 are not kept, and ties go by term."""
    import pyarrow as pa

    r = random.Random(7)
    rows = [{"lang": "en", "term": f"t{i:04}", "q": 50 + i % 7, "entries": [{"source": f"s{s}", "p": r.choice([40, 70, 90 + s]), "zero": 5 + s} for s in range(6)]} for i in range(2000)]
    monkeypatch.setattr(divergence, "STEP", step)
    far, worked = divergence.far, []
    monkeypatch.setattr(divergence, "far", lambda p, q: (worked.append(len(p)), far(p, q))[1])
    sums, best = Counter(), defaultdict(list)
    batch = pa.RecordBatch.from_pylist(rows if fewer else rows[:300])
    rows = batch.to_pylist()
    for b in divergence.walk(iter([batch.slice(i, 500) for i in range(0, len(rows), 500)])):
        for x in b.to_pylist():
            if x["part"] == "pair":
                sums[x["source"], x["item"]] += x["value"]
            else:
                best[x["source"]].append((-x["value"], x["item"]))
    assert not fewer or sum(worked) < 60_000  # of 240,000 for the pairs alone
    one = lambda p, q: (p - q) ** 2 // q
    want, first = Counter(), defaultdict(list)
    for x in rows:
        for a in x["entries"]:
            if a["p"] > x["q"]:
                first[a["source"]].append((-one(a["p"], x["q"]), x["term"]))
            for b in x["entries"]:
                if a is not b:
                    want[a["source"], b["source"]] += one(a["p"], b["p"]) - one(a["p"], b["zero"]) - one(a["zero"], b["p"]) + one(a["zero"], b["zero"])
    assert sums == want and {s: sorted(x) for s, x in best.items()} == {s: sorted(x)[: divergence.TOP] for s, x in first.items()}


def test_walk_in_small_steps(monkeypatch):
    import pyarrow as pa

    r = random.Random(6)
    rows = []
    for i in range(40):
        entries = [{"source": f"s{s}", "p": r.randint(2, 10**9), "zero": 5 + s} for s in r.sample(range(7), r.randint(1, 7))]
        rows.append({"lang": "en" if i < 25 else "de", "term": f"t{i:02}", "q": r.randint(1, 10**9), "entries": entries})
    batch = pa.RecordBatch.from_pylist(rows)
    results = []
    for step, pairs in ((1 << 20, 1 << 20), (8, 3)):
        monkeypatch.setattr(divergence, "STEP", step)
        monkeypatch.setattr(divergence, "PAIRS", pairs)
        sums, best = Counter(), set()
        for b in divergence.walk(iter(batch.slice(i, 6) for i in range(0, 40, 6))):
            for x in b.to_pylist():
                key = x["lang"], x["source"], x["item"]
                if x["part"] == "pair":
                    sums[key] += x["value"]
                else:
                    best.add((*key, x["value"]))
        results.append((dict(sums), best))
    assert results[0] == results[1]
    far = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for x in rows:
        for a in x["entries"]:
            for b in x["entries"]:
                if a != b:
                    want[x["lang"], a["source"], b["source"]] += far(a["p"], b["p"]) - far(a["p"], b["zero"]) - far(a["zero"], b["p"]) + far(a["zero"], b["zero"])
    assert results[0][0] == dict(want)


# 12 ---------------------------------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows, width):
    """doc_id to (leaf, subroot, root, proof, folded), by lists."""

    def leaf(r, more=0):
        fields = [r[0], r[3], r[2], r[4] if r[4] is None else r[4] + more, r[1]]
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + width])) for i in range(0, len(levels[-1]), width)])
        return levels

    def climb(levels, at, start):
        siblings, now = [], start
        for level in levels[:-1]:
            first = at // width * width
            run = level[first : first + width]
            siblings += run[: at - first] + run[at - first + 1 :]
            now, at = sha("".join(run[: at - first] + [now] + run[at - first + 1 :])), first // width
        return siblings, now

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in own[x]]) for x in langs}
    high = tree([trees[x][-1][0] for x in langs])
    out = []
    for x in langs:
        for i, r in enumerate(own[x]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            a, now = climb(trees[x], i, leaf(r, int(changed)))
            b, now = climb(high, langs.index(x), now)
            out.append((r[0], leaf(r), trees[x][-1][0], high[-1][0], sha("".join(a + b)), now, now == high[-1][0]))
    return out


@pytest.mark.parametrize("width, depth", [(2, 8), (2, 1), (2, 3), (3, 2), (5, 1)])
def test_manifest_equals_brute_force(spark, width, depth):
    rows = [(i, f"text {i}\n é", f"l{i % 3}", None if i % 5 == 0 else "s", None if i % 4 == 0 else i) for i in range(1, 60)]
    rows += [(i, None if i == 100 else "", None, "s", 3) for i in range(100, 117)] + [(7, "one more", "l1", "s", 2), (7, "one more", "l1", "s", 2), (None, "x", "l1", "", 5), (500, "alone", "ünique", "s", 1), (501, "w" * 100_000, "", "s", 1)]
    df = table(spark, rows).repartition(4).withColumns({c: F.lit("clash") for c in ("idx", "n", "hash", "g", "level", "part")})
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = manifest.manifest(df, F.when(chosen, manifest.leaf_of(n_chars=F.col("n_chars") + 1)), width, depth)
    proof = F.sha2(F.concat_ws("", "siblings").cast("binary"), 256)
    found = [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", proof, "folded", F.col("folded") == F.col("root")).collect()]
    want = brute_manifest(rows, width)
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert {x[-1] for x in want} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = manifest.query(table(spark, [(3, "x", "en", "s", 1)])).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] == one[0]["folded_root"] and one[0]["proof_sha256"] == sha("") and one[0]["verified"]
    assert manifest.query(table(spark, [])).count() == 0
    most = (1 << 63) - 1
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0][:2]
    got = {r["doc_id"]: r["verified"] for r in manifest.query(table(spark, [(ids[0], "x", "en", "s", most), (ids[1], "x", "en", "s", None)])).collect()}
    assert got == {ids[0]: False, ids[1]: True}


# 13 ---------------------------------------------------------------------------------------------------------------------------

MILD, HARSH = "stone river lamp garden window table morning letter".split(), ["grobian", "grobiste", "vilenix"]


def labelled(n, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = r.choices(MILD, k=r.randint(3, 40))
        toxic = i % 4 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(HARSH).title() + "!"
        rows.append((i, " ".join(words), "en" if i % 3 else "de", "s", 1))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = labelled(1600)
    odd = [(9000, None, "en", "s", None), (9001, "", None, "s", 0), (9002, "1 2 3 \n\u0000", "xx", None, 3), (None, "grobian", "en", "s", 1), (9003, "stone " * 400_000 + "grobian" + " river" * 400_000, "en", "s", 1), (9004, "x" * 2_000_000, "en", "s", 1), (8, "repeated id", "en", "s", 1)]
    marks = spark.createDataFrame(labels + [(9000, 1), (77_777, 1), (8, 0), (None, 1), (12, None)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    got = toxicity.query(table(spark, rows + odd).withColumns({c: F.lit("clash") for c in ("score", "key", "toxic", "threshold", "trained")}), marks)
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r)
    assert sum(map(len, by.values())) == len(rows) + len(odd)
    held = [(by[i][0], t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r["held_out"] for r, _ in held) and not by[None][0]["held_out"]
    assert sum(r["predicted"] == t for r, t in held) > 0.97 * len(held) and sum(r["flagged"] == bool(t) for r, t in held) > 0.97 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for own in by.values() for r in own)
    assert by[9000][0]["score"] == by[9001][0]["score"] == by[9002][0]["score"] < 0.3 and by[9003][0]["score"] > 0.3 > by[9004][0]["score"]
    texts = dict((r[0], r[1]) for r in rows)
    twin = toxicity.classify(table(spark, [(i, texts[i % 1600], "zz", "other", 9) for i in (4000, 4001)]), toxicity.train_model(table(spark, rows), marks)).collect()
    assert len(twin) == 2


def test_toxicity_without_labels(spark):
    rows, labels = labelled(40)
    for marks, score in (([], 0.5), ([(i, 0) for i in range(40)], 0.0), ([(i, 1) for i in range(40)], 1.0)):
        got = toxicity.query(table(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
        assert len(got) == 40 and {round(r["score"], 3) for r in got} == {score}
    assert toxicity.query(table(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_network_gradients_are_those_of_differences(monkeypatch):
    """One step of a net with few rows against the loss's own differences, and answers against plain loops."""
    for name, value in (("ROWS", 50), ("SIZE", 4), ("FILTERS", 3)):
        monkeypatch.setattr(toxicity, name, value)
    each = [[b"river", b"grobian", b"stone"], [b"lamp"], [], [b"garden", b"letter", b"river", b"lamp", b"window"]]
    number = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in each]
    rows, starts = toxicity.units(list(number))
    t, label, weight = toxicity.Texts.numbered(ids, rows, starts), np.array([1.0, 0, 1, 0]), np.ones(4)
    net = toxicity.Network.new()
    for f in ("table", "filters", "shift", "weight", "bias"):
        setattr(net, f, getattr(net, f).astype(np.float64))

    def plain(net):
        out = []
        for words in each:
            vectors = [np.mean([net.table[i] for i in toxicity.units([w])[0]], 0) for w in words] + [np.zeros(4)] * 2
            z = net.bias[0]
            for i, k in enumerate(toxicity.WIDTHS):
                answers = [[sum(vectors[at + j] @ net.filters[toxicity.PARTS.index((k, j))][:, f] for j in range(k)) + net.shift[i][f] for f in range(3)] for at in range(len(words))]
                z += sum(net.weight[i][f] * max([0.0, *(a[f] for a in answers)]) for f in range(3))
            out.append(z)
        return np.array(out)

    def loss(net):
        z = plain(net)
        return float(np.mean(np.logaddexp(0, z) - label * z) + np.logaddexp(0, net.bias[0]))

    high = toxicity.pooled(net, t)
    assert np.allclose((high * net.weight).sum((1, 2)) + net.bias, plain(net), atol=1e-5)
    before = [a.copy() for a in net.arrays()]
    sums = [np.zeros(a.shape) for a in net.arrays()]
    toxicity.learn(net, sums, t, label, weight)
    r = np.random.default_rng(0)
    fresh = toxicity.Network(*[a.copy() for a in before])
    for k, a in enumerate(fresh.arrays()):
        for _ in range(12):
            at = tuple(int(r.integers(n)) for n in a.shape)
            if k == 0:
                at = (int(r.choice(rows)), at[1])
            kept, e = a[at], 1e-5
            a[at] = kept + e
            up = loss(fresh)
            a[at] = kept - e
            slope = (up - loss(fresh)) / (2 * e)
            a[at] = kept
            assert abs(abs(slope) - np.sqrt(sums[k][at])) < 2e-4, (k, at)


def test_calibration():
    r = np.random.default_rng(1)
    z = r.normal(0, 2, 4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(1.5 * z - 1)))).astype(float)
    slope, shift = toxicity.platt(z, y)
    assert abs(slope - 1.5) < 0.15 and abs(shift + 1) < 0.15
    assert toxicity.best(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) == pytest.approx(0.5)
    assert np.isfinite(toxicity.platt(np.array([-1.0, 1.0]), np.array([0.0, 1.0]))).all()


def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch):
    """Each part meets its documents, all of them meet every labelled one, and several parts learn what one learns."""
    rows, labels = labelled(1600)
    learned = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    marks = toxicity.known(spark.createDataFrame([*labels, (5, 1), (77_777, 1)], "doc_id long, toxic int"))
    docs = table(spark, rows + [(9, "stone twice", "en", "s", 1)])
    roles = toxicity.with_role(docs).join(marks, "doc_id").collect()
    assert sorted(r["doc_id"] for r in roles) == sorted([*learned, *[9] * (9 in learned)]) and {r["trained"] for r in roles} == {True, False}
    assert toxicity.parts_of(10**6, 10**9)[0] == 10**6 // toxicity.PER_PART and toxicity.parts_of(100, 10**10)[0] == -(-(10**10) // toxicity.CHARS)
    seen, parts = [], toxicity.trained_parts

    def watched(own, *rest):
        seen.extend(own.collect())
        return parts(own, *rest)

    monkeypatch.setattr(toxicity, "trained_parts", watched)
    monkeypatch.setattr(toxicity, "PER_PART", 250)
    first = toxicity.train_model(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    trained = [r["text"] for r in toxicity.labelled(docs, marks).collect()]
    assert len(trained) == sum(r["trained"] for r in roles)
    assert sorted(r["text"] for r in seen) == sorted(trained) and len({r["part"] for r in seen}) == len(trained) // 250 > 2
    again = toxicity.train_model(docs.repartition(7), spark.createDataFrame(labels, "doc_id long, toxic int").repartition(3))
    assert first.network == again.network
    held = dict(labels)
    got = [r for r in toxicity.classify(docs, first).filter("held_out").collect()]
    assert sum(r["predicted"] == held[r["doc_id"]] for r in got) > 0.95 * len(got)


def test_toxicity_knows_what_only_the_last_labels_say(spark):
    """A word of the toxic documents beyond the first 3000, and toxic ones beyond the first 6000 that calibrate, in the order of the hash by which samples were once taken."""
    ids = spark.range(50_000).filter("crc32(cast(cast(id AS string) AS binary)) % 4 <> 2").selectExpr("id", "xxhash64(13, id) AS key", "pmod(xxhash64(31, id), 5) > 0 AS trained").orderBy("key").collect()
    r = random.Random(3)
    kinds = {True: ["vilenix"] * 3000 + ["grobian"] * 400 + [None] * 1500, False: [None] * 6000 + ["vilenix", "grobian"] * 300}
    rows, labels = [], []
    for trained, words in kinds.items():
        for x, word in zip((x["id"] for x in ids if x["trained"] == trained), words, strict=False):
            rows.append((x, " ".join([*r.choices(MILD, k=3), word or r.choice(MILD), r.choice(MILD)]), "en", "s", 1))
            labels.append((x, int(word is not None)))
    assert len(rows) == 11_500
    model = toxicity.train_model(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    asked = table(spark, [(1, "stone lamp river", "en", "s", 1), (2, "stone vilenix river", "en", "s", 1), (3, "stone grobian river", "en", "s", 1)])
    got = {x["doc_id"]: x for x in toxicity.classify(asked, model).collect()}
    assert [got[i]["predicted"] for i in (1, 2, 3)] == [0, 1, 1] and [got[i]["flagged"] for i in (1, 2, 3)] == [False, True, True]
    assert model.slope != 1 and set(model.by_language) == {"en"}


def test_calibration_in_spark_equals_that_of_arrays(spark, monkeypatch):
    r = np.random.default_rng(2)
    z = np.round(r.normal(0, 2, 3000), 2)  # with ties
    y = (r.random(3000) < 1 / (1 + np.exp(-(1.5 * z - 1)))).astype(int)
    lang = np.array(["en", "de", "xx", "", None], object)[r.choice(5, 3000, p=[0.5, 0.3, 0.005, 0.095, 0.1])]
    rows = spark.createDataFrame([(int(t), x, float(v)) for t, x, v in zip(y, lang, z)], "toxic int, lang string, number double")
    assert toxicity.fit_scale(rows, int(y.sum()), int(3000 - y.sum())) == toxicity.fit_scale(rows.repartition(9), int(y.sum()), int(3000 - y.sum())) == toxicity.platt(z, y)
    for most in (200_000, 100):
        monkeypatch.setattr(toxicity, "RANKED", most)
        got = toxicity.thresholds(rows.withColumnRenamed("number", "score"), 3000)
        assert got == {"": toxicity.best(z, y), "en": toxicity.best(z[lang == "en"], y[lang == "en"]), "de": toxicity.best(z[lang == "de"], y[lang == "de"])}
