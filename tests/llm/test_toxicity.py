"""Kneser-Ney class models (op2): counts and model against a plain version, held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorsight.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def plain_model(docs):
    """Probabilities of both models after each context, by dictionaries."""
    n = toxicity.ORDER
    top = [Counter(), Counter()]
    for label, text in docs:
        c, ends = toxicity.codes([text])
        top[label].update(tuple(c[i: i + n].tolist()) for i in range(len(c) - n + 1))
    counts = {n: top}
    types = set(top[0]) | set(top[1])
    for order in range(n - 1, 0, -1):
        above = counts[order + 1]
        if order > toxicity.SHARED:
            counts[order] = [Counter(g[1:] for g in above[k]) for k in (0, 1)]
            types = set(counts[order][0]) | set(counts[order][1])
        else:
            pooled = Counter(g[1:] for g in types)
            counts[order], types = [pooled, pooled], set(pooled)
    cuts, total, kinds = {}, {}, {}
    for order, both in counts.items():
        for k in (0, 1):
            a, b = (sum(c == x for c in both[k].values()) for x in (1, 2))
            cuts[order, k] = min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5
            total[order, k], kinds[order, k] = defaultdict(int), defaultdict(int)
            for g, c in both[k].items():
                total[order, k][g[:-1]] += c
                kinds[order, k][g[:-1]] += 1

    def p(k, gram):
        out = 1 / toxicity.ALPHABET
        for order in range(1, n + 1):
            g = gram[n - order:]
            t, d = total[order, k].get(g[:-1], 0), cuts[order, k]
            if t:
                out = max(counts[order][k].get(g, 0) - d, 0) / t + d * kinds[order, k][g[:-1]] / t * out
        return out

    return p


def test_model_equals_the_plain_one(spark, monkeypatch):
    rnd = random.Random(5)
    words = "the a of cat dog Σ 中文 𝒳 run fast\tslow idiot scum".split()
    docs = [(int(i % 4 == 0), " ".join(rnd.choice(words[: 9 if i % 4 else 12]) for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    df = spark.createDataFrame(docs, "label int, text string")
    monkeypatch.setattr(toxicity, "BUCKET_ROWS", 100)
    monkeypatch.setattr(toxicity, "HELD_BYTES", 20_000)  # buckets come and go
    tables = toxicity.write_model(toxicity.count_grams(df))
    assert tables.buckets > 2
    p = plain_model(docs)
    texts = [t for _, t in docs[:20]] + ["", "x", "an unseen line 123", "idiot scum", "the cat"]
    got = toxicity.ratios(tables, texts)
    for text, x in zip(texts, got):
        c, _ = toxicity.codes([text])
        grams = [tuple(c[i: i + toxicity.ORDER].tolist()) for i in range(len(c) - toxicity.ORDER + 1)]
        want = sum(math.log(p(1, g) / p(0, g)) for g in grams) / (len(grams) + toxicity.PRIOR_CHARS)
        assert x == pytest.approx(want, abs=2e-5)


def test_cuts_of_a_batch_do_not_change_a_value(spark, monkeypatch):
    docs = [(i % 2, f"some words {i} here " * (i % 7)) for i in range(30)]
    tables = toxicity.write_model(toxicity.count_grams(spark.createDataFrame(docs, "label int, text string")))
    whole = toxicity.ratios(tables, [t for _, t in docs])
    monkeypatch.setattr(toxicity, "BATCH_CHARS", 50)
    assert np.allclose(whole, toxicity.ratios(tables, [t for _, t in docs]), atol=1e-6)


def test_held_out_accuracy_on_readable_classes(spark):
    """Toxic words among common ones; the held-out rows are told apart."""
    rnd = random.Random(1)
    common = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        words = [rnd.choice(common) for _ in range(rnd.randint(20, 200))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[rnd.randrange(len(words))] = rnd.choice(["zubble", "quaxif", "dwokky"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, known).collect()}
    held = [i for i in got if got[i].held_out]
    assert set(held) == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    right = sum(got[i].predicted == (i % 5 == 0) for i in held)
    assert right >= 0.97 * len(held)
    # Held-out labels change nothing.
    turned = spark.createDataFrame([(i, 1 - t if i in set(held) else t) for i, t in labels], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in toxicity.score(docs, turned).collect()} == {i: r.score for i, r in got.items()}


def test_op2_rows_and_range(spark):
    got = queries.op2_toxicity(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, "", 3), (2, "long " * 30000, 4), (3, "ok", 5), (3, "ok", 5)],
                                 "doc_id long, text string, x int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (99, 0), (3, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert next(r for r in got if r.doc_id is None).held_out is False
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert toxicity.score(docs, labels.limit(0)).count() == 6 and toxicity.score(docs.limit(0), labels).count() == 0


def test_logistic_fit():
    rnd = np.random.default_rng(0)
    x = np.concatenate([rnd.normal(0, 0.01, 900), rnd.normal(0.08, 0.02, 100)])
    y = np.repeat([0.0, 1.0], [900, 100])
    slope, middle = toxicity.fit(x, y)
    assert slope > 50 and 0.02 < middle < 0.07
    assert toxicity.fit(x, np.zeros(1000)) == toxicity.DEFAULT_FIT
    assert toxicity.fit(-x, y) == toxicity.DEFAULT_FIT


def test_tables_hold_every_gram():
    """More grams than the 2^21 slots that were kept: none is lost, and none is found that is not there."""
    rnd = np.random.default_rng(3)
    key = np.unique(rnd.integers(0, 1 << 60, 2_500_000).astype(np.uint64))
    pairs = rnd.random((len(key), 2)).astype(np.float32)
    tables = toxicity.hash_tables(key, pairs)
    assert np.array_equal(toxicity.look_up(0.5, tables, key), pairs)
    other = np.setdiff1d(rnd.integers(0, 1 << 60, 100_000).astype(np.uint64), key)
    assert (toxicity.look_up(0.5, tables, other) == 0.5).all()
    assert sum(t.nbytes for t in tables) < 3 * 16 * len(key)
    assert (toxicity.look_up(1.0, [], other[:3]) == 1.0).all()


def test_model_keeps_every_gram(spark, monkeypatch):
    """All grams of the labelled texts are in the written model, as many as were counted, in any bucket."""
    monkeypatch.setattr(toxicity, "BUCKET_ROWS", 40_000)
    rnd = random.Random(8)
    docs = [(i % 2, "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(500))) for i in range(200)]
    counted = toxicity.count_grams(spark.createDataFrame(docs, "label int, text string")).cache()
    store = toxicity.write_model(counted)
    kept = {tab: sum(int((t[:, 0] != 0).sum()) for b in range(store.buckets) for t in store.tables(tab, b)) for tab in range(2, 12)}
    for n in range(1, 6):
        hi, lo = toxicity._last(n)
        assert kept[2 * n] == counted.select(hi.alias("hi"), lo.alias("lo")).distinct().count()
    chi, clo = toxicity._without_last()
    assert kept[11] == counted.select(chi.alias("a"), clo.alias("b")).distinct().count()
    grams = {tuple(t[i: i + 5]) for _, t in docs for i in range(len(t) - 4)}
    got = {tuple(chr(int(x)) for x in (r.hi >> 21, r.hi & 0x1FFFFF, r.lo >> 42, r.lo >> 21 & 0x1FFFFF, r.lo & 0x1FFFFF)) for r in counted.collect()}
    assert grams <= got and len(got - grams) == len({tuple(f" {t} "[i: i + 5]) for _, t in docs for i in (0, len(t) - 3)})


def test_characters_of_any_script_are_told_apart(spark):
    """Two expressions that the old 1,024 codes could confuse: each keeps its own score."""
    rnd = random.Random(2)
    wide = [chr(x) for x in range(0x4E00, 0x4E00 + 4000)]
    toxic, plain = wide[100:104], [w for w in wide if w not in wide[100:104]]
    docs = [(i % 2, "".join(rnd.choice(plain) for _ in range(80)) + ("".join(toxic) * 4 if i % 2 else "")) for i in range(120)]
    store = toxicity.write_model(toxicity.count_grams(spark.createDataFrame(docs, "label int, text string")))
    hit = toxicity.ratios(store, ["".join(toxic) * 4])[0]
    others = [toxicity.ratios(store, ["".join(rnd.choice(plain) for _ in range(4)) * 4])[0] for _ in range(300)]
    assert hit > 0.05 and max(others) < hit / 2


def test_model_counts_the_rows_that_fit_the_logistic_function(spark):
    """An expression found only in texts of the calibration eighth is learned as well."""
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        code = zlib.crc32(str(i).encode())
        aside, toxic = code % 3 != 1 and code // 3 % 8 == 0, int(i % 4 == 0)
        words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(60)]
        if toxic:
            words[::6] = ["wyzquv" if aside else "zubble"] * 10
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    learned, unseen = toxicity.ratios(model.store, ["wyzquv " * 20, "kxjpgd " * 20])
    assert learned > unseen + 0.1
