"""Learned partitions (op6) against brute force; the pipeline against plain versions of its stages."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from motorsight.llm import ann, mixing, queries, toxicity
from tests.llm.test_quality_lines import plain_lines
from tests.llm.test_simhash import plain_components, plain_simhash
from tests.llm.test_tokens_out import check_packing

SF = "/root/testdata/sf0.001"


def brute(rows, is_query, k):
    """Exact answers over (id, vector) rows, one vector an id."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i, v, n in zip(ids, x, norm):
        if is_query(i):
            score = (x * v).sum(axis=1) / (norm * n)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_op6_recall_and_scores(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 50 == 0, 5)
    got = answers(queries.op6_neighbours(spark, path))
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, hits in got.items():
        a = vectors[q]
        for i, s in hits:
            b = vectors[i]
            assert s == pytest.approx(float(a @ b / np.sqrt((a @ a) * (b @ b))), abs=1e-12)
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))


def test_blocks_and_parts_lose_nothing_when_all_are_probed(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(ann, "TARGET_RECALL", 1.0)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(ann.search(df, 5, df.vec_id % 10 == 0, parts=4))
    want = brute(rows, lambda i: i % 10 == 0, 5)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.97 * 5 * len(want)


def test_copies_ties_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(0, 200)] + [(300, [2.0, -1.0]), (301, [0.5, 1.0]), (350, [1.0, 0.0]), (50, same)]
    odd = [(400, None), (450, []), (500, [0.0, 0.0]), (550, [1.0, None]), (600, [nan, 1.0]), (650, [inf, 1.0]), (700, [1.0, 2.0, 3.0]), (None, same)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, part int")
    got = answers(ann.search(df, 5, df.vec_id % 50 == 0))
    assert set(got) == {0, 50, 100, 150, 300, 350}
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in got[350]][0] == 300 and len(got[350]) == 5
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert [i for i, _ in answers(ann.search(few, 5, few.vec_id == 0))[0]] == [1, 2]
    assert ann.search(few.limit(0), 5, few.vec_id == 0).count() == 0
    assert ann.search(few.filter("vec_id = 0"), 5, few.vec_id == 0).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    x = ann.unit(rng.normal(size=(600, 8)) + 3 * np.eye(8)[rng.integers(0, 2, 600)])
    graph = ann.nearest(x, x, 10, True)
    part = ann.balanced_parts(graph, x, 8, rng)
    assert np.bincount(part, minlength=8).max() <= math.ceil(ann.SLACK * 75)
    assert (part[graph] == part[:, None]).mean() > 0.3


# --- pipeline -----------------------------------------------------------------------------------

def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def check_stages(spark, docs, sf_dir):
    """Every stage against its plain version, on what the stage before kept."""
    cols = docs.columns
    kept = corpus_pipeline.toxicity_stage(spark, docs, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, labels).filter("predicted = 1").collect()}
    assert kept.columns == cols
    assert rows_of(kept) == Counter({r: n for r, n in rows_of(docs).items() if r[0] not in toxic})

    cut = corpus_pipeline.line_dedup_stage(spark, kept, sf_dir)
    assert cut.columns == cols
    before = rows_of(kept)
    plain = plain_lines([(r[0], r[1]) for r in before])
    want = Counter()
    for r, n in before.items():
        text, gone = (None, 0) if r[1] is None else plain[r[0], r[1]]
        want[(r[0], text, r[2], r[3], len(text) if gone else r[4])] += n
    assert rows_of(cut) == want

    one = corpus_pipeline.simhash_stage(spark, cut, sf_dir)
    assert one.columns == cols
    rows = sorted(rows_of(cut).elements(), key=lambda r: (r[0] is None, r[0] or 0))
    groups = plain_components([plain_simhash(r[1]) for r in rows], 3)
    got = rows_of(one)
    assert sum(got.values()) == len(set(groups)) and not got - rows_of(cut)
    least = {}
    for r, g in zip(rows, groups):
        least.setdefault(g, r[0])
    assert Counter(r[0] for r in got.elements()) == Counter(least.values())

    mixed = corpus_pipeline.mixing_stage(spark, one, sf_dir)
    assert mixed.columns == cols
    table = {r.source: r.rate for r in mixing.rates(one, queries.MIX_WEIGHTS).collect()}
    assert rows_of(mixed) == Counter({r: k for r, n in got.items() if (k := n * mixing.draw_plainly(queries.MIX_SEED, r[0], table[r[3]]))})

    packed = corpus_pipeline.packing_stage(spark, mixed, sf_dir).collect()
    check_packing(packed, queries.SEQUENCE_TOKENS)
    tok, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r, n in rows_of(mixed).items():
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, queries.BYTE_END_ID]
        a, b, i = 0, len(ids) % 2048 or min(len(ids), 2048), 0
        while a < len(ids):
            pieces[r[0], i, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += n
            a, b, i = b, b + 2048, i + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    return packed


def test_stages_equal_plain_versions_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = check_stages(spark, docs, SF)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, corpus_pipeline.run(spark, SF).collect())) == Counter(map(key, packed))


def test_stages_on_odd_rows(spark):
    text = "first line here\nsecond line here\nthird line here"
    rows = [(1, text, "en", "a", 48), (2, text, None, None, None), (None, text, "en", "a", 48), (None, None, None, "b", None), (3, "", "en", "b", 0),
            (4, "w " * 20000, "en", "a", 40000), (4, "w " * 20000, "en", "a", 40000), (5, "alone\nagain", "en", None, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert check_stages(spark, docs, SF)
    empty = docs.limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, empty, SF).count() == 0


def test_a_row_repeated_very_often_is_one_candidate(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [rows[7]] * 300 + [(1000 + i, rows[8][1]) for i in range(30)] + [(1000, rows[8][1])] * 50
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, score string, rank int").repartition(6)
    from pyspark.sql import functions as F
    got = answers(ann.search(df, 5, F.col("vec_id") % 50 == 0, parts=1))
    want = brute(list({i: (i, v) for i, v in rows}.values()), lambda i: i % 50 == 0, 5)
    assert {q: [i for i, _ in a] for q, a in got.items()} == {q: [i for i, _ in a] for q, a in want.items()}


def test_two_levels_keep_the_recall(spark, monkeypatch):
    """Parts divided again by networks of their own, as beyond MOST_PARTS: recall and work a query."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(ann, "MOST_PARTS", 4)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = answers(ann.search(df, 5, F.col("vec_id") % 50 == 0, parts=16))
    want = brute([(i, v) for i, v in enumerate(x)], lambda i: i % 50 == 0, 5)
    assert set(got) == set(want) and all(len(a) == 5 for a in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)
    exact = {i: dict(a) for i, a in want.items()}
    assert all(abs(s - exact[q][i]) < 1e-12 for q, a in got.items() for i, s in a if i in exact[q])
