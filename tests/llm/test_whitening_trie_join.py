"""Whitening (op11), conversation prefix trie (op12) and n-gram Jaccard join (op13)."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from motorsight.llm import ngramjoin, prefixtrie, queries, whitening

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_ngram_join"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(want)


# --- whitening ----------------------------------------------------------------------------------

@pytest.mark.parametrize("d,rank", [(1, 1), (2, 2), (7, 7), (12, 5), (40, 40), (33, 8)])
def test_factor_gives_eigenpairs(d, rank):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(300, rank)) @ rng.normal(size=(rank, d))
    v = a.T @ a / 300
    e, c = whitening.eigen(v)
    assert len(e) == rank and (np.diff(e) <= 0).all()
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9)
    assert np.allclose(c @ c.T, np.eye(rank), atol=1e-12) and np.allclose(c @ v @ c.T, np.diag(e), atol=1e-10 * e[0])


def test_small_eigenvalues_keep_their_digits():
    scale = np.array([1e6, 1.0, 1e-6])
    base = np.array([[2.0, 0.5, 0.2], [0.5, 1.0, 0.3], [0.2, 0.3, 3.0]])
    e, _ = whitening.eigen(base * np.outer(scale, scale))
    assert len(e) == 3
    assert np.isclose(np.prod(e), np.linalg.det(base) * np.prod(scale) ** 2, rtol=1e-10)


def check_whitening(got, ids, m, k=8):
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in row] for row in m]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    exact = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    dev = [e if e < 1 << 63 else None for e in exact]
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter(zip(ids, dev, strict=True))
    z = np.array([[a - b // n - (b % n) / n for a, b in zip(r, s, strict=True)] for r in x])
    e, c = np.linalg.eigh(z.T @ z / n)
    e, c = e[::-1], c[:, ::-1]
    for j in range(min(k, int((e > 1e-9 * e[0]).sum()))):
        have = [v for _, v in sorted((r.vec_id, r.whitened) for r in got if r.component == j + 1)]
        want = [v for _, v in sorted(zip(ids, z @ c[:, j] / np.sqrt(e[j]), strict=True))]
        assert min(np.abs(np.array(have) - want).max(), np.abs(np.array(have) + want).max()) < 1e-9
        assert all(np.isclose(r.explained, e[j] / e.sum(), rtol=1e-6) and r.identity_error < 1e-8 and r.n == n for r in got if r.component == j + 1)


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    given = table.toPandas()
    got = queries.op11_whitening(spark, SF).collect()
    assert len(got) == 8 * len(given)
    check_whitening(got, given.vec_id.tolist(), given.embedding.tolist())


def test_whitening_odd_rows(spark):
    rng = random.Random(3)
    good = [(i if i else None, [round(rng.uniform(-2, 2), 3) for _ in range(5)], "x") for i in range(40)]
    good += [good[3], good[3], (7, [0.0] * 5, "y"), (8, [1e6, -1e6, 0.5, 2.0, 1.0], "big")]
    nan, inf = float("nan"), float("inf")
    bad = [(90, None, "x"), (91, [1.0, None, 1.0, 1.0, 1.0], "x"), (92, [nan] * 5, "x"), (93, [1.0, 1.0, -inf, 1.0, 1.0], "x"),
           (94, [], "x"), (95, [1.0, 2.0], "x"), (96, [1e300] * 5, "x")]
    schema = "vec_id long, embedding array<double>, deviation string"
    got = whitening.whiten(spark.createDataFrame(good + bad, schema).repartition(5)).collect()
    assert len(got) == 5 * len(good)  # five dimensions give five components
    by = Counter(r.vec_id for r in got)
    assert by[None] == 5 and by[3] == 15
    ordered = spark.createDataFrame([(i, v, t) for i, (_, v, t) in enumerate(good)], schema)
    check_whitening(whitening.whiten(ordered).collect(), list(range(len(good))), [v for _, v, _ in good])
    assert whitening.whiten(spark.createDataFrame(good[1:2], schema)).collect() == []  # no variance
    assert whitening.whiten(spark.createDataFrame(bad[:5], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0], "x"), (2, [0.0, 2.0], "x")], schema)).count() == 2  # rank one


def test_whitening_of_huge_entries_is_exact(spark):
    rows = [(i, [float(i) * 2 ** 40, float(i % 3)]) for i in range(1, 6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all((r.deviation is None) == (r.vec_id != 3) for r in got)
    assert max(r.identity_error for r in got) < 1e-9


# --- prefix trie ----------------------------------------------------------------------------------

def plain_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    conv = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        conv[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, t in conv.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if len(conv[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p],
                    sum(not kids[q] for q in below), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return Counter(out)


CONVERSATIONS = "conv_id long, turn long, role string, text string, pos string"


def got_trie(spark, rows, block_turns):
    df = spark.createDataFrame([(*r, "p") for r in rows], CONVERSATIONS).repartition(3)
    return Counter(tuple(r) for r in prefixtrie.prefix_trie(df, block_turns).collect())


def random_conversations(seed):
    rng = random.Random(seed)
    rows, kinds = [], ["", "a", "b", "é" * 5, None]
    stock = [[(rng.choice(["u", "a", None]), rng.choice(kinds)) for _ in range(rng.randint(1, 9))] for _ in range(4)]
    for c in rng.sample(range(-150, 420), 60) + [None]:
        turns = rng.choice(stock)[: rng.randint(1, 9)]
        turns = turns + [(rng.choice(["u", "a"]), rng.choice(kinds)) for _ in range(rng.choice([0, 0, 1, 3]))]
        for i, (r, x) in enumerate(turns):
            rows.append((c, rng.choice([i, i, i, None]), r, x))
    return rows + rows[:5]  # repeated rows


@pytest.mark.parametrize("seed,block", [(1, 1), (2, 9), (3, 40), (4, 1 << 18)])
def test_trie_equals_the_plain_trie(spark, seed, block):
    rows = random_conversations(seed)
    assert got_trie(spark, rows, block) == plain_trie(rows)


def test_trie_of_copies_over_many_blocks(spark):
    long = [(c, t, "user", f"t{t}" * 3) for c in range(300, 360) for t in range(12)]
    other = [(c, t, "user", f"t{min(t, 8)}") for c in range(700, 720) for t in range(c % 7 + 1)]
    for block in (5, 64):
        assert got_trie(spark, long + other, block) == plain_trie(long + other)


def test_trie_odd_tables(spark):
    assert got_trie(spark, [], 8) == Counter()
    assert got_trie(spark, [(None, 1, "u", "x")], 8) == Counter()
    for rows in ([(5, None, None, None)], [(205, 0, "u", "x" * 100_000), (206, 0, "u", "x" * 100_000)], [(3, 1, "u", "a"), (3, 1, "u", "a")]):
        assert got_trie(spark, rows, 2) == plain_trie(rows)


def test_range_minimum_reaches_as_a_scan_does():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.integers(0, 5, n)
        values[0] = -1
        table = prefixtrie.RangeMinimum(values)
        at, depth = rng.integers(0, n, 50), rng.integers(0, 6, 50)
        left, right = table.reach(at, depth)
        for a, d, x, y in zip(at, depth, left, right, strict=True):
            lo = hi = a
            while lo > 0 and values[lo] >= d:
                lo -= 1
            while hi + 1 < n and values[hi + 1] >= d:
                hi += 1
            assert (lo, hi) == (x, y)
        a, b = np.sort(rng.integers(0, n, (2, 50)), axis=0)
        assert (table.least(a, b) == [values[i: j + 1].min() for i, j in zip(a, b, strict=True)]).all()


# --- n-gram join -----------------------------------------------------------------------------------

def plain_groups(rows, shingle, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i: i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return Counter((rows[i][0], len(sets[i]), least[group[i]]) for i in range(len(rows)))


def got_groups(spark, rows, shingle=3, percent=90, **more):
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n long").repartition(4)
    return Counter(tuple(r) for r in ngramjoin.jaccard_groups(df, shingle, percent, **more).collect())


def near_documents(seed, n, words=60, edits=4, bases=3):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(words // 2, words))] for _ in range(bases)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
        if rng.random() < 0.2:
            w += base[0][:8]  # a passage that many share
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,percent,more", [(1, 90, {}), (2, 80, {"chunk_grams": 90}), (3, 70, {"chunk_grams": 1})])
def test_join_equals_all_pairs(spark, monkeypatch, seed, percent, more):
    rows = near_documents(seed, 90)
    if seed > 1:
        monkeypatch.setattr(ngramjoin, "RUN_ROWS", 3)
    assert got_groups(spark, rows, percent=percent, **more) == plain_groups(rows, 3, percent)


def test_join_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, ""), (4, "A b"), (5, "a  B"), (6, "a"), (6, "a"), (None, "A"), (7, "b a"), (8, "É c d"),
            (9, "é c d"), (10, long), (11, long + " y"), (11, long), (12, "a b c"), (None, "only here"), (13, "a b c a b c a b c")]
    assert got_groups(spark, rows) == plain_groups(rows, 3, 90)
    assert got_groups(spark, []) == Counter()
    assert got_groups(spark, rows[:4]) == plain_groups(rows[:4], 3, 90)


def test_fold_bounds_the_overlap_and_keeps_every_linked_row(monkeypatch):
    rng = np.random.default_rng(4)
    for most in (40, 600):
        sets = []
        for _ in range(30):
            base = np.unique(rng.integers(0, 1 << 63, rng.integers(1, most)).astype(np.uint64) * np.uint64(2))
            sets += [base, np.unique(np.concatenate([base[rng.random(len(base)) < 0.97], rng.integers(0, 1 << 63, rng.integers(0, 3)).astype(np.uint64)]))]
        sets = sorted((x for x in sets if len(x)), key=len)
        n, fold, comp = np.array([len(x) for x in sets]), [ngramjoin.folded(x) for x in sets], rng.integers(0, 40, len(sets))
        assert all(len(f) == ngramjoin.bins(len(x)) and f.sum() == len(x) for f, x in zip(fold, sets, strict=True))
        keep = ngramjoin.has_partner(n, fold, comp, 90)
        for i in range(len(sets)):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if comp[i] != comp[j] and 100 * o >= 90 * (n[i] + n[j] - o):
                    assert keep[i] and keep[j]


def test_prefix_size_and_link_bound():
    for percent in (50, 80, 90, 100):
        for n in range(1, 60):
            need = next(k for k in range(n + 1) if 100 * k >= percent * n)
            assert ngramjoin.prefix_size(n, percent) == n - need + 1
    assert ngramjoin.prefix_size(0, 90) == 0


def test_product_links_join_what_all_pairs_join():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = rng.choice(500, 60, replace=False)
        sets = [np.unique(np.where(rng.random(60) < 0.06, rng.integers(1000, 3000, 60), base)).astype(np.uint64) for _ in range(25)]
        comp = list(range(25))
        links = ngramjoin.product_links(sets, comp, 85)
        group = list(range(25))
        for i, j in links:
            a, b = group[i], group[j]
            assert a != b  # a tree
            group = [b if g == a else g for g in group]
        for i in range(25):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                    assert group[i] == group[j]
