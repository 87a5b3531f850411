"""Covering SimHash (op5) against brute force, and keep_one."""

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from motorsight.llm import graph, queries, simhash

SF = "/root/testdata/sf0.001"


def plain_simhash(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i: i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        n = sum(xxhash.xxh64_intdigest(g.encode(), 42) >> bit & 1 for g in grams)
        out |= (2 * n > len(grams)) << bit if grams else 0
    return out


def plain_components(fps, radius):
    """Least index reachable from each fingerprint, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=150, deadline=None)
@given(st.none() | st.text(alphabet="abAÉé \t\n\x0b\x1c\xa0", max_size=60))
def test_simhash_equals_the_definition(text):
    assert simhash.simhash(text, 3) == plain_simhash(text)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 4), st.integers(0, 2**64 - 1), st.data())
def test_every_pair_within_the_radius_meets_in_some_table(radius, x, data):
    bits = data.draw(st.sets(st.integers(0, 63), max_size=radius))
    y = x ^ sum(1 << b for b in bits)
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    assert any(x & m == y & m for m in masks)
    assert any(x & m == y & m for m in simhash.narrower(masks, radius))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 63), unique=True, max_size=30))
def test_run_links_join_exactly_what_is_within_the_radius(values):
    fps = np.array(sorted(values), np.uint64)
    a, b = simhash.run_links(fps, 1)
    roots = {int(v): int(v) for v in fps}
    for x, y in zip(a.tolist(), b.tolist()):
        roots[y] = roots[x]
    want = plain_components([int(v) for v in fps], 1)
    assert [roots[int(v)] for v in fps] == [int(fps[w]) for w in want]


def expect(docs):
    fps = [plain_simhash(t) for _, t in docs]
    ids = [None if k is None else k for k, _ in docs]
    comp = plain_components(fps, 3)
    least = {}
    for c, k in zip(comp, ids):
        if k is not None:
            least[c] = min(k, least.get(c, k))
    return sorted((k if k is not None else -1, f"{f:016x}", least.get(c, -1)) for k, f, c in zip(ids, fps, comp))


def test_op5_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, SF).collect())
    assert got == expect(docs)
    assert len({c for _, _, c in got}) < len(got)


def test_edge_rows_ties_and_names(spark):
    rows = [(5, None), (3, ""), (None, " \n"), (9, "A b c d"), (7, "a B c d"), (7, "a B c d"), (None, "only me here now"), (1, "x")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fp string, rid int")
    got = [(-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id)
           for r in simhash.near_duplicates(df, 3, 3).collect()]
    assert sorted(got) == expect(rows)
    kept = simhash.keep_one(df, 3, 3)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(3, ""), (7, "a B c d"), (-1, "only me here now"), (1, "x")])
    assert simhash.near_duplicates(df.limit(0), 3, 3).count() == 0 and simhash.keep_one(df.limit(0), 3, 3).count() == 0


def test_long_runs_go_on_by_blocks(spark, monkeypatch):
    """Runs over the limit are dealt anew, over several rounds, and lose no link."""
    monkeypatch.setattr(simhash, "RUN_ROWS", 3)
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fps = {base}
    while len(fps) < 60:  # one dense family, chains and strangers
        x = rnd.choice(sorted(fps))
        for _ in range(rnd.choice([1, 2, 3, 4, 9])):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    groups = {int(np.int64(r.fp).view(np.uint64)): r.root for r in simhash.fingerprint_groups(df, 3).collect()}
    want = plain_components(fps, 3)
    assert len(set(groups.values())) == len(set(want))
    assert all(groups[fps[i]] == groups[fps[w]] for i, w in enumerate(want))


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 202), (202, 200), (200, 201)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {201: 200, 202: 200}
