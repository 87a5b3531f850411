"""Compression bands (op7) and three-line windows (op9) against plain versions."""

import base64
import random
import re
import string

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from motorsight.llm import linededup, quality, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


PRESS = zstandard.ZstdCompressor(level=quality.LEVEL).compress


@settings(max_examples=200, deadline=None)
@given(st.none() | st.text(alphabet="ab é中#$\n\t\x0b\x1c\xa0", max_size=200) | st.lists(st.sampled_from("abc"), max_size=80).map(" ".join))
def test_base_counts_equal_the_definition(text):
    row = quality.judge(text, PRESS)
    assert (*row[:5], row[8]) == plain_base(text)


def test_op7_equals_the_definition(spark):
    got = {r.doc_id: r for r in queries.op7_quality(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, data = got[d.doc_id], (d.text or "").encode()
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(d.text)
        low, high = next((a, b) for n, a, b in quality.WHOLE_BANDS if n is None or len(data) < n)
        ratio = len(PRESS(data)) / len(data) if data else None
        assert r.whole_ratio == ratio and (not r.base_failed or not r.kept)
        if ratio is not None and (ratio < low or (high and ratio > high)):
            assert not r.kept


def test_bands_reject_repetition_and_noise_and_keep_prose():
    rnd = random.Random(4)
    letters = "etaoinshrdlu"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    for n in (25, 100, 400, 3000, 20000):
        assert quality.judge(" ".join(rnd.choice(words) for _ in range(n)), PRESS)[9], n
    assert not quality.judge("one two three four five " * 100, PRESS)[9]
    noise = " ".join("".join(chr(rnd.randrange(33, 127)) for _ in range(60)) for _ in range(100))
    assert not quality.judge(noise, PRESS)[9]
    # Half prose, half one line over and over: found in the chunks.
    prose = " ".join(rnd.choice(words) for _ in range(4000))
    mixed = prose + "".join(f"\nrow {i % 3} is here" for i in range(2000))
    assert not quality.judge(mixed, PRESS)[9]


def test_bands_reject_encoded_text_of_any_length():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]

    def encoded(n, width=76):
        text = base64.b64encode(rnd.randbytes(n)).decode()
        return "\n".join(text[i: i + width] for i in range(0, n, width))[:n]

    def random_words(n):
        return " ".join("".join(rnd.choices(string.ascii_letters + string.digits, k=8)) for _ in range(n // 9 + 1))[:n]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n // 4))[:n]

    assert not any(quality.judge(encoded(n, 20), PRESS)[9] for n in (500, 1000))
    for n in (1600, 3000, 4096, 12000, 50000):
        row = quality.judge(encoded(n), PRESS)
        assert not row[8] and not row[9], n
    for n in (250, 500, 1000, 2000, 6000, 12000):
        row = quality.judge(random_words(n), PRESS)
        assert not row[8] and not row[9], n
    # Long documents that are partly base64: found in the chunks.
    for share in (0.3, 0.5):
        n = int(48000 * share)
        row = quality.judge(prose(48000 - n) + "\n" + encoded(n), PRESS)
        assert not row[8] and not row[9], share
    assert quality.judge(prose(48000), PRESS)[9]


def test_quality_edge_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "x"), (3, "word " * 60000)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n_words int, q string")
    got = quality.judge_documents(df).collect()
    assert len(got) == 5 and not any(r.kept for r in got)
    assert [r.whole_ratio for r in got if r.n_words == 0] == [None] * 3
    assert quality.judge_documents(df.limit(0)).count() == 0


def plain_lines(docs):
    """Texts after the method, document by document."""
    order = sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    windows = {}
    for d in order:
        lines = [(i, x.strip(" \t\r")) for i, x in enumerate(d[1].split("\n"))]
        lines = [x for x in lines if x[1]]
        for a, b, c in zip(lines, lines[1:], lines[2:]):
            windows.setdefault((a[1], b[1], c[1]), []).append((d, a[0], c[0]))
    gone = {}
    for places in windows.values():
        for d, a, b in places[1:]:
            gone.setdefault(d, set()).update(range(a, b + 1))
    return {d: ("\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in gone.get(d, ())), len(gone.get(d, ()))) for d in order}


def run_lines(spark, docs):
    df = spark.createDataFrame([(*d, "x", i) for i, d in enumerate(docs)], "doc_id long, text string, spans string, i int")
    out = linededup.dedup_lines(df, removed_col="gone")
    assert out.columns == [*df.columns, "gone"]
    return {r.i: (r.text, r.gone) for r in out.collect()}


def test_line_windows_on_random_documents(spark):
    rnd = random.Random(9)
    docs = [(i, "\n".join(rnd.choice(["a", "b", "c", " a ", "", "d\r"]) for _ in range(rnd.randint(0, 14)))) for i in range(150)]
    got, want = run_lines(spark, docs), plain_lines(docs)
    for i, d in enumerate(docs):
        assert got[i] == want[d]


def test_line_edge_rows(spark):
    text = "one\ntwo\nthree\n\nfour"
    docs = [(4, text), (2, text), (2, text), (None, text), (7, None), (8, ""), (9, "one\ntwo"), (10, "x\n" * 20 + "y"),
            (11, "intro\none\ntwo\nthree\n\nfour\nend\n")]
    got = run_lines(spark, docs)
    assert got[1] == got[2] == (text, 0)  # rows equal in id and text are one document
    assert got[0] == ("", 5) and got[3] == ("", 5)
    assert got[4] == (None, 0) and got[5] == ("", 0) and got[6] == ("one\ntwo", 0)
    assert got[7] == ("x\ny", 19) and got[8] == ("intro\nend\n", 5)
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
