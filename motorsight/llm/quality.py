"""Quality rules with compression bands.

Text that repeats itself compresses far better than prose, and random or encoded text
far worse.  zstandard ratios (compressed / plain bytes) are taken over the whole document
and over fixed chunks of it; both must lie in a band, whose limits depend on the length,
since short texts compress badly and long ones well.  A document is rejected when its whole
ratio is out of its band, or when more than ``MAX_BAD_CHUNKS`` of its chunks are.

The upper limits lie between prose and incompressible text of the same length.  Prose of several
languages measured up to 0.87 at 192-256 bytes, 0.81 to 384, 0.76 to 512, 0.70 to 1 KB, 0.60 to 2 KB,
0.55 to 4 KB, 0.51 to 16 KB and 0.44 beyond; base64 and random words of letters and digits 0.82 and
more at 512 bytes, 0.77 at 1 KB, 0.75 at 2 KB and 0.73 from 8 KB.  Below 192 bytes the two nearly meet
(0.94 and 0.93), and below 64 bytes there is no upper limit.  The lower limits are wide: repeated words
measured 0.004-0.2.

Scale: row-wise, no shuffle; one document in memory at a time beside its Arrow batch.

Defined results: null and empty texts have no words, ratios of null, and fail the base rule;
repeated rows are judged row by row; an empty table gives no rows.  Only the id and text columns are
read, so other columns can't clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (bytes below, least ratio, largest ratio) for whole documents.
WHOLE_BANDS = ((64, 0.30, None), (128, 0.30, 1.0), (160, 0.30, 0.96), (192, 0.30, 0.945), (224, 0.30, 0.89), (256, 0.30, 0.85),
               (384, 0.30, 0.82), (512, 0.30, 0.79), (1024, 0.30, 0.74), (2048, 0.27, 0.68), (4096, 0.27, 0.65), (16384, 0.25, 0.62),
               (None, 0.20, 0.60))
CHUNK_BYTES = 4096
#: The last chunk joins the one before it when it is shorter than this.
LEAST_CHUNK = 1024
CHUNK_BAND = (0.22, 0.65)
MAX_BAD_CHUNKS = 0.25
LEVEL = 3

WINDOW = 8
LEAST_WORDS = 20
MAX_REPEAT_PERCENT = 30

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, whole_ratio double, "
          "n_chunks long, bad_chunks long, base_failed boolean, kept boolean")
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_ODD = np.int64(-7046029254386353131)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in some window of ``WINDOW`` words found twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), np.int64, n)
        m, width = _ODD, 1
        while width < WINDOW:
            h = h[:-width] * m + h[width:]
            m, width = m * m, 2 * width
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(h), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    # Equal hashes are confirmed on the words themselves.
    starts = np.flatnonzero(hit).tolist()
    seen = Counter(tuple(words[i: i + WINDOW]) for i in starts)
    edge = np.zeros(n + 1, np.int64)
    for i in starts:
        if seen[tuple(words[i: i + WINDOW])] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def in_band(ratio: float, low: float | None, high: float | None) -> bool:
    return (low is None or ratio >= low) and (high is None or ratio <= high)


def chunks(data: bytes) -> list[bytes]:
    cuts = list(range(0, len(data), CHUNK_BYTES))
    if len(cuts) > 1 and len(data) - cuts[-1] < LEAST_CHUNK:
        cuts.pop()
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]


def judge(text: str | None, press) -> tuple:
    """The row of ``FIELDS`` for one text; ``press`` compresses bytes."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    spaces = len(data) - len(data.translate(None, _SPACE))
    repeats = repeat_words(words)
    base_failed = len(words) < LEAST_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    whole, parts, bad, good = None, 0, 0, True
    if data:
        whole = len(press(data)) / len(data)
        _, low, high = next(b for b in WHOLE_BANDS if b[0] is None or len(data) < b[0])
        cut = chunks(data)
        parts = len(cut)
        if parts > 1:
            bad = sum(not in_band(len(press(c)) / len(c), *CHUNK_BAND) for c in cut)
        good = in_band(whole, low, high) and bad <= MAX_BAD_CHUNKS * parts
    return (len(words), len(text) - spaces, len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
            repeats, whole, parts, bad, base_failed, not base_failed and good)


def quality(text: Column | str) -> Column:
    """The struct of ``FIELDS`` for a text column."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def of(texts: pd.Series) -> pd.DataFrame:
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        return pd.DataFrame([judge(t, press) for t in texts], columns=names).astype({"whole_ratio": "float64"})

    return of(text)


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, quality(text_col).alias("q")).select(id_col, "q.*")
