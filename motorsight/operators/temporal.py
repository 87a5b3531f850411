"""Ordered per-machine features (W1-W17, W21) on skew-safe ordered frames.

All features of one call share ONE window spec (partition (key, _sub), order
_rn), so Spark sorts once and evaluates every frame in the same Window
operator.  Row frames, not range frames.  Cumulative features carry across
sub-ranges of hot keys through :func:`sequence.carry`.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .sequence import DEFAULT_CHUNK_ROWS, Ordered, carry, null_safe_join, ordered

ALL_GROUPS = ("rolling", "ema", "lag", "trend", "degradation")
UNB_P, UNB_F = Window.unboundedPreceding, Window.unboundedFollowing


def ema_frame(span: int, tol: float = 1e-16) -> int:
    """Rows of history after which an EMA weight drops below ``tol``."""
    alpha = 2.0 / (span + 1)
    return int(math.ceil(math.log(tol) / math.log(1.0 - alpha)))


def ema_reach(span: int, tol: float = 1e-13) -> int:
    """Rows of history after which any earlier value weighs below ``tol``, whichever of them have a reading.

    A reading g rows after the last one keeps (1 - alpha)^g / ((1 - alpha)^g + alpha) of the old value; the
    gap at which that decays least per row decides."""
    alpha = 2.0 / (span + 1)

    def decay(g: int) -> float:
        old = (1 - alpha) ** g
        return -math.log(old / (old + alpha)) / g

    return int(math.ceil(-math.log(tol) / min(map(decay, range(1, 4 * span + 2)))))


def ema_block(spans: list[int]) -> int:
    """Rows of a block: over so many rows the fastest EMA keeps 1e-100 of a value, so that dividing by what is kept stays exact."""
    return max(1, int(100 * math.log(10) / -math.log(1.0 - 2.0 / (min(spans) + 1))))


def ema(d: DataFrame, key: str, w, columns: list[str], spans: list[int]) -> DataFrame:
    """Add ``_e_<column>``, an array over ``spans`` of pandas ``ewm(span, adjust=False)``, null at rows without a reading.

    A reading maps the value before it to a * y + (1 - a) * x (the first reading: a = 0).  Inside a block of
    ``ema_block`` rows (``_blk``) the maps are composed by two growing frames: p, the product of a after the block's first
    reading, and s, the sum of (1 - a) * x / p, give p * (a of the first reading * y + s) for the value y before
    the block; x and y are taken relative to that first reading, which keeps their last digits.  Only the last rows of blocks are then composed through ``lag``, until what came before weighs nothing.
    ``w`` is ordered by (_blk, _rn), so that blocks and machines share one sort."""
    k, rows = len(spans), ema_block(spans)
    before, rn = w.rowsBetween(UNB_P, -1), F.col("_rn")
    d = d.select("*", *[(rn - F.last(F.when(F.col(c).isNotNull(), rn), ignorenulls=True).over(before)).cast("double").alias(f"_g_{c}") for c in columns])
    pairs = [(i, c, n) for i, (c, n) in enumerate((c, n) for c in columns for n in spans)]
    valid = {c: F.col(c).isNotNull() for c in columns}
    # The first reading of its block: the one before it, if any, lies in an earlier block.
    opens = {c: valid[c] & (F.col(f"_g_{c}").isNull() | (F.floor((rn - F.col(f"_g_{c}")) / rows) < F.col("_blk"))) for c in columns}
    keeps = []
    for _, c, n in pairs:
        alpha, g = 2.0 / (n + 1), F.col(f"_g_{c}")
        old = F.pow(F.lit(1.0 - alpha), g)
        keeps.append(F.when(~valid[c], 1.0).when(g.isNull(), 0.0).when(g == 1, F.lit(1.0 - alpha)).otherwise(old / (old + alpha)))
    d = d.select("*", F.array(*keeps).alias("_ema_a"), *[opens[c].alias(f"_o_{c}") for c in columns]).drop(*[f"_g_{c}" for c in columns])
    base = [c for c in d.columns if c not in {"_ema_a", *(f"_o_{c}" for c in columns)}]
    block = Window.partitionBy(key, "_sub", "_blk").orderBy("_rn").rowsBetween(UNB_P, 0)
    a = [F.get("_ema_a", F.lit(i)) for i, _, _ in pairs]
    first = [F.get(f"_f_{c}", F.lit(k)) for _, c, _ in pairs]

    def taken(i: int, c: str, n: int) -> Column:
        # Without a gap the doubles 1 - alpha and alpha, as pandas and the SQL have them; what they add up to beyond 1 counts too.
        alpha, dx = 2.0 / (n + 1), F.col(c).cast("double") - first[i]
        over = float(Fraction(1.0 - alpha) + Fraction(alpha) - 1)
        return F.when(a[i] == 1.0 - alpha, alpha * dx + over * first[i] if over else alpha * dx).otherwise((1.0 - a[i]) * dx)

    d = d.select("*", *[F.product(F.when(F.col(f"_o_{c}"), 1.0).otherwise(a[i])).over(block).alias(f"_p_{i}") for i, c, _ in pairs],
                 *[F.last(F.when(F.col(f"_o_{c}"), F.array(*a[j * k:(j + 1) * k], F.col(c).cast("double"))), ignorenulls=True).over(block).alias(f"_f_{c}")
                   for j, c in enumerate(columns)])
    d = d.select(*base, *[f"_p_{i}" for i, _, _ in pairs], *[f"_f_{c}" for c in columns],
                 *[F.sum(F.when(valid[c], taken(i, c, n) / F.col(f"_p_{i}"))).over(block).alias(f"_s_{i}") for i, c, n in pairs])
    d = d.select(*base, *[f"_f_{c}" for c in columns], F.array(*[F.coalesce(F.col(f"_p_{i}") * F.get(f"_f_{c}", F.lit(i % k)), F.lit(1.0)) for i, c, _ in pairs]).alias("_ema_a"),
                 F.array(*[F.coalesce(F.col(f"_p_{i}") * F.col(f"_s_{i}"), F.lit(0.0)) for i, c, _ in pairs]).alias("_ema_b"))
    ends = (rn + 1) % rows == 0
    own = F.array(*[F.get("_ema_b", F.lit(i)) + F.coalesce((1.0 - F.get("_ema_a", F.lit(i))) * first[i], F.lit(0.0)) for i, _, _ in pairs])
    d = d.select("*", F.when(ends, F.col("_ema_a")).alias("_end_a"), F.when(ends, own).alias("_end_b"))
    size, reach = 1, -(-max(map(ema_reach, spans)) // rows)
    one, none = (F.array(*[F.lit(v)] * len(pairs)) for v in (1.0, 0.0))
    while size < reach:
        steps = [(m, j) for m in ("_end_a", "_end_b") for j in (1, 2, 3)]
        d = d.select("*", *[F.lag(m, j * size * rows).over(w).alias(f"{m}{j}") for m, j in steps])
        d = d.withColumns({f"{m}{j}": F.when(ends, F.coalesce(f"{m}{j}", one if m == "_end_a" else none)) for m, j in steps})
        (a0, a1, a2, a3), (b0, b1, b2, b3) = ([F.col(f"{m}{j}") for j in ("", 1, 2, 3)] for m in ("_end_a", "_end_b"))
        d = d.withColumns({
            "_end_a": F.when(ends, F.array(*[a0[i] * a1[i] * a2[i] * a3[i] for i, _, _ in pairs])),
            "_end_b": F.when(ends, F.array(*[b0[i] + a0[i] * (b1[i] + a1[i] * (b2[i] + a2[i] * b3[i])) for i, _, _ in pairs]))})
        d = d.drop(*[f"{m}{j}" for m, j in steps])
        size *= 4
    d = d.select(*base, *[f"_f_{c}" for c in columns], "_ema_a", "_ema_b", F.last("_end_b", ignorenulls=True).over(w.rowsBetween(UNB_P, -1)).alias("_ema_y"))
    y = [first[i] + (F.get("_ema_b", F.lit(i)) + F.coalesce(F.get("_ema_a", F.lit(i)) * (F.get("_ema_y", F.lit(i)) - first[i]), F.lit(0.0))) for i, _, _ in pairs]
    return d.select(*base, *[F.when(valid[c], F.array(*y[j * k:(j + 1) * k])).alias(f"_e_{c}") for j, c in enumerate(columns)])


#: Runs that a rolling window is put together from, at most.
PARTS = 8
MOMENTS = ("n", "mean", "m2", "min", "max")


def rolling_steps(windows: list[int]) -> list[dict[int, list[tuple[int, int]]]]:
    """Window steps for ``rolling_moments``: for each size its parts (run length, rows back), made from
    single rows and the sizes of earlier steps (3 and 7 from rows; 14 = 7 + 7, 30 = 7 + 7 + 7 + 7 + 1 + 1)."""
    def parts(n: int, made: list[int]) -> list[tuple[int, int]]:
        out, back = [], 0
        for size in sorted(made, reverse=True):
            while n - back >= size:
                out.append((size, back))
                back += size
        return out

    steps: list[dict] = [{}]
    made = [1]
    for n in sorted(set(windows)):
        while len(parts(n, made)) > PARTS:
            if not steps[-1]:
                if PARTS * max(made) >= n:
                    break
                steps[-1][PARTS * max(made)] = parts(PARTS * max(made), made)
            made += steps[-1]
            steps.append({})
        steps[-1][n] = parts(n, made)
    return steps


def _run(size: int, back: int) -> str:
    return ("_v" if size == 1 else f"_m_{size}") + (f"_{back}" if back else "")


def rolling_lags(w, step: dict) -> dict[str, Column]:
    """The runs of rows before the current one that a step of ``rolling_steps`` needs."""
    return {_run(*p): F.lag(_run(p[0], 0), p[1]).over(w) for ps in step.values() for p in ps if p[1]}


def rolling_moments(d: DataFrame, width: int, step: dict) -> DataFrame:
    """Add ``_m_<size>``, an array of the moments (count, mean, sum of squared deviations, min and max) of the last rows for each
    of the ``width`` columns of ``_v``.  A sliding frame would be aggregated anew for every row.  Mean first, then
    the deviations from it.  Arrays, since a row is copied at every step, field by field."""
    def at(part: tuple[int, int], i: int, moment: str) -> Column:
        name = _run(*part)
        if part[0] > 1:
            return F.get(name, F.lit(len(MOMENTS) * i + MOMENTS.index(moment)))
        x = F.get(name, F.lit(i))
        return F.when(x.isNotNull(), 1.0 if moment == "n" else 0.0) if moment in ("n", "m2") else x

    def total(terms: list[Column]) -> Column:
        out = F.lit(0.0)
        for t in terms:
            out = out + F.coalesce(t, F.lit(0.0))
        return out

    means = {}
    for size, ps in step.items():
        ns = [total([at(p, i, "n") for p in ps]) for i in range(width)]
        # Relative to one of the means, so that equal readings have their own value as mean.
        near = [F.coalesce(*[at(p, i, "mean") for p in ps]) for i in range(width)]
        mean = [near[i] + total([at(p, i, "n") * (at(p, i, "mean") - near[i]) for p in ps]) / F.when(ns[i] > 0, ns[i]) for i in range(width)]
        means[f"_n_{size}"] = F.array(*ns, *mean)
    d = d.select("*", *[v.alias(k) for k, v in means.items()])
    out = {}
    for size, ps in step.items():
        fields = []
        for i in range(width):
            n, mean = (F.get(f"_n_{size}", F.lit(j)) for j in (i, width + i))
            off = [at(p, i, "mean") - mean for p in ps]
            m2 = total([at(p, i, "m2") + at(p, i, "n") * off[j] * off[j] for j, p in enumerate(ps)])
            low, high = ([at(p, i, m) for p in ps] for m in ("min", "max"))
            fields += [n, mean, m2, F.least(*low) if len(ps) > 1 else low[0], F.greatest(*high) if len(ps) > 1 else high[0]]
        out[f"_m_{size}"] = F.array(*fields)
    return d.select("*", *[v.alias(k) for k, v in out.items()]).drop(*means, *[_run(*p) for ps in step.values() for p in ps if p[1]])


def trend_features(i: int) -> list[Column]:
    """Rate of change, difference, acceleration and slope over ``TREND_WINDOW`` rows of column ``i`` of ``_v``."""
    x, *past = [F.get(_run(1, j), F.lit(i)) for j in range(max(fv.TREND_WINDOW, 3))]
    l1, l2 = past[:2]
    xs = [x, *past][:fv.TREND_WINDOW]
    near = F.coalesce(*xs)
    # Positions count from the current row: the slope does not depend on where they start.
    n = st = stt = sx = stx = F.lit(0.0)
    for j, v in enumerate(xs):
        there, dx = v.isNotNull(), F.coalesce(v - near, F.lit(0.0))
        n, sx, stx = n + F.when(there, 1.0).otherwise(0.0), sx + dx, stx - dx * float(j)
        st, stt = st - F.when(there, float(j)).otherwise(0.0), stt + F.when(there, float(j * j)).otherwise(0.0)
    return [F.coalesce(F.when(l1 != 0, x / l1 - F.lit(1.0)), F.lit(0.0)),
            F.coalesce(x - l1, F.lit(0.0)),
            F.coalesce((x - l1) - (l1 - l2), F.lit(0.0)),
            F.coalesce(F.when(n > 1, (n * stx - st * sx) / (n * stt - st * st)), F.lit(0.0))]


def required_halo(groups, windows, lags) -> int:
    h = 0
    if "ema" in groups:
        h = max(h, *map(ema_reach, windows))
    if "rolling" in groups:
        h = max(h, max(windows) - 1)
    if "lag" in groups:
        h = max(h, max(lags))
    if "trend" in groups:
        h = max(h, fv.TREND_WINDOW - 1, 2)
    if "degradation" in groups:
        h = max(h, fv.BASELINE_WINDOW - 1)
    return h


def ordered_features(df: DataFrame, key: str, order: list[str], columns: list[str], *,
                     groups=ALL_GROUPS, windows=None, lags=None, failure_col: str | None = None,
                     fill_columns: list[str] = (), ffill_columns: list[str] = (), keep_rn: bool = False,
                     chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """The ordered feature set for explicit base ``columns`` in one pass.

    Per column: rolling mean/std/min/max and EMA for each window (W1-W5), lags
    with back-fill then 0 (W6), rate of change, difference, acceleration and
    7-row trend slope (W7-W10), deviation from the 30-row baseline, its
    cumulative sum and the absolute level (W11-W13).  ``fill_columns`` get
    forward-then-back fill (W14).  With ``failure_col``: cycles to the next
    failure (W15), to the last failure (W16) and within-horizon flags (W17).
    Only the new columns are filled (D13); the rolling std of a machine's
    first row stays NULL.
    """
    windows = list(windows or fv.ROLLING_WINDOWS)
    lags = list(lags or fv.LAGS)
    groups = set(groups)
    halo = required_halo(groups, windows, lags)
    o = ordered(df, key, order, halo, chunk_rows)
    d = o.df
    w = o.w
    rn = F.col("_rn")
    if "ema" in groups and columns:
        d = d.withColumn("_blk", F.floor(rn / ema_block(windows)))
        w = Window.partitionBy(key, "_sub").orderBy("_blk", "_rn")
    whole = w.rowsBetween(UNB_P, 0)
    width = len(columns)
    specs: dict[str, tuple] = {}

    # Reverse pass: next non-null value / next failure at or after each row, as a
    # growing frame over the descending order of the same partition.
    rev = Window.partitionBy(key, "_sub").orderBy(F.col("_rn").desc()).rowsBetween(UNB_P, 0)
    need_nn = {*fill_columns, *(columns if "lag" in groups else ())}
    rev_cols = {f"_{c}_nn": F.last(F.col(c), ignorenulls=True).over(rev) for c in sorted(need_nn)}
    if "lag" in groups:
        rev_cols |= {f"_{c}_nnpos": F.last(F.when(F.col(c).isNotNull(), rn), ignorenulls=True).over(rev) for c in columns}
    if failure_col:
        f = F.col(failure_col)
        rev_cols["_next_fail"] = F.min(F.when(f == 1, rn)).over(rev)
        specs["__next_fail"] = (F.min(F.when(f == 1, rn)), "min_after", None)
        specs["__last_fail"] = (F.max(F.when(f == 1, rn)), "key", "max")
    if rev_cols:
        d = d.select("*", *[v.alias(k) for k, v in rev_cols.items()])
    if "lag" in groups and columns:
        d = d.withColumn("_nn", F.array(*[F.col(f"_{c}_{x}").cast("double") for x in ("nn", "nnpos") for c in columns]))
        d = d.drop(*[f"_{c}_nn" for c in columns if c not in fill_columns], *[f"_{c}_nnpos" for c in columns])

    # Every step adds arrays over the columns and drops what it no longer needs: rows are copied at each step.  EMA, the most
    # steps, while rows are short.
    if "ema" in groups and columns:
        d = ema(d, key, w, list(columns), windows)
    d = d.withColumn("_v", F.array(*[F.col(c).cast("double") for c in columns])) if columns else d
    steps = rolling_steps(windows) if "rolling" in groups and columns else [{}]
    past = rolling_lags(w, steps[0])
    if "trend" in groups and columns:
        past |= {_run(1, j): F.lag("_v", j).over(w) for j in range(1, max(fv.TREND_WINDOW, 3))}
    d = d.select("*", *[v.alias(k) for k, v in past.items()])
    if "trend" in groups and columns:
        d = d.withColumn("_trend", F.array(*[v for i in range(width) for v in trend_features(i)]))
    for i, step in enumerate(steps):
        if step:
            if i:
                d = d.select("*", *[v.alias(k) for k, v in rolling_lags(w, step).items()])
            d = rolling_moments(d, width, step)
    d = d.drop(*past)

    finals: dict[str, Column] = {}
    phase_a: dict[str, Column] = {}

    def moment(i: int, n: int, name: str) -> Column:
        return F.get(f"_m_{n}", F.lit(len(MOMENTS) * i + MOMENTS.index(name)))

    for i, c in enumerate(columns):
        x = F.col(c)
        if "rolling" in groups:
            for n in windows:
                finals[f"{c}_rolling_mean_{n}"] = moment(i, n, "mean")
                many = moment(i, n, "n")
                finals[f"{c}_rolling_std_{n}"] = F.when(many > 1, F.sqrt(moment(i, n, "m2") / (many - 1)))
                finals[f"{c}_rolling_min_{n}"], finals[f"{c}_rolling_max_{n}"] = moment(i, n, "min"), moment(i, n, "max")
        if "ema" in groups:  # rows without a reading repeat the last value
            y = F.col(f"_e_{c}")
            phase_a[f"_y_{c}"] = F.last(y, ignorenulls=True).over(whole)
            specs[f"{c}_ema"] = (F.max_by(y, F.when(y.isNotNull(), rn)), "last_before", None)
        if "lag" in groups:
            specs[f"{c}__first"] = (F.min_by(x, F.when(x.isNotNull(), rn)), "first_after", None)
            specs[f"{c}__firstpos"] = (F.min(F.when(x.isNotNull(), rn)), "min_after", None)
            specs["__len"] = (F.max(rn), "key", "max")
        if "trend" in groups:
            for j, name in enumerate(("rate_of_change", "diff", "acceleration", "trend_7")):
                finals[f"{c}_{name}"] = F.get("_trend", F.lit(4 * i + j))
        if "degradation" in groups:
            finals[f"{c}_abs_deviation"] = F.abs(x)
    if "lag" in groups and columns:
        # Next readings at or after the row k back; rows k or fewer from the machine's start look back past it: its first.
        phase_a |= {f"_nn_{k}": F.coalesce(F.lag("_nn", k).over(w), F.first("_nn").over(whole)) for k in lags}
    for c in [*fill_columns, *ffill_columns]:
        x = F.col(c)
        phase_a[f"_{c}_ffill"] = F.last(x, ignorenulls=True).over(whole)
        specs[f"{c}__last"] = (F.max_by(x, F.when(x.isNotNull(), rn)), "last_before", None)
    for c in fill_columns:
        specs[f"{c}__first"] = (F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rn)), "first_after", None)
        phase_a[f"_{c}_bfill"] = F.col(f"_{c}_nn")
    if "degradation" in groups:
        devs = {}
        for i, c in enumerate(columns):
            if "rolling" in groups and fv.BASELINE_WINDOW in windows:
                devs[f"_{c}_dev"] = F.col(c) - moment(i, fv.BASELINE_WINDOW, "mean")
            else:
                devs[f"_{c}_dev"] = F.col(c) - F.avg(F.col(c)).over(w.rowsBetween(-(fv.BASELINE_WINDOW - 1), 0))
            specs[f"{c}__dev"] = (F.sum(F.col(f"_{c}_dev")), "sum_before", None)
            phase_a[f"_{c}_cumdev"] = F.sum(F.when(~F.col("_halo"), F.col(f"_{c}_dev"))).over(whole)
        d = d.select("*", *[v.alias(k) for k, v in devs.items()])
    # The last forward pass: what is left of the spec w in a single Window operator.
    d = d.select("*", *[v.alias(k) for k, v in phase_a.items()])
    d = carry(o, d, specs)

    # Phase B: final expressions.
    out: dict[str, Column] = dict(finals)
    for i, c in enumerate(columns):
        if "lag" in groups:
            for k in lags:
                # Lag k, back-filled: the next non-null reading at p >= r - k (at p = r - k it is lag k itself), which
                # lag k carries only if p <= L - k (L = rows of the machine); otherwise the gap stays 0.
                last_src = F.col("_c___len") - k
                value, pos = (F.get(f"_nn_{k}", F.lit(j)) for j in (i, width + i))
                carried = F.when(F.col(f"_c_{c}__firstpos") <= last_src, F.col(f"_c_{c}__first").cast("double"))
                fill = F.when(pos.isNotNull(), F.when(pos <= last_src, value)).otherwise(carried)
                out[f"{c}_lag_{k}"] = F.coalesce(fill, F.lit(0.0))
        if "degradation" in groups:
            out[f"{c}_deviation_from_baseline"] = F.col(f"_{c}_dev")
            here, before = F.col(f"_{c}_cumdev"), F.col(f"_c_{c}__dev")
            out[f"{c}_cumulative_deviation"] = F.when(
                here.isNotNull() | before.isNotNull(), F.coalesce(here, F.lit(0.0)) + F.coalesce(before, F.lit(0.0)))
        if "ema" in groups:
            # Without split keys nothing is carried, so that the plan needs no choice for every value.
            y = F.coalesce(F.col(f"_y_{c}"), F.col(f"_c_{c}_ema").cast("array<double>")) if o.split else F.col(f"_y_{c}")
            for i, n in enumerate(windows):
                out[f"{c}_ema_{n}"] = F.get(y, F.lit(i))
    for c in fill_columns:
        out[f"{c}_filled"] = F.coalesce(F.col(c), F.col(f"_{c}_ffill"), F.col(f"_c_{c}__last"),
                                        F.col(f"_{c}_bfill"), F.col(f"_c_{c}__first"))
    for c in ffill_columns:
        out[f"{c}_ffill"] = F.coalesce(F.col(c), F.col(f"_{c}_ffill"), F.col(f"_c_{c}__last"))
    if failure_col:
        nxt = F.coalesce(F.col("_next_fail"), F.col("_c___next_fail"))
        ctf = F.coalesce(nxt - rn, F.lit(0)).cast("int")
        out["cycles_to_failure"] = ctf
        out["cycles_to_last_failure"] = F.coalesce(F.greatest(F.col("_c___last_fail") - rn, F.lit(0)),
                                                   F.lit(0)).cast("int")
        for h in fv.FAILURE_HORIZONS:
            out[f"failure_within_{h}d"] = ((ctf > 0) & (ctf <= h)).cast("int")
    base_cols = list(df.columns)
    extra = ["_rn"] if keep_rn else []
    res = d.select(*base_cols, *extra, "_halo", *[v.alias(k) for k, v in out.items()])
    res = res.filter(~F.col("_halo")).drop("_halo")
    if keep_rn:
        res = res.withColumnRenamed("_rn", "rn")
    return res


def row_index(df: DataFrame, key: str, order: list[str], *, chunk_rows: int = DEFAULT_CHUNK_ROWS,
              with_count: bool = False) -> DataFrame:
    """1-based position ``rn`` inside the key (and ``n`` rows of the key)."""
    o = ordered(df, key, order, 0, chunk_rows)
    d = o.body().withColumnRenamed("_rn", "rn").drop("_halo")
    if with_count:
        if o.split:
            cnt = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            d = null_safe_join(d, cnt, [key])
        else:
            d = d.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key, "_sub")))
    return d.drop("_sub", "_hot")
