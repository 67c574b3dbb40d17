"""Validation work on bars and account returns: tests, folds, sweeps, costs."""

from __future__ import annotations

import bisect
import functools
import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.compare import real_deviation, safe_divide
from tickloom.operators.indicators import with_crosses, with_smas
from tickloom.operators.positions import ADDED, MOST_BESIDE, Account, with_equity, with_fills, with_position, with_returns
from tickloom.operators.rules import resolve, series_as_rows, signal_flags, tags_of
from tickloom.plans.layout import Layout, spread_over
from tickloom.session import settle

P_BUCKETS = 10_000


# ---- many tests -------------------------------------------------------------


def multiple_test_adjust(tests: DataFrame, p: str = "p_value", family: Sequence[str] = ()) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg p-values within a family of tests.

    Equal p-values are counted once, and the distinct ones are ranked inside
    buckets of the p scale, so a family of any size is never sorted in one task.
    """
    family = list(family)
    counts = tests.groupBy(*family, p).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_bucket", F.floor(F.col(p) * P_BUCKETS)
    )
    inside = Window.partitionBy(*family, "_bucket").orderBy(p)
    along = Window.partitionBy(*family).orderBy("_bucket")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.groupBy(*family, "_bucket").agg(F.sum("_n").alias("_m")).select(
        *family, "_bucket", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"),
        F.sum("_m").over(whole).alias("n_tests"),
    )
    ranked = counts.join(starts, [*family, "_bucket"]).withColumn(
        "_raw", F.col(p) * F.col("n_tests") / (F.col("_start") + F.sum("_n").over(inside))
    )
    later = ranked.groupBy(*family, "_bucket").agg(F.min("_raw").alias("_low")).select(
        *family, "_bucket",
        F.min("_low").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    adjusted = ranked.join(later, [*family, "_bucket"]).select(
        *family, p, "n_tests",
        F.least(F.lit(1.0), F.col(p) * F.col("n_tests")).alias("p_bonferroni"),
        F.least(
            F.lit(1.0), F.min("_raw").over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("_later")
        ).alias("p_bh"),
    )
    return tests.join(adjusted, [*family, p])


# ---- folds ------------------------------------------------------------------


def walk_forward_span(bars: DataFrame, train_months: int, test_months: int) -> tuple[str, int]:
    """First month of the bars and the number of folds after which every month has been in one."""
    first, last = bars.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return "1970-01-01", 1
    months = (last.year - first.year) * 12 + last.month - first.month + 1
    return f"{first:%Y-%m}-01", max(1, math.ceil((months - train_months) / test_months))


def walk_forward_split(bars: DataFrame, start: str, folds: int, train_months: int, test_months: int) -> DataFrame:
    """Each bar with the folds it trains or tests.

    Fold k trains ``train_months`` from start + k * test_months on and tests
    the months after.  Fold numbers follow from the month by arithmetic, so a
    bar is copied to its folds without a join.
    """
    month = F.months_between(F.trunc(F.col("ts").cast("date"), "MM"), F.lit(start).cast("date")).cast("int")
    earliest = F.greatest(F.floor((F.col("_month") - train_months - test_months) / test_months) + 1, F.lit(0))
    latest = F.least(F.floor(F.col("_month") / test_months), F.lit(folds - 1))
    placed = (
        bars.withColumn("_month", month).filter((F.col("_month") >= 0) & (earliest <= latest))
        .withColumn("fold", F.explode(F.sequence(earliest, latest)))
    )
    trains = F.col("_month") - F.col("fold") * test_months < train_months
    return placed.withColumn("part", F.when(trains, "train").otherwise("test")).drop("_month")


def slice_statistics(returns: DataFrame, keys: Sequence[str], start: str, months: int, value: str = "ret") -> DataFrame:
    """Per key and run of ``months`` from ``start`` on: what returns of any run of slices can be judged by.

    Bars, log return, sum and sum of squares add up over slices, so training
    and test spans are put together from slices and bars are read once.
    """
    month = F.months_between(F.trunc(F.col("ts").cast("date"), "MM"), F.lit(start).cast("date")).cast("int")
    known = returns.filter(F.col(value).isNotNull()).withColumn("slice", F.floor(month / months).cast("int"))
    return known.filter("slice >= 0").groupBy(*keys, "slice").agg(
        F.count(F.lit(1)).alias("bars"), F.sum(F.log1p(value)).alias("log_return"),
        F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"),
    )


def walk_forward_selection(slices: DataFrame, key: Sequence[str], variant: Sequence[str], folds: int, train: int, test: int,
                           per_year: int = 252) -> DataFrame:
    """Per key and fold the variant with the best training return, and how it did on the slices after.

    Fold k trains on ``train`` slices from k * ``test`` on and tests on the
    ``test`` slices that follow.  Equal returns (to nine places) go to the
    first variant by its parameters; folds without training bars are left out,
    folds without test bars have NULL there.  What is copied to folds is the
    summaries, never the bars.
    """
    place = F.col("slice")
    earliest = F.greatest(F.floor((place - train - test) / test) + 1, F.lit(0))
    latest = F.least(F.floor(place / test), F.lit(folds - 1))
    placed = slices.filter(earliest <= latest).withColumn("fold", F.explode(F.sequence(earliest.cast("int"), latest.cast("int"))))
    trains = place - F.col("fold") * test < train
    sums = {f"{part}_{c}": F.sum(F.when(trains if part == "train" else ~trains, F.col(c)))
            for part in ("train", "test") for c in ("bars", "log_return", "total", "squares")}
    scored = placed.groupBy(*key, *variant, "fold").agg(*[c.alias(n) for n, c in sums.items()]).filter("train_bars > 0")
    order = F.struct((-F.round("train_log_return", 9)).alias("_return"), *variant)
    taken = [*variant, *sums]
    best = scored.groupBy(*key, "fold").agg(F.min_by(F.struct(*taken), order).alias("_best")).select(*key, "fold", "_best.*")
    mean = F.col("test_total") / F.col("test_bars")
    square = F.col("test_squares") / F.col("test_bars")
    variance = square - mean * mean
    sharpe = F.when(variance > 1e-12 * square, mean / F.sqrt(variance) * math.sqrt(per_year))
    return best.select(
        *key, "fold", *variant, "train_bars", F.col("train_log_return").alias("train_return"),
        "test_bars", F.col("test_log_return").alias("test_return"), sharpe.alias("test_sharpe"),
    )


def walk_forward_summary(selected: DataFrame, key: Sequence[str], variant: Sequence[str]) -> DataFrame:
    """Per key: folds with test bars, log return over all tests, share of tests that gained, variants taken."""
    return selected.filter("test_bars > 0").groupBy(*key).agg(
        F.count(F.lit(1)).alias("folds"), F.sum("test_return").alias("test_return"),
        F.avg(F.when(F.col("test_return") > 0, 1.0).otherwise(0.0)).alias("gained"),
        F.count_distinct(F.struct(*variant)).alias("variants"),
    )


def cross_validation_folds(df: DataFrame, lay: Layout, folds: int) -> DataFrame:
    """Contiguous, near-equal runs of bars per key, numbered 1..folds; early folds take the rest."""
    if lay.chunked:
        sizes = df.filter("own").groupBy(*lay.keys).agg(F.max("bar_no").alias("_n"))
        df = df.join(sizes, list(lay.keys))
    else:
        df = df.withColumn("_n", F.max("bar_no").over(lay.everything()))
    small = F.floor(F.col("_n") / folds)
    large = F.col("_n") - small * folds          # folds with one bar more
    border = large * (small + 1)
    index = F.col("bar_no") - 1
    fold = F.when(index < border, F.floor(index / (small + 1))).otherwise(
        large + F.floor((index - border) / F.greatest(small, F.lit(1)))
    )
    return df.withColumn("fold", fold + 1).drop("_n")


# ---- parameter sweep --------------------------------------------------------


def sma_cross_sweep(df: DataFrame, lay: Layout, fast: Sequence[int], slow: Sequence[int],
                    account: Account = Account()) -> tuple[DataFrame, Layout]:
    """Account returns of the mean-cross rule for every (fast, slow) pair.

    All means come from one pass over the bars; pairs become rows afterwards.
    """
    pairs = [(f, s) for f, s in itertools.product(fast, slow) if f < s]
    df = with_smas(with_fills(df, lay, account), lay, *sorted({*fast, *slow}))
    kept = ["symbol", "ts", "bar_no", "close", "buy_fill", "sell_fill", "next_ts", *(["chunk", "own"] if lay.chunked else [])]
    df = with_crosses(df, lay, {f"x_{f}_{s}": F.col(f"sma{f}") - F.col(f"sma{s}") for f, s in pairs}, kept)
    flags = [
        [F.coalesce(F.col(f"x_{f}_{s}") == side, F.lit(False)).alias(name) for name, side in (("entry", 1), ("exit", -1))] for f, s in pairs
    ]
    if 1 < len(pairs) <= MOST_BESIDE:
        tags = tags_of(pairs)
        df = df.select(*kept, *[flag.alias(f"{name}{t}") for t, both in zip(tags, flags, strict=True) for name, flag in zip(("entry", "exit"), both, strict=True)])
        df = with_equity(with_position(df, lay, account, tags), lay, account, tags)
        labels = {"fast": [f for f, _ in pairs], "slow": [s for _, s in pairs]}
        return series_as_rows(with_returns(df, lay, account, tags), ADDED, labels), lay.per("fast", "slow")
    rows = F.array(*[F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), *both) for (f, s), both in zip(pairs, flags, strict=True)])
    lay = lay.per("fast", "slow")
    long = df.select(*kept, F.inline(rows))
    return with_returns(with_equity(with_position(long, lay, account), lay, account), lay, account), lay


def best_parameters(df: DataFrame, account: Account = Account()) -> DataFrame:
    """Per symbol the pair with the highest total return (ties: the smaller pair)."""
    totals = df.groupBy("symbol", "fast", "slow").agg(
        F.log(F.max_by("equity", "bar_no") / account.capital).alias("total_return")
    )
    rank = F.struct(F.round("total_return", 9).alias("r"), -F.col("fast"), -F.col("slow"))
    return totals.groupBy("symbol").agg(
        F.max_by("fast", rank).alias("fast"), F.max_by("slow", rank).alias("slow"),
        F.max("total_return").alias("total_return"),
    )


# ---- cost stress ------------------------------------------------------------


@dataclass(frozen=True)
class CostVariant:
    """Fees of a stress run; an order gets the open ``delay`` bars later."""

    name: str
    commission: float
    slippage: float
    delay: int = 1


def cost_stress(df: DataFrame, lay: Layout, strategy: str, variants: Sequence[CostVariant],
                account: Account = Account()) -> tuple[DataFrame, Layout]:
    """Account returns of one rule under every variant; bars and indicators are computed once."""
    (name,) = resolve(strategy)
    entry, leave = signal_flags(name)
    window = lay.window()
    late = max(v.delay for v in variants)
    lay.reach(f"a fill {late} bars later", ahead=late)

    def variant(v: CostVariant) -> Column:
        ahead = {c: F.lead(c, v.delay).over(window) for c in ("open", "high", "low", "ts", "close")}
        known = ahead["open"].isNotNull()
        return F.struct(
            F.lit(v.name).alias("variant"), F.lit(v.commission).alias("commission"),
            F.when(known, F.least(ahead["high"], ahead["open"] * (1 + v.slippage))).alias("buy_fill"),
            F.when(known, F.greatest(ahead["low"], ahead["open"] * (1 - v.slippage))).alias("sell_fill"),
            ahead["ts"].alias("next_ts"), ahead["close"].alias("next_close"),
        )

    kept = ["symbol", "ts", "bar_no", "close", *(["chunk", "own"] if lay.chunked else [])]
    long = df.select(
        *kept, entry.alias("entry"), leave.alias("exit"), F.array(*[variant(v) for v in variants]).alias("_variants")
    ).select(*kept, "entry", "exit", F.inline("_variants"))
    if lay.spread:
        long = spread_over(long, *lay.keys, "variant")
    lay = lay.per("variant")
    account = Account(account.capital, F.col("commission"), account.slippage, account.stake)
    return with_returns(with_equity(with_position(long, lay, account), lay, account), lay, account), lay


# ---- comparison -------------------------------------------------------------


def correlation(a: Column, b: Column) -> Column:
    """Over rows that have both; NULL, not an error, where one of them never moves."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = [real_deviation(F.stddev_pop(x), F.avg(F.abs(x))) for x in (a, b)]
    return F.try_divide(F.covar_pop(a, b), spread[0] * spread[1])


def benchmark_compare(returns: DataFrame, benchmark: DataFrame, per_year: int = 252) -> DataFrame:
    """Excess return, tracking error, information ratio and correlation per symbol.

    ``benchmark`` holds one ``bench_ret`` per ts; both sides meet on ts.
    """
    both = returns.join(benchmark, "ts").withColumn("_excess", F.col("bar_ret") - F.col("bench_ret"))
    table = both.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg("_excess") * per_year).alias("excess_return"),
        (F.stddev_samp("_excess") * math.sqrt(per_year)).alias("tracking_error"),
        correlation(F.col("bar_ret"), F.col("bench_ret")).alias("correlation"),
        (F.avg(F.abs("_excess")) * math.sqrt(per_year)).alias("_size"),
    )
    risk = real_deviation(F.col("tracking_error"), F.col("_size"))
    return table.withColumn("information_ratio", safe_divide(F.col("excess_return"), risk)).drop("_size")


def factor_regression(returns: DataFrame, factors: DataFrame, names: Sequence[str], keys: Sequence[str] = ("symbol",),
                      value: str = "bar_ret") -> DataFrame:
    """Per key: n, alpha, a beta per factor and R2 of ``value`` on the factors of the same ts.

    Means and covariances merge over tasks; the normal equations are solved
    by Cholesky in columns, so no bars are gathered.  Factors that do not move
    on their own within a key leave all coefficients NULL, and so do fewer
    rows than coefficients.
    """
    wanted = [value, *names]
    both = returns.join(factors.select("ts", *names), "ts").dropna(subset=wanted)
    terms = {"n": F.count(F.lit(1)), **{f"_mean_{x}": F.avg(x) for x in wanted}}
    terms |= {f"_{a}~{b}": F.covar_pop(a, b) for i, a in enumerate(wanted) for b in wanted[i:]}
    table = both.groupBy(*keys).agg(*[c.alias(n) for n, c in terms.items()])

    def cov(a: str, b: str) -> Column:
        first, second = sorted((a, b), key=wanted.index)
        return F.col(f"`_{first}~{second}`")

    # lower triangle L with L L' = covariances of the factors, then two substitutions
    steps: dict[str, Column] = {}
    for j, b in enumerate(names):
        rest = cov(b, b)
        for k in range(j):
            rest = rest - F.col(f"_l{j}_{k}") * F.col(f"_l{j}_{k}")
        steps[f"_l{j}_{j}"] = F.when((rest > 1e-10 * cov(b, b)) & (F.col("n") > len(names)), F.sqrt(rest))
        for i in range(j + 1, len(names)):
            rest = cov(names[i], b)
            for k in range(j):
                rest = rest - F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}")
            steps[f"_l{i}_{j}"] = rest / F.col(f"_l{j}_{j}")
    for i, a in enumerate(names):
        rest = cov(value, a)
        for k in range(i):
            rest = rest - F.col(f"_l{i}_{k}") * F.col(f"_z{k}")
        steps[f"_z{i}"] = rest / F.col(f"_l{i}_{i}")
    for i in reversed(range(len(names))):
        rest = F.col(f"_z{i}")
        for k in range(i + 1, len(names)):
            rest = rest - F.col(f"_l{k}_{i}") * F.col(f"beta_{names[k]}")
        steps[f"beta_{names[i]}"] = rest / F.col(f"_l{i}_{i}")
    for name, column in steps.items():
        table = table.withColumn(name, column)
    betas = [f"beta_{x}" for x in names]
    alpha = F.col(f"_mean_{value}")
    explained = F.lit(0.0)
    for x in names:
        alpha = alpha - F.col(f"beta_{x}") * F.col(f"_mean_{x}")
        explained = explained + F.col(f"beta_{x}") * cov(value, x)
    return table.select(*keys, "n", alpha.alias("alpha"), *betas, F.try_divide(explained, cov(value, value)).alias("r2"))


def market_returns(returns: DataFrame) -> DataFrame:
    """Equal-weighted mean return of all symbols per ts."""
    return returns.filter("bar_ret is not null").groupBy("ts").agg(F.avg("bar_ret").alias("bench_ret"))


_MOMENTS = ("n", "mean_a", "mean_b", "square_a", "square_b", "product", "size_a", "size_b", "nans", "infinite")


def _pair_moments(values: np.ndarray, here: np.ndarray) -> np.ndarray:
    """``_MOMENTS`` of every two columns over the rows that have both: squares and products about the pair's own means."""
    nan, infinite = here & np.isnan(values), here & np.isinf(values)
    values = np.where(here & np.isfinite(values), values, 0.0)
    h = here.astype(float)
    n = h.T @ h
    rows = np.maximum(n, 1.0)
    centre = values.sum(0) / np.maximum(h.sum(0), 1.0)
    moved = (values - centre) * h
    total = moved.T @ h
    square = (moved**2).T @ h - total**2 / rows
    mean, size = centre[:, None] + total / rows, np.abs(values).T @ h
    odd = [x.astype(float).T @ h for x in (nan, infinite)]
    return np.stack([n, mean, mean.T, square, square.T, moved.T @ moved - total * total.T / rows, size, size.T, *(x + x.T for x in odd)])


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Moments of two lots of rows together."""
    both, rows = x + y, np.maximum(x[0] + y[0], 1.0)
    share, gap = y[0] / rows, y[1:3] - x[1:3]
    both[1:3] = x[1:3] + gap * share
    both[3:5] += gap**2 * x[0] * share
    both[5] += gap[0] * gap[1] * x[0] * share
    return both


def correlation_matrix(long: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Correlation of every pair of ``names``, over rows that share ``keys``.

    The names become columns (their number is the caller's literal list).  A
    task sums up its rows as matrices of names by names and hands on a row per
    pair, so no row is joined with another and no pair is an aggregate of its own.
    """
    names = list(names)
    wide = long.groupBy(*keys).pivot(name, names).agg(F.first(value))
    first, second = np.triu_indices(len(names), 1)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            here = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            part = _pair_moments(values, here)
            found = part if found is None else _joined(found, part)
        if found is not None:
            pairs = {"a": pa.array([names[i] for i in first]), "b": pa.array([names[j] for j in second])}
            yield pa.RecordBatch.from_pydict({**pairs, **{m: pa.array(found[k, first, second]) for k, m in enumerate(_MOMENTS)}})

    schema = "a string, b string, " + ", ".join(f"{m} double" for m in _MOMENTS)
    parts = wide.select(*[F.col(f"`{n}`").cast("double") for n in names]).mapInArrow(moments, schema).filter("n > 0")
    pair = Window.partitionBy("a", "b")
    parts = parts.withColumns({f"_{c}": F.col(f"mean_{c}") - F.sum(F.col("n") * F.col(f"mean_{c}")).over(pair) / F.sum("n").over(pair) for c in "ab"})
    n, off = F.col("n"), {c: F.col(f"_{c}") for c in "ab"}
    total = parts.groupBy("a", "b").agg(
        *[F.sum(F.col(f"square_{c}") + n * off[c] * off[c]).alias(f"square_{c}") for c in "ab"],
        F.sum(F.col("product") + n * off["a"] * off["b"]).alias("product"),
        *[F.sum(c).alias(c) for c in ("n", "size_a", "size_b", "nans", "infinite")],
    )
    spread = [real_deviation(F.sqrt(F.greatest(F.col(f"square_{c}"), F.lit(0.0)) / n), F.col(f"size_{c}") / n) for c in "ab"]
    found = F.try_divide(F.col("product") / n, spread[0] * spread[1])
    found = F.when(F.col("nans") > 0, None).when(F.col("infinite") > 0, float("nan")).otherwise(found)
    asked = long.sparkSession.createDataFrame(list(itertools.combinations(names, 2)), "a string, b string")
    return asked.join(total.select("a", "b", found.alias("correlation")), ["a", "b"], "left")


DAYS = 2_000            # steps of time that meet as one matrix
PARTS = 200             # partitions up to which every block has its own; their square is the number of tasks
BLOCKS_TOGETHER = 4     # blocks of a partition beyond that
PACKED = {"steps": "i8", "step": "i4", "number": "i4", "moved": "f8"}


def _pack(table: pa.Table) -> pa.Table:
    """Returns of a block and slice as one row of arrays in order of time, one return per symbol and step."""
    at, number, moved = (table.column(c).to_numpy() for c in ("at", "number", "moved"))
    steps, step = np.unique(at, return_inverse=True)
    width = int(number.max()) + 1
    place, of, times = np.unique(step * width + number, return_inverse=True, return_counts=True)
    found = {"steps": steps, "step": place // width, "number": place % width, "moved": np.bincount(of, moved) / times}
    packed = {c: pa.array([found[c].astype(kind).tobytes()], pa.binary()) for c, kind in PACKED.items()}
    return pa.table({"block": table.column("block").slice(0, 1), "slice": table.column("slice").slice(0, 1), **packed})


def _matrix(series: dict[str, np.ndarray], steps: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of a block, steps by symbols."""
    own = np.searchsorted(series["steps"], steps)
    low, high = np.searchsorted(series["step"], [own[0], own[-1] + 1])
    step, number, moved = (series[c][low:high] for c in ("step", "number", "moved"))
    row = np.searchsorted(own, step)
    met = own[row] == step
    values, here = np.zeros((len(steps), symbols)), np.zeros((len(steps), symbols))
    values[row[met], number[met]], here[row[met], number[met]] = moved[met], 1.0
    return values, here


def _meet(least_common: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished pairs of the blocks that met in this task, from their sums over all slices."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    names: dict[int, pa.Array] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            sides = []
            for side in "xy":
                block = batch.column(f"block_{side}")[k].as_py()
                names.setdefault(block, batch.column(f"names_{side}")[k].values)
                sides.append((block, {c: np.frombuffer(batch.column(f"{c}_{side}")[k].as_buffer(), kind) for c, kind in PACKED.items()}))
            (x, a), (y, b) = sides
            total = sums.setdefault((x, y), np.zeros((6, len(names[x]), len(names[y]))))
            common = np.intersect1d(a["steps"], b["steps"], assume_unique=True)
            for i in range(0, len(common), DAYS):
                (va, ha), (vb, hb) = (_matrix(s, common[i:i + DAYS], len(names[n])) for n, s in sides)
                for m, (left, right) in enumerate(((ha, hb), (va, hb), (ha, vb), (va, vb), (va**2, hb), (ha, vb**2))):
                    total[m] += left.T @ right
    for (x, y), (n, sum_a, sum_b, sum_ab, square_a, square_b) in sums.items():
        spread = [n * square - total * total for square, total in ((square_a, sum_a), (square_b, sum_b))]
        flat = [s <= 1e-12 * n * square for s, square in zip(spread, (square_a, square_b), strict=True)]
        with np.errstate(divide="ignore", invalid="ignore"):
            found = (n * sum_ab - sum_a * sum_b) / np.sqrt(spread[0] * spread[1])
        i, j = np.nonzero((np.triu(n, 1) if x == y else n) >= max(least_common, 1))
        others = names[y].to_pylist()
        first = j >= np.array([bisect.bisect_left(others, name) for name in names[x].to_pylist()])[i]
        both, j_both = pa.concat_arrays([names[x], names[y]]), len(names[x]) + j
        yield pa.RecordBatch.from_pydict({
            "a": both.take(pa.array(np.where(first, i, j_both))), "b": both.take(pa.array(np.where(first, j_both, i))),
            "days": pa.array(n[i, j].astype("i8")),
            "correlation": pa.array(found[i, j], mask=(flat[0] | flat[1])[i, j], from_pandas=False),
        })


def asset_correlation(returns: DataFrame, least_common: int = 30, assets: int = 400) -> DataFrame:
    """a < b, days, correlation of every pair of symbols with ``least_common`` days on which both have a return.

    Symbols are dealt to blocks of about ``assets``, fewer where series are
    long, and time to slices of about ``DAYS`` steps.  A block is packed once,
    a row per slice.  Every two blocks meet in a nested loop that reads the
    packed rows anew instead of storing a copy of them for each meeting, and
    the task that gets two blocks sums them up over all slices as matrices of
    symbols by symbols and hands on finished pairs, so what is written grows
    with the bars.  The result has a row per pair, which is what grows with the
    square of the symbols.  The driver keeps books on every task, so blocks
    beyond ``PARTS`` share their partition with others.
    """
    known = settle(returns.filter("bar_ret is not null").select("symbol", "ts", "bar_ret"))
    centres = settle(known.groupBy("symbol").agg(F.avg("bar_ret").alias("centre")).filter("symbol is not null and not isnan(centre)"))
    at = F.unix_micros("ts")
    first, last, steps, bars = known.agg(F.min(at), F.max(at), F.approx_count_distinct("ts"), F.count(F.lit(1))).first()
    width = max(1, ((last or 0) - (first or 0)) // max(1, -(-(steps or 0) // DAYS)) + 1)
    symbols = centres.count()
    blocks = max(1, min(symbols, max(-(-symbols // assets), -(-bars // (assets * DAYS)))))
    numbered = centres.withColumn("block", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")).withColumn(
        "number", F.row_number().over(Window.partitionBy("block").orderBy("symbol")) - 1
    )
    listed = F.array_sort(F.collect_list(F.struct("number", "symbol")))         # of a block
    names = numbered.groupBy("block").agg(F.transform(listed, lambda s: s["symbol"]).alias("names"))
    dealt = known.filter("ts is not null").join(numbered, "symbol").select(
        "block", F.floor((at - (first or 0)) / width).alias("slice"), "number", at.alias("at"), (F.col("bar_ret") - F.col("centre")).alias("moved")
    ).filter("not isnan(moved)")
    schema = "block int, slice long, " + ", ".join(f"{c} binary" for c in PACKED)
    packed = dealt.groupBy("block", "slice").applyInArrow(_pack, schema).join(names, "block")
    parts = max(min(blocks, PARTS), -(-blocks // BLOCKS_TOGETHER))
    packed = packed.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int"))
    x, y = (packed.select(*[F.col(c).alias(f"{c}_{side}") for c in packed.columns]) for side in "xy")
    met = x.join(y.hint("shuffle_replicate_nl"), (F.col("block_x") <= F.col("block_y")) & (F.col("slice_x") == F.col("slice_y")))
    symbol = returns.schema["symbol"].dataType.simpleString()
    return met.mapInArrow(functools.partial(_meet, least_common), f"a {symbol}, b {symbol}, days long, correlation double")
