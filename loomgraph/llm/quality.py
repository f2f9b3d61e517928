"""Quality rules: fixed limits, then robust multivariate outliers within a language and source.

Each text becomes a vector of transformed statistics. For every language and source the minimum-
covariance-determinant estimate is sought: from several starts, concentration steps (distances, the
nearer half, its mean and covariance, again) go on until no determinant falls any more, and the start
that ends with the least determinant gives the centre and the covariance, which a minority of bad
texts cannot move. Texts whose Mahalanobis distance is beyond a chi-square quantile are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard import windows
from .session import bucket, checkpoint, ship, written
from .words import chunks, mix, spans, split

LEAST_WORDS, MOST_REPEATED = 50, 50
#: Most concentration steps, the fall of a determinant's logarithm that counts, and the chi-square tail beyond which a text is an outlier.
STEPS, FALL, TAIL = 30, 1e-3, 1e-4
#: Precision of the distances' medians: one in so many rows may be on the wrong side.
RANKS = 10_000
#: Into how many the rows of a language and source are dealt for joins.
SALTS = 32
#: Of each statistic the spread that an estimate is raised to where it has less: most clean texts have none of some.
FLOORS = {"v_chars": 0.04, "v_symbols": 0.08, "v_lines": 0.15, "v_repeats": 0.15}
#: Starts by subsets of the rows, besides the one at the medians, and about how many rows a subset has at least.
STARTS, SUBSET = 4, 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _counts(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    words, n = split(data, bounds, lower=False), len(bounds) - 1
    first = words.first
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    inside = np.append(0, np.cumsum(chars[words.end] - chars[words.start]))
    symbols = np.append(0, np.cumsum(_SYMBOL[data]))
    own = (np.arange(n) + 1).astype(np.uint64) * _U(0x9E3779B97F4A7C15)

    hashes, at = windows(words, 3)
    _, which, times = np.unique(mix(hashes + own[words.text[at]]), return_inverse=True, return_counts=True)
    covers = np.zeros(len(words.hash) + 1, np.int64)
    again = at[times[which] > 1]
    np.add.at(covers, again, 1)
    np.add.at(covers, again + 3, -1)
    repeated = np.append(0, np.cumsum(np.cumsum(covers[:-1]) > 0))

    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    start = start[start < len(data)]
    text = np.searchsorted(bounds, start, "right") - 1
    end = np.append(start[1:], len(data))
    end = np.minimum(end, bounds[text + 1])
    end -= (end > start) & (data[np.maximum(end - 1, 0)] == 10) if len(end) else 0
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    lines = mix(spans(data, start, end)[full] + own[text[full]])
    _, earliest = np.unique(lines, return_index=True)
    later = np.ones(len(lines), bool)
    later[earliest] = False
    dup = np.bincount(text[full][later], minlength=n)
    return [np.diff(first), np.diff(inside[first]), np.diff(symbols[bounds]), dup, np.diff(repeated[first])]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(3)):
                own = [batch.column(i).slice(at, to - at) for i in range(3)]
                yield pa.RecordBatch.from_arrays(own + [pa.array(c.astype(np.int64)) for c in _counts(data, bounds)], ["doc_id", "lang", "source", *COUNTS])

    ship(docs.sparkSession)
    columns = (F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return docs.select(*columns, "text").mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def chi_square(x: float, halves: int) -> float:
    """Distribution function of chi-square with 2 * halves degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(halves))


def chi_square_at(p: float, halves: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, halves) < p else (low, mid)
    return high


def vectors(counted: DataFrame) -> DataFrame:
    """The v_ columns: logarithm of the mean word length, and square roots of rates, of which the limits bound none."""
    words = F.greatest("n_words", F.lit(1))
    repeats = F.col("n_repeat_words") / F.greatest(words - F.col("n_repeat_words"), F.lit(1))
    made = counted.withColumn("v_chars", F.log(F.greatest("word_chars", F.lit(1)) / words)).withColumn("v_symbols", F.sqrt(F.col("n_symbols") / words))
    return made.withColumn("v_lines", F.sqrt(10 * F.col("n_dup_lines") / words)).withColumn("v_repeats", F.sqrt(repeats))


def _distance(fit: Column) -> Column:
    """Squared Mahalanobis distance of the v_ columns under a centre and an inverse covariance."""
    off = [F.col(v) - fit["centre"][i] for i, v in enumerate(FLOORS)]
    d = len(off)
    return sum((off[i] * off[j] * fit["inverse"][i * d + j] * (1 if i == j else 2) for i in range(d) for j in range(i, d)), F.lit(0.0))


def raised(spread: np.ndarray) -> np.ndarray:
    """The covariance with at least the least spreads in every direction."""
    floor = np.array(list(FLOORS.values()))
    values, axes = np.linalg.eigh(spread / np.outer(floor, floor))
    return (axes * np.maximum(values, 1)) @ axes.T * np.outer(floor, floor)


def _fitted(moments: DataFrame, factor: float) -> DataFrame:
    """(part, fits) from n, sums and sums of products of each start's rows: log determinant, centre and inverse covariance."""

    def fit(n: float, sums: list[float], products: list[float]) -> dict:
        centre = np.array(sums) / n
        both = np.zeros((len(centre), len(centre)))
        both[np.triu_indices(len(centre))] = products
        spread = raised(factor * ((both + np.triu(both, 1).T) / n - np.outer(centre, centre)))
        return {"logdet": float(np.linalg.slogdet(spread)[1]), "centre": centre.tolist(), "inverse": np.linalg.inv(spread).ravel().tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.list_(pa.float64())
        kind = pa.list_(pa.struct([("logdet", pa.float64()), ("centre", numbers), ("inverse", numbers)]))
        for batch in batches:
            fits = [[fit(*m) for m in row] for row in ([[x["n"], x["sums"], x["products"]] for x in r] for r in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fits, kind)], ["part", "fits"])

    return moments.mapInArrow(run, FITS)


FITS = "part string, fits array<struct<logdet: double, centre: array<double>, inverse: array<double>>>"


def _moments(rows: DataFrame, chosen: list[Column]) -> DataFrame:
    """Of the rows that each condition chooses the number, sums and sums of products; of all rows where it chooses none."""
    names = list(FLOORS)

    def one(condition: Column) -> Column:
        among = lambda x: F.coalesce(F.sum(F.when(condition, x)), F.sum(x))
        return F.struct(
            among(F.lit(1.0)).alias("n"), F.array(*(among(F.col(v)) for v in names)).alias("sums"),
            F.array(*(among(F.col(a) * F.col(b)) for k, a in enumerate(names) for b in names[k:])).alias("products"),
        )

    return rows.groupBy("part").agg(F.array(*map(one, chosen)).alias("moments"))


def _with(rows: DataFrame, parts: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with what each part has. One part may hold most rows, so they are dealt out by a salt too."""
    return rows.join(parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["part", "salt"], how)


def estimates(rows: DataFrame) -> DataFrame:
    """(part, logdet, centre, inverse) of every part of rows (part, salt, h, v_ columns): the fit of the least determinant."""
    d = len(FLOORS)
    half = chi_square_at(0.5, d // 2)
    factor = 0.5 / chi_square(half, d // 2 + 1)
    centres = F.array(*(F.percentile_approx(v, 0.5, RANKS) for v in FLOORS))
    parts = written(rows.groupBy("part").agg(F.count("*").alias("n"), centres.alias("centre")))
    sized = _with(rows, parts.select("part", "n")).withColumn("subset", F.pmod("h", F.greatest(F.lit(STARTS), F.floor(F.col("n") / SUBSET))))
    plain = F.array(*map(F.lit, np.diag(1 / np.array(list(FLOORS.values())) ** 2).ravel().tolist()))
    middle = parts.select("part", F.struct(F.lit(math.inf).alias("logdet"), "centre", plain.alias("inverse")).alias("middle"))
    subsets = _fitted(_moments(sized, [F.col("subset") == k for k in range(STARTS)]), factor)
    now = written(subsets.join(middle, "part").select("part", F.array_append("fits", F.col("middle")).alias("fits")))
    every = range(STARTS + 1)
    for _ in range(STEPS):
        away = _with(rows, now).select("part", "salt", *FLOORS, *(_distance(F.col("fits")[k]).alias(f"away{k}") for k in every))
        limits = written(away.groupBy("part").agg(*(F.percentile_approx(f"away{k}", 0.5, RANKS).alias(f"limit{k}") for k in every)))
        near = _moments(_with(away, limits), [F.col(f"away{k}") <= F.col(f"limit{k}") for k in every])
        after = written(_fitted(near, factor).join(now.select("part", F.col("fits").alias("before")), "part"))
        fell = F.array_max(F.zip_with("before", "fits", lambda b, f: b["logdet"] - f["logdet"]))
        now = after.select("part", "fits")
        if after.where(fell > FALL).isEmpty():
            break
    return now.select("part", F.array_min("fits").alias("fit")).select("part", "fit.*")


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, kept, and the distance.

    Texts that fail the limits are rejected and give no estimates. Null and empty texts have no
    words and fail. Null languages and sources are groups of their own. Where texts of a language and
    source hardly differ in a statistic, or are few, its least spread decides. Repeated rows each give a row; a null doc_id stays
    null; other columns are ignored.
    """
    made = statistics(docs)
    made = vectors(made.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))))
    made = made.withColumn("part", F.to_json(F.struct("lang", "source"))).withColumn("h", bucket("doc_id", *COUNTS))
    made = checkpoint(made.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int")).drop("lang", "source"))
    good = made.where("not base_failed").select("part", "salt", "h", *FLOORS)
    judged = _with(made, written(estimates(good)), "left").withColumn("away", _distance(F.struct("centre", "inverse")))
    kept = ~F.col("base_failed") & (F.coalesce("away", F.lit(0.0)) <= chi_square_at(1 - TAIL, len(FLOORS) // 2))
    return judged.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), F.sqrt("away").alias("distance"))
