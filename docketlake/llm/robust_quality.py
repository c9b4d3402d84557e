"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

Each document becomes a vector of transformed text statistics. For every language and source a minimum-covariance-
determinant estimate gives a centre and a scatter that outliers don't move; a document is rejected when its
Mahalanobis distance from its group's centre is beyond a chi-square quantile.

Concentration steps begin from three deterministic starts (medians and median absolute deviations, spatial signs around
them, hyperbolic tangents); after two steps the start of least determinant goes on, until no group's determinant falls
any more. Groups of any size are estimated alike: a group of ``n`` documents has the weight ``n`` against ``prior`` documents
of its language's own estimate, and FLOOR is added to every scatter.

Estimates cover all documents. Concentration steps run for all groups at once as grouped sums: a pass adds up moments by
group and by a fine grid of distances, so the half of least distance (up to a cell of the grid) and its moments come from
one aggregation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import Scratch, distinct, slices, split_words, sum_segments, texts_of, word_bytes

NAMES = ("log_words", "log_word_length", "symbols", "capitals", "digits", "variety", "log_line_length")
#: The least standard deviation of each statistic, added to every scatter: a statistic that most documents of a group share exactly doesn't make all others outliers.
FLOOR = (0.3, 0.05, 0.06, 0.06, 0.06, 0.05, 0.3)
D = len(NAMES)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
GRID = 16  # cells per doubling of the squared distance
TRIM = 0.975  # share of a normal population that the last, reweighted estimate rests on
TOLERANCE = 1e-3  # by which a log determinant must fall for another step


def chi2_cdf(x: float, k: float) -> float:
    """Chi-square distribution function: the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def _ratio(x):
    return np.arcsin(np.sqrt(np.clip(x, 0, 1)))


_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "!#$%&*+/<=>@\\^_`|~{}[]"]] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = 1
_LETTER[0xC3:0xF5] = 1  # a character beyond ASCII counts as a letter
_SOLID = np.zeros(256, np.int64)
_SOLID[33:127] = 1
_SOLID[0xC2:0xF5] = 1


def statistics_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of NAMES for each text, and its number of words (with none the vector means nothing).

    Ratios count 40 ordinary characters (5 words) besides, so that a text of a few words isn't judged by one capital.
    """
    words, codes, offsets = split_words(texts)
    size = np.diff(offsets)
    data, at = word_bytes(texts)
    solid = np.maximum(sum_segments(_SOLID[data], at), 1)
    letters = np.maximum(sum_segments(_LETTER[data], at), 1)
    wide = np.zeros(len(data), np.int64)  # capitals of the Latin-1 block
    if len(data):
        wide[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    lines = sum_segments((data == 10).astype(np.int64), at) + 1
    doc = np.repeat(np.arange(len(size)), size)
    kinds = distinct(doc * max(1, len(words)) + codes)
    types = np.bincount(kinds // max(1, len(words)), minlength=len(size))
    n = np.maximum(size, 1)
    x = [
        np.log1p(n),
        np.log((solid + 25) / (n + 5)),
        _ratio(sum_segments(_SYMBOL[data], at) / (solid + 40)),
        _ratio((sum_segments(_CAPITAL[data], at) + sum_segments(wide, at) + 1) / (letters + 40)),
        _ratio(sum_segments(_DIGIT[data], at) / (solid + 40)),
        np.log1p(types) / np.log1p(n),
        np.log1p(n / lines),
    ]
    return np.round(np.stack(x, 1), 6), size


def _statistics(docs: DataFrame) -> DataFrame:
    def measure(batches):
        for part in slices(batches):
            x, size = statistics_of(part.column("text"))
            columns = [part.column("doc_id"), part.column("lang"), part.column("source"), pa.array(size.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x[:, i].copy()) for i in range(D)], ["doc_id", "lang", "source", "n_words", *(f"x{i}" for i in range(D))])

    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    schema = "doc_id long, lang string, source string, n_words long, " + ", ".join(f"x{i} double" for i in range(D))
    return texts_of(docs, *names).mapInArrow(measure, schema)


GROUP = ["g_lang", "g_source"]
_COLUMNS = [*GROUP, "start", "logdet", *(f"c{i}" for i in range(D)), *(f"p{i}_{j}" for i, j in PAIRS), *(f"v{i}_{j}" for i, j in PAIRS)]
_PARAMS = "g_lang string, g_source string, start string, " + ", ".join(f"{c} double" for c in _COLUMNS[3:])


def _square(values) -> np.ndarray:
    whole = np.zeros((D, D))
    for (i, j), v in zip(PAIRS, values):
        whole[i, j] = whole[j, i] = v
    return whole


def _row(group, start: str, mean: np.ndarray, cov: np.ndarray) -> list:
    inverse = np.linalg.inv(cov)
    return [*group, start, float(np.linalg.slogdet(cov)[1]), *mean, *(inverse[i, j] for i, j in PAIRS), *(cov[i, j] for i, j in PAIRS)]


def consistency(q: float) -> float:
    """By how much the scatter of the share ``q`` of least distance of a normal population falls short."""
    return q / max(chi2_cdf(chi2_quantile(min(q, 0.999999), D), D + 2), 1e-9)


def regularised(mean: np.ndarray, cov: np.ndarray, n: float, prior: tuple[np.ndarray, np.ndarray] | None, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """An estimate from ``n`` documents beside one that counts as ``weight`` documents."""
    own = n / (n + weight) if prior else 1.0
    other = prior or (mean, cov)
    return own * mean + (1 - own) * other[0], own * cov + (1 - own) * other[1] + np.diag(np.square(FLOOR))


def _fit(sums: pd.DataFrame, share: float, trimmed: float | None, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter from moments by grid cell, over the cells of least distance that hold ``share``."""
    sums = sums.sort_values("cell")
    total = sums["n"].cumsum().to_numpy()
    last = int(np.searchsorted(total, math.ceil(share * total[-1] - 1e-9)))
    part = sums.iloc[: last + 1]
    n = part["n"].sum()
    mean = np.array([part[f"m{i}"].sum() for i in range(D)]) / n
    cov = _square([part[f"s{i}_{j}"].sum() / n - mean[i] * mean[j] for i, j in PAIRS]) * consistency(trimmed or n / total[-1])
    first = sums.iloc[0]
    prior = (np.array([first[f"q{i}"] for i in range(D)]), _square([first[f"w{i}_{j}"] for i, j in PAIRS])) if "q0" in sums else None
    return regularised(mean, cov, total[-1], prior, weight)


def _distance() -> str:
    return " + ".join(f"{1 if i == j else 2} * p{i}_{j} * (x{i} - c{i}) * (x{j} - c{j})" for i, j in PAIRS)


def _step(stats: DataFrame, params: DataFrame, share: float, prior: DataFrame | None, weight: float, cut: float | None = None) -> DataFrame:
    """A concentration step of all groups and starts; with ``cut`` all documents of up to that distance count instead of a share."""
    joined = stats.join(params.drop("logdet", *(f"v{i}_{j}" for i, j in PAIRS)), GROUP).withColumn("d2", F.expr(_distance()))
    if cut is not None:
        joined = joined.where(F.col("d2") <= cut)
    cell = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-9))) * GRID).alias("cell")
    sums = [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"m{i}") for i in range(D)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS)]
    cells = joined.groupBy(*GROUP, "start", cell).agg(*sums)
    if prior is not None:
        other = prior.select("g_lang", *(F.col(f"c{i}").alias(f"q{i}") for i in range(D)), *(F.col(f"v{i}_{j}").alias(f"w{i}_{j}") for i, j in PAIRS))
        cells = cells.join(other, "g_lang")

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_row(key[:2], key[2], *_fit(pdf, share, None if cut is None else TRIM, weight))], columns=_COLUMNS)

    return cells.groupBy(*GROUP, "start").applyInPandas(fit, _PARAMS)


def _medians(stats: DataFrame) -> DataFrame:
    """Each group's medians and median absolute deviations, from counts on a grid of 1/128."""
    marks = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.round(F.col(f"x{i}") * 128).cast("int").alias("cell")) for i in range(D)))).alias("s")
    cells = stats.select(*GROUP, marks).groupBy(*GROUP, "s.i", "s.cell").count()

    def middle(values: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        total = np.cumsum(n[order])
        return float(values[order][np.searchsorted(total, total[-1] / 2)])

    def start(key, pdf: pd.DataFrame) -> pd.DataFrame:
        c, v = np.zeros(D), np.zeros(D)
        for i, part in pdf.groupby("i"):
            values, n = part["cell"].to_numpy() / 128, part["count"].to_numpy()
            c[i] = middle(values, n)
            v[i] = (1.4826 * middle(np.abs(values - c[i]), n)) ** 2 + FLOOR[i] ** 2
        return pd.DataFrame([_row(key, "deviations", c, np.diag(v))], columns=_COLUMNS)

    return cells.groupBy(*GROUP).applyInPandas(start, _PARAMS)


def start_scatters(n: float, tangent: np.ndarray, tangents: np.ndarray, signs: np.ndarray, scale: np.ndarray) -> dict[str, np.ndarray]:
    """Scatters to begin from, by sums over standardised vectors: of tangents, of their products and of products of spatial signs."""
    mean = tangent / n
    cov = tangents / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    found = {"tangents": cov / np.outer(dev, dev), "signs": D * signs / n}
    return {k: np.outer(scale, scale) * (0.9 * v + 0.1 * np.eye(D)) for k, v in found.items()}


def _starts(stats: DataFrame, medians: DataFrame) -> DataFrame:
    """Three starts for each group: the medians and deviations themselves, and with scatters of spatial signs and of hyperbolic tangents."""
    z = [f"((x{i} - c{i}) * sqrt(p{i}_{i}))" for i in range(D)]
    norm = "greatest(1e-12, " + " + ".join(f"{a} * {a}" for a in z) + ")"
    base = stats.join(medians.select(*GROUP, *(f"c{i}" for i in range(D)), *(f"p{i}_{i}" for i in range(D))), GROUP)
    base = base.select(*GROUP, *(F.expr(a).alias(f"z{i}") for i, a in enumerate(z)), *(F.tanh(F.expr(a)).alias(f"t{i}") for i, a in enumerate(z)), F.expr(norm).alias("norm"))
    sums = [F.count("*").alias("n"), *(F.sum(f"t{i}").alias(f"m{i}") for i in range(D))]
    sums += [F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"s{i}_{j}") for i, j in PAIRS] + [F.sum(F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm")).alias(f"u{i}_{j}") for i, j in PAIRS]
    rows = base.groupBy(*GROUP).agg(*sums).join(medians, GROUP)

    def start(batches):
        for pdf in batches:
            found = []
            for _, r in pdf.iterrows():
                c, scale = np.array([r[f"c{i}"] for i in range(D)]), np.array([r[f"v{i}_{i}"] ** 0.5 for i in range(D)])
                more = start_scatters(r["n"], np.array([r[f"m{i}"] for i in range(D)]), _square([r[f"s{i}_{j}"] for i, j in PAIRS]), _square([r[f"u{i}_{j}"] for i, j in PAIRS]), scale)
                found += [_row((r["g_lang"], r["g_source"]), k, c, v) for k, v in {"deviations": np.diag(scale**2), **more}.items()]
            yield pd.DataFrame(found, columns=_COLUMNS)

    return rows.mapInPandas(start, _PARAMS)


def _estimate(scratch: Scratch, stats: DataFrame, name: str, half: float, prior: DataFrame | None, weight: float) -> DataFrame:
    """The reweighted minimum-covariance-determinant estimate of every group of ``stats``."""
    keep = lambda df, step: scratch.save(df, f"{name}-{step}")
    params = keep(_starts(stats, keep(_medians(stats), "medians")), "starts")
    for i in range(2):
        params = keep(_step(stats, params, half, prior, weight), f"first{i}")
    best = params.groupBy(*GROUP).agg(F.min_by(F.struct(*_COLUMNS[2:]), F.struct("logdet", "start")).alias("b")).select(*GROUP, "b.*")
    best, i, falling = keep(best.withColumn("fell", F.lit(True)), "best"), 0, True
    while falling:
        i += 1
        new = _step(stats, best.drop("fell"), half, prior, weight).select(F.struct(*_COLUMNS).alias("n"))
        fell = F.col("n.logdet") < F.col("o.logdet") - TOLERANCE
        both = best.select(F.struct(*_COLUMNS).alias("o")).join(new, (F.col("o.g_lang") == F.col("n.g_lang")) & (F.col("o.g_source") == F.col("n.g_source")))
        best = keep(both.select(F.when(fell, F.col("n")).otherwise(F.col("o")).alias("b"), fell.alias("fell")).select("b.*", "fell"), f"step{i}")
        falling = not best.where("fell").isEmpty()
    return keep(_step(stats, best.drop("fell"), 1.0, prior, weight, chi2_quantile(TRIM, D)), "final")


def reject_outliers(docs: DataFrame, reject_share: float = 1e-4, half: float = 0.75, prior: float = 20.0) -> DataFrame:
    """One row per document: its statistics, its squared robust distance, and whether it stays.

    ``half`` is the share of each group that the estimate rests on, ``reject_share`` the share of a normal population that
    would be rejected, and ``prior`` the number of documents that the language's estimate counts for in that of each of
    its sources.

    A null or empty text, or one of white space, isn't measured: distance null, keep false. Null language or source is
    a value of its own (''). Repeated rows count each, and so do rows that share a doc_id. Null keys give rows with null
    keys. Other columns aren't read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    raw = scratch.save(_statistics(docs), "statistics")
    measured = raw.where("n_words > 0").select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(f"x{i}" for i in range(D)))
    langs = _estimate(scratch, measured.withColumn("g_source", F.lit("*")), "languages", half, None, 0.0)
    params = _estimate(scratch, measured, "sources", half, langs, prior)
    limit = chi2_quantile(1 - reject_share, D)
    found = raw.join(params, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")), "left")
    d2 = F.when(F.col("n_words") > 0, F.expr(_distance()))
    stats = F.when(F.col("n_words") > 0, F.struct(*(F.col(f"x{i}").alias(name) for i, name in enumerate(NAMES))))
    return found.select("doc_id", "lang", "source", "n_words", stats.alias("statistics"), F.round(d2, 4).alias("distance2"), F.coalesce(d2 <= limit, F.lit(False)).alias("keep"))
