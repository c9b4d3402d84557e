import numpy as np
import pyarrow as pa

from docketlake.llm.robust_quality import D, FLOOR, chi2_cdf, chi2_quantile, reject_outliers, statistics_of


def prose(rng, n):
    words = ["court", "held", "that", "the", "claim", "was", "not", "made", "out", "of", "time", "under", "article", "and", "so"]
    return ". ".join(" ".join(rng.choice(words, 8)).capitalize() for _ in range(n // 8 + 1)) + "."


def test_chi_square():
    assert abs(chi2_cdf(3.841458820694124, 1) - 0.95) < 1e-9
    assert abs(chi2_quantile(0.975, 7) - 16.01276427) < 1e-6


def concentrate(x, half, n0, prior, floor):
    """The estimate of one group without grids: steps to the end from three starts, the least determinant of all."""
    n = len(x)

    def settle(mean, cov):
        own = n / (n + n0) if prior else 1.0
        other = prior or (mean, cov)
        return own * mean + (1 - own) * other[0], own * cov + (1 - own) * other[1] + floor

    def factor(q):
        return q / chi2_cdf(chi2_quantile(min(q, 0.999999), D), D + 2)

    centre = np.median(x, 0)
    sd = np.sqrt((1.4826 * np.median(np.abs(x - centre), 0)) ** 2 + np.diag(floor))
    z = (x - centre) / sd
    y, u = np.tanh(z), z / np.maximum(1e-6, np.linalg.norm(z, axis=1, keepdims=True))
    yc = np.cov(y.T, bias=True) if n > 1 else np.zeros((D, D))
    dev = np.sqrt(np.maximum(np.diag(yc), 1e-9))
    starts = [np.eye(D), 0.9 * yc / np.outer(dev, dev) + 0.1 * np.eye(D), 0.9 * D * u.T @ u / n + 0.1 * np.eye(D)]
    best = None
    for r in starts:
        mean, cov, before = centre, np.outer(sd, sd) * r, np.inf
        while True:
            d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
            inner = x[d <= np.sort(d)[int(np.ceil(half * n)) - 1]]
            new = settle(inner.mean(0), np.cov(inner.T, bias=True) * factor(len(inner) / n) if len(inner) > 1 else np.zeros((D, D)))
            det = np.linalg.slogdet(new[1])[1]
            if det >= before - 1e-6:
                break
            before, (mean, cov) = det, new
        if best is None or before < best[0]:
            best = before, mean, cov
    _, mean, cov = best
    d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
    inner = x[d <= chi2_quantile(0.975, D)]
    return settle(inner.mean(0), np.cov(inner.T, bias=True) * factor(0.975) if len(inner) > 1 else np.zeros((D, D)))


def brute(rows, half=0.75, n0=20.0):
    """Distances of (lang, source, text) rows, languages first, then each of their sources."""
    x, floor, found = statistics_of(pa.array([t for _, _, t in rows]))[0], np.diag(np.square(FLOOR)), np.zeros(len(rows))
    for lang in {r[0] for r in rows}:
        mine = np.array([r[0] == lang for r in rows])
        prior = concentrate(x[mine], half, 0.0, None, floor)
        for source in {r[1] for r in rows if r[0] == lang}:
            at = mine & np.array([r[1] == source for r in rows])
            mean, cov = concentrate(x[at], half, n0, prior, floor)
            found[at] = np.einsum("ni,ij,nj->n", x[at] - mean, np.linalg.inv(cov), x[at] - mean)
    return found


def test_many_groups_against_brute_force(spark):
    """Groups of one document to some hundred, in two languages, with junk in some of them."""
    rng = np.random.default_rng(4)
    rows = []
    for g, n in enumerate([1, 2, 3, 7, 15, 30, 60, 150, 4, 220]):
        junk = n // 8
        rows += [("en" if g % 2 else "fr", f"s{g}", prose(rng, int(rng.integers(20, 300)))) for _ in range(n - junk)]
        rows += [("en" if g % 2 else "fr", f"s{g}", "$$$ 99 ### 12 " * int(rng.integers(5, 40))) for _ in range(junk)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    got = {r.doc_id: r for r in reject_outliers(docs).collect()}
    want = brute(rows)
    mine = np.array([got[i].distance2 for i in range(len(rows))])
    assert np.median(np.abs(mine - want) / (1 + want)) < 0.15
    limit = chi2_quantile(1 - 1e-4, D)
    assert np.mean([got[i].keep == (d <= limit) for i, d in enumerate(want)]) > 0.98
    assert all(got[i].keep == ("$$$" not in t) for i, (_, _, t) in enumerate(rows))


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, int(rng.integers(20, 400))), "en", "s", "k") for i in range(100)]
    odd = [(2000, None, "en", "s", "k"), (2001, " \n", "en", "s", "k"), (2002, "Lone words.", None, None, "k"), (None, prose(rng, 90), "en", "s", "k"), (3, rows[3][1], "en", "s", "k"), (2003, prose(rng, 30000), "en", "t", "k")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, keep string")
    got = reject_outliers(docs).collect()
    assert len(got) == 106
    keep = {r.doc_id: r.keep for r in got}
    assert keep[None] and keep[2002] and not keep[2000] and not keep[2001] and keep[3]


def test_empty_table(spark):
    assert reject_outliers(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
