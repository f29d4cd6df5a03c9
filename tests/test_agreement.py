from pathlib import Path

import pytest

from msgtriage.operators import agreement as ag

RATINGS = Path(__file__).parent / "fixtures" / "ratings.csv"
SCHEMA = "item_id int, dimension string, rater_a int, rater_b int"

# Published results of the calibration study: exact, adjacent, kappa, r, bias, items.
PUBLISHED = {
    "groundedness": (76.0, 100.0, 0.8851, 0.9123, 0.16, 50),
    "actionability": (82.0, 100.0, 0.9108, 0.9287, 0.18, 50),
    "brand_tone": (96.0, 100.0, 0.9245, 0.9275, 0.04, 50),
}


def test_published_agreement(spark):
    ratings = spark.read.schema(SCHEMA).option("header", True).csv(str(RATINGS))
    per_dimension = ag.agreement(ratings)
    assert {r[0]: tuple(r)[1:] for r in per_dimension.collect()} == PUBLISHED
    assert tuple(ag.agreement_macro(per_dimension).first()) == (0.9068, 84.67, 100.0)


def brute_kappa(pairs):
    labels = sorted({x for p in pairs for x in p})
    at = {v: i for i, v in enumerate(labels)}
    n = len(pairs)
    observed = sum((at[a] - at[b]) ** 2 for a, b in pairs)
    expected = sum((at[a] - at[b]) ** 2 for a, _ in pairs for _, b in pairs) / n
    return None if expected == 0 else 1 - observed / expected


@pytest.mark.parametrize("pairs", [
    [(1, 1), (2, 2), (5, 5), (1, 5)],      # scale points 3 and 4 unused: positions, not values
    [(1, 2), (2, 1), (3, 3)],
    [(4, 4), (4, 4)],                      # a single rating: no value
    [(1, 2), (1, 2)],
])
def test_kappa_by_brute_force(spark, pairs):
    df = spark.createDataFrame([("d", a, b) for a, b in pairs], "dimension string, rater_a int, rater_b int")
    got = ag.weighted_kappa(ag.rating_counts(df)).first()["kappa"]
    expected = brute_kappa(pairs)
    assert got is None if expected is None else got == pytest.approx(expected)


def test_correlation_of_raters_who_hardly_differ(spark):
    counts = spark.createDataFrame([("d", 5, 5, 9_999_999), ("d", 4, 4, 1)], "dimension string, rater_a int, rater_b int, n long")
    assert ag.rater_pearson(counts).first()["pearson_r"] == pytest.approx(1.0)


def test_constant_rater_has_no_correlation(spark):
    df = spark.createDataFrame([("d", 3, 1), ("d", 3, 2)], "dimension string, rater_a int, rater_b int")
    assert ag.rater_pearson(ag.rating_counts(df)).first()["pearson_r"] is None
