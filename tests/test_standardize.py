"""The four baselines on a frame where they all differ, worked out by hand."""
import pytest

from caseloom.operators import analytics as A, standardize as Z

# group, stratum, outcome; stratum "only" lies wholly inside group g
ROWS = (
    [("g", "x", 1)] * 3 + [("g", "x", 0)] * 1 + [("g", "only", 1)] * 1 + [("g", "only", 0)] * 3
    + [("h", "x", 1)] * 1 + [("h", "x", 0)] * 3 + [("h", "y", 0)] * 2 + [("i", "y", 1)] * 2
)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "grp string, stratum string, hit int")


def of(frame, baseline, group="g"):
    return Z.standardize(frame, "grp", "stratum", "hit", baseline).where(f"grp = '{group}'").first()


def test_inner_drops_the_stratum_from_every_column(frame):
    r = of(frame, "inner")
    assert (r["n"], r["hits"], r["rate"], r["expected"]) == (4, 3, 0.75, 0.25)


def test_outside_lets_the_other_strata_carry_the_weight(frame):
    r = of(frame, "outside")
    assert (r["n"], r["rate"], r["expected"]) == (8, 0.5, 0.25)


def test_fallback_uses_the_overall_rate(frame):
    r = of(frame, "fallback")
    assert (r["n"], r["rate"], r["expected"]) == (8, 0.5, (4 * 0.25 + 4 * 0.25) / 8)
    assert of(frame, "fallback", "h")["expected"] == round((4 * 0.75 + 2 * 1.0) / 6, 9)


def test_national_includes_the_group(frame):
    r = of(frame, "national")
    assert (r["rate"], r["expected"], r["gap"]) == (0.5, (4 * 0.5 + 4 * 0.25) / 8, 0.5 - 0.375)


def test_unknown_baseline(frame):
    with pytest.raises(ValueError):
        of(frame, "median")


def test_signal_table_drops_products_that_are_all_signal(spark):
    rows = [("p", 1, 1)] * 2 + [("p", 0, 0)] * 2 + [("p", 1, 0)] * 2 + [("q", 1, 1)] * 5
    df = spark.createDataFrame(rows, "product string, s int, relief int")
    r = A.signal_table(df, {"s": "Signal"}).first()
    assert r["cases_with_signal"] == 4 and r["relief_with_pct"] == 50.0 and r["expected_pct"] == 0.0
    assert r["share_pct"] == 66.7 and r["mix_adjusted_gap_pts"] == 50.0
