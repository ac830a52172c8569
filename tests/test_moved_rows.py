"""What moves and how often: joins of the star, cubes and term counts."""
from caseloom.operators import vocabulary as V
from checks import adapters, analytics, star

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_meet_their_orders_last(spark):
    """Customers join the orders first, so rows of lineitem move twice and not three times."""
    joins = [x for x in plan(adapters.lines(spark, SF)).splitlines() if "Join" in x]
    assert "l_orderkey" in joins[0] and "o_orderkey" in joins[0]


def test_cube_reads_the_cases_once(spark):
    """Copies, company groups and tone cuts come from the written columns, not from the joins again."""
    assert "l_orderkey" not in plan(analytics.case_cube(spark, SF))
    assert "l_orderkey" not in plan(analytics.kpis(spark, SF))


def test_side_tables_need_no_copies(spark):
    """Copies are marked once, where the cases meet their side tables; dimensions and cuts read the written rows."""
    base, _ = star.parts(spark, SF)
    assert "dup_count" not in base.columns


def test_terms_are_counted_before_they_part(spark):
    """No aggregate or exchange above the rows of terms; the texts of a repeated or null key count together."""
    df = spark.createDataFrame([(1, "ab cd ab"), (1, "ab"), (2, ""), (3, None), (None, "cd cd"), (None, "cd")],
                               "case_id long, narrative_clean string")
    counts = V.term_counts(df)
    text = plan(counts)
    assert "Aggregate" not in text[:text.index("Generate")]
    assert sorted((tuple(r) for r in counts.collect()), key=repr) == sorted(
        [(1, "ab", 3), (1, "cd", 1), (1, "ab cd", 1), (1, "cd ab", 1), (None, "cd", 3), (None, "cd cd", 1)], key=repr)
