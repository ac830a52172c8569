"""The five jobs end to end over a small generated extract."""
import csv
import gzip
import json
import random
from pathlib import Path

import pytest

from caseloom import settings as S
from caseloom.plans import jobs
from caseloom.sources import cases as C

THEMES = {
    "Identity theft": ["identity theft", "police report", "stolen", "opened", "fraud"],
    "Late payment reporting": ["late payment", "reported late", "history", "goodwill", "removed"],
    "Collection calls & contact": ["phone calls", "calling", "harass", "stop", "daily"],
}
SEEDS = [(theme, words[:2]) for theme, words in THEMES.items()]


def write_extract(path: Path, n: int = 400) -> None:
    rng = random.Random(7)
    products = list(S.PRODUCT_LABELS)[:3]
    with gzip.open(path, "wt", newline="") as f:
        out = csv.writer(f)
        out.writerow(["complaint_id", "date_received", "product", "sub_product", "issue", "sub_issue",
                      "consumer_complaint_narrative", "company", "state", "zip_code", "tags", "date_sent_to_company",
                      "company_response_to_consumer", "timely_response"])
        for i in range(n):
            k = rng.randrange(3)
            words = [rng.choice(list(THEMES.values())[k]) for _ in range(14)] + [
                rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(40)]
            rng.shuffle(words)
            text = " ".join(words[:25]) + ". I paid {$20.00} to XXXX, \"thanks\".\n" + " ".join(words[25:]) + " bad."
            if i % 10 == 0:
                text = "This is a copied form letter about identity theft and a police report. It is bad."
            if i % 97 == 0:
                text = ""
            lucky = rng.random() < (0.7, 0.3, 0.1)[k]
            out.writerow([
                1000 + i, f"2019-{1 + i % 11:02d}-{1 + i % 28:02d}", products[k if rng.random() < 0.9 else (k + 1) % 3],
                "" if i % 5 else "sub", f"issue {i % 4}", "", text, f" company {i % 30 % 20} ",
                rng.choice(["TX", "CA", "NY", ""]), rng.choice(["770XX", "941XX", ""]),
                rng.choice(["Older American", "Servicemember", "Older American, Servicemember", "", ""]), f"2019-12-{1 + i % 28:02d}",
                "Closed with monetary relief" if lucky and i % 2 else
                "Closed with non-monetary relief" if lucky else "Closed with explanation", "Yes" if i % 9 else "No"])


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("jobs")
    write_extract(folder / "raw.csv.gz")
    lexicon = spark.createDataFrame([("bad", -2.5), ("thanks", 1.9), ("fraud", -2.3)], "token string, valence double")
    options = jobs.Options(
        out=str(folder / "out"), seeds=SEEDS, topic_min_df=3, topic_max_df=0.9, topic_terms=200, topic_passes=30,
        phrase_min_docs=10, hotspot_min_cases=20, segment_min_dup=5, route_terms=300, outcome_terms=300, max_iter=25,
        folds=2)
    jobs.run_all(C.read_raw_csv(spark, str(folder / "raw.csv.gz")), lexicon, options)
    return folder / "out"


def read(spark, path):
    return spark.read.parquet(str(path))


def test_cases(spark, finished):
    cases = read(spark, finished / "cases")
    assert cases.count() == 400
    empty = cases.where("narrative = ''").collect()
    assert empty and all(r["narrative_words"] == 0 and r["dup_count"] == len(empty) for r in empty)
    assert {r[0] for r in cases.select("company").distinct().collect()} == {f"company {i}" for i in range(20)}
    assert cases.where("in_metro = 1 AND state <> 'TX'").count() == 0
    assert "dollaramount" in cases.where("narrative LIKE '%{$20.00}%'").first()["narrative_clean"]


def test_every_case_has_a_theme_and_a_score(spark, finished):
    text, scores = read(spark, finished / "text_features"), read(spark, finished / "model_scores")
    assert text.count() == scores.count() == 400
    assert text.where("theme IS NULL OR sentiment IS NULL").count() == 0
    unclassified = text.where(f"theme = '{S.UNCLASSIFIED}'")
    empty = read(spark, finished / "cases").where("narrative = ''")
    assert empty.join(unclassified, "case_id", "left_anti").count() == 0
    assert scores.where("relief_score IS NULL").count() == 0
    assert scores.where("(route_pred IS NULL) = (in_holdout = 1)").count() == 0
    assert [r["count"] for r in scores.groupBy("relief_priority_decile").count().collect()] == [40] * 10


def test_star_joins_back_to_all_cases(spark, finished):
    t = lambda name: read(spark, finished / "star" / name)
    fact = t("fact_cases")
    assert len(fact.columns) == 34
    joined = fact.join(t("dim_product"), "product_id").join(t("dim_theme"), "theme_id").join(
        t("dim_company"), "company_id").join(t("dim_date").withColumnRenamed("date", "date_received"), "date_received")
    assert joined.count() == 400
    cube = read(spark, finished / "cube")
    assert cube.agg({"cases": "sum"}).first()[0] == 400
    packed = read(spark, finished / "packed")
    assert packed.count() == 400
    assert packed.where("greatest(b0, b1, b2, b3, b4) > 255 OR least(b0, b1, b2, b3, b4) < 0").count() == 0


def test_report_is_one_json_document(spark, finished):
    lines = spark.read.text(str(finished / "report")).collect()
    assert len(lines) == 1
    report = json.loads(lines[0][0])
    assert sum(p["cases"] for p in report["products"]) == 400
    assert report["deciles"][-1]["cumulative_capture"] == 1.0
    assert {t["theme"] for t in report["topics"]} == set(THEMES)
    assert len(list((finished / "tables").iterdir())) == 25


def test_unmapped_label_stops_the_job(spark):
    raw = spark.createDataFrame([("Mortgage",), ("Lemonade",)], "product string")
    with pytest.raises(Exception, match="Unmapped label: Lemonade"):
        C.map_labels(raw, "product", "short", S.PRODUCT_LABELS).collect()
    assert C.unmapped_labels(raw, "product", S.PRODUCT_LABELS).collect() == [("Lemonade", 1)]


@pytest.mark.parametrize("split", [64, 1000, 10_000_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_in_splits(spark, tmp_path, split, end):
    """Line breaks, quotes and commas inside quotes, cut anywhere by splits: the rows of a reader that takes a file whole."""
    rng = random.Random(3)
    pieces = ["word", 'say "hi"', "a,b", "line\nbreak", '"', '""', "\n\n", "it's", "x" * 90, ""]
    for part in range(3):
        with open(tmp_path / f"part{part}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow([x.name for x in C.RAW_SCHEMA])
            for i in range(120):
                text = " ".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 40 if i % 17 == 0 else 4])))
                out.writerow([part * 1000 + i, "2020-01-02", "Mortgage", "", "i", "", text, "c", "TX", "770XX", "", "2020-01-03", "Closed", "Yes"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = spark.read.text(str(tmp_path))
        got = C.read_quoted_csv(spark, str(tmp_path))
        want = C.read_raw_csv(spark, str(tmp_path))
        if split == 64:
            assert lines.rdd.getNumPartitions() > 100
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert got.count() == 360
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
