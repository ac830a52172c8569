"""The headlines read tables of a row per group, each made once, of cases that are joined with their parts once."""
import __spark_entry__ as entry
from checks import adapters

SF = "/root/testdata/sf0.001"


def test_headlines_join_the_cases_once(spark, monkeypatch):
    lines, made = adapters.lines, []
    monkeypatch.setattr(adapters, "lines", lambda spark, sf, tables="opc": made.append(tables) or lines(spark, sf, tables))
    found = entry.queries()["r4_headlines"](spark, SF)
    assert not [f for f in found.inputFiles() if "lineitem" in f]
    assert sorted(made) == ["", "opc", "p"]
