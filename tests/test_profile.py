"""The profile of a report against its single parts, pages as files, and the combined text."""

import json

import pytest

from leadlight.operators import analyze as A
from leadlight.operators import picklists as P
from leadlight.plans import reports


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"C{i:02}", None if i == 3 else float("nan") if i == 4 else i / 7, 5.0, "High" if i % 3 == 0 else "Low" if i % 3 == 1 else None, i % 2 == 0, i / 9) for i in range(25)]
    return spark.createDataFrame(rows, "Compound_ID string, CNS_MPO double, QED double, Tox_Risk string, RO5_Pass boolean, Sim_Ref double").cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_profile_equals_its_parts(table):
    histograms, bars = A.profile(table, ["CNS_MPO", "QED"], ["Tox_Risk", "RO5_Pass"], 7, 2)
    for c in ("CNS_MPO", "QED"):
        want, got = A.histogram(table, c, 7).collect(), histograms.where(f"column = '{c}'").drop("column").collect()
        assert sorted((r[0], r[3]) for r in got) == sorted((r[0], r[3]) for r in want)
        assert [x for r in sorted(got) for x in r[1:3]] == pytest.approx([x for r in sorted(want) for x in r[1:3]])
    for c in ("Tox_Risk", "RO5_Pass"):
        assert rows(bars.where(f"column = '{c}'").select("value", "n")) == rows(A.category_bars(table, c, 2))
        first = A.top_rows(table, [c], bars, "Compound_ID", 6).orderBy("place").collect()
        assert [r["id"] for r in first] == [r["Compound_ID"] for r in A.top_table(table, c, "Compound_ID", 6).collect()]
    assert [r["id"] for r in A.top_rows(table, ["CNS_MPO"], bars, "Compound_ID", 3).orderBy("place").collect()] == ["C24", "C23", "C22"]
    empty = A.profile(table.where("false"), ["QED"], ["Tox_Risk"])
    assert empty[0].count() == empty[1].count() == 0


def test_report_has_a_similarity_section(table):
    text = reports.build_report(table, "Lot")
    assert "## Similarity" in text and "Sim_Ref: n 25" in text and "| C24 |" in text


def test_pages_are_files(table, tmp_path):
    lists = [P.Picklist("a", "A", "", "all", (P.Rule("CNS_MPO", ">", 1), P.Rule("absent", ">", 1)), (P.Order("CNS_MPO", False),), 4, (), ()), P.Picklist("b", "B", "", "all", (P.Rule("Tox_Risk", "==", "Low"),), (), 0, (), ())]
    paths = reports.run_picklists(table, lists, str(tmp_path / "out"))
    page = (tmp_path / "out/a.html").read_text()
    assert "missing column: absent" in page and page.index("C24") < page.index("C21") and "C20" not in page
    facts = json.loads((tmp_path / "out/metadata.json").read_text())["parameters"]
    assert facts["rows"] == {"a": 4, "b": 8} and any("absent" in w for w in facts["warnings"])
    assert "warnings" not in (tmp_path / "out/b.html").read_text() and set(paths) == {"a", "b"}


def test_combined_text(table):
    text = reports.combined_text(table, "lot.csv", top=2, values=2)
    assert text.startswith("dataset: lot.csv\ncompounds: 25\ncolumns: 6\n")
    assert "CNS_MPO: mean=" in text and "  C24 | CNS_MPO=" in text and "QED: mean=5.000, median=5.000" in text
    assert "Tox_Risk=High: 9 (36.0%)" in text and "Tox_Risk: 1 other values" in text and "C22 | CNS_MPO" not in text
