"""A clustering run with its summary and the counts of its own job."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leadlight.operators import search as S
from leadlight.plans import clusters as C


@pytest.fixture(scope="module")
def library(spark):
    rng, rows = random.Random(1), []
    for g in range(6):
        base = rng.getrandbits(60)
        rows += [(10 * g + i, f"c{10 * g + i}", f"s{g}", [base ^ (1 << rng.randrange(60) if i else 0)], g / 2 + i) for i in range(g + 1)]
    return spark.createDataFrame([*rows, (98, "bad", "?", None, 1.0), (99, "worse", "?", None, None)], "row long, Compound_ID string, SMILES string, fp array<long>, QED double")


def test_run(spark, library, tmp_path):
    facts = C.cluster_run(library, 60, str(tmp_path / "run"), 0.7, context=("QED",))
    assert facts == json.loads((tmp_path / "run/cluster_metadata.json").read_text())
    assert facts["counts"] == {"rows_in_input": 23, "molecules_clustered": 21, "invalid_smiles": 2}
    table = {r["Compound_ID"]: r for r in spark.read.parquet(str(tmp_path / "run/assignments")).collect()}
    sizes = {}
    for r in table.values():
        if r["Cluster_ID"] is not None:
            sizes[r["Cluster_ID"]] = sizes.get(r["Cluster_ID"], 0) + 1
    assert all(r["Cluster_Size"] == sizes[r["Cluster_ID"]] for r in table.values() if r["Cluster_ID"] is not None) and table["bad"]["Cluster_ID"] is None
    assert facts["clusters"] == {"count": len(sizes), "sizes_top10": sorted(sizes.values(), reverse=True)[:10]}
    for r in spark.read.parquet(str(tmp_path / "run/summary")).collect():
        mine = [x for x in table.values() if x["Cluster_ID"] == r["Cluster_ID"]]
        assert r["Count"] == len(mine) and r["Representative"] in {x["Compound_ID"] for x in mine} == set(r["Example_Compounds"].split(", ")) | {x["Compound_ID"] for x in mine}
        assert r["QED_mean"] == pytest.approx(sum(x["QED"] for x in mine) / len(mine))


def test_search_counts(library):
    queries = library.where("row % 10 = 0 or row > 90")
    hits, counts = C.search_counts(queries, S.batch_search(queries, library, 60, threshold=0.5, top=3))
    assert counts == {"queries": 8, "valid": 6, "failed": ["bad", "worse"], "hits": hits.count()}
    assert hits.where(F.col("Query_ID") == "bad").count() == 0
