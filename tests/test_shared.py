"""Derived tables written once per application and input folder."""

import os
import shutil

from leadlens.plans import catalog  # noqa: F401  (registers the queries)
from leadlens.plans.lead_queries import LEAD_INPUTS, leads_df
from leadlens.plans.shared import input_signature, shared
from leadlens.sources.tables import lead_table
from tests.conftest import SF_SMALL


def test_lead_table_written_once_and_equal(spark):
    a = leads_df(spark, SF_SMALL)
    b = leads_df(spark, SF_SMALL + "/")
    assert a is b                                   # same written table, no second write
    fresh = lead_table(spark, SF_SMALL)
    assert a.exceptAll(fresh).count() == 0 and fresh.exceptAll(a).count() == 0


def test_signature_follows_input_files(spark, tmp_dir):
    src = os.path.join(tmp_dir, "sf")
    os.makedirs(src)
    for t in ["region", "nation"]:
        shutil.copy(f"{SF_SMALL}/{t}.parquet", f"{src}/{t}.parquet")
    before = input_signature(spark, src, ["region", "nation"])
    assert before == input_signature(spark, src, ["region", "nation"])
    assert before != input_signature(spark, src, ["region"])
    calls = []
    build = lambda: calls.append(1) or len(calls)
    assert shared(spark, src, "probe", ["region"], build) == 1
    assert shared(spark, src, "probe", ["region"], build) == 1          # reused
    os.remove(f"{src}/region.parquet")
    shutil.copy(f"{SF_SMALL}/nation.parquet", f"{src}/region.parquet")  # replaced input
    assert shared(spark, src, "probe", ["region"], build) == 2          # rebuilt
    assert set(LEAD_INPUTS) == {"customer", "nation", "region", "orders", "lineitem"}
