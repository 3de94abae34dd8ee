"""The catalog queries named ..._all take all projects and requests."""

from __future__ import annotations

import __spark_entry__ as entry
from gridloom.plans.fixtures import catalog_files

from .conftest import DATA

SF = f"{DATA}/sf0.001"


def test_manifests_hold_every_file(spark):
    assert entry.queries()["manifest_urls_all"](spark, SF).count() == catalog_files(spark, SF).count()
