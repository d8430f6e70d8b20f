from __future__ import annotations

from pathlib import Path

import pytest
from batchloom import catalog

from tests.compare import same

TABLES = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    same(spark, TABLES, catalog.queries()[name], SQL[name])


def test_what_has_no_sql():
    assert set(catalog.queries()) - set(SQL) == {"patch_encode"} and not set(SQL) - set(catalog.queries())


def test_patches_are_encoded(spark):
    rows = catalog.patch_encode(spark, TABLES).collect()
    assert {r.type for r in rows} >= {1}
    for r in rows:
        assert (r.ids is None) == (r.type == 1) == (r.vectors is not None)
        if r.type:
            assert len(r.vectors) <= 64 and len({tuple(v) for v in r.vectors}) > 1 and all(len(v) == r.embed_dim for v in r.vectors)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["bucket", "batches", "samples", "padded", "real", "padding_pct"]
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_votes_take_the_whole_text(spark):
    texts = {r.doc_id: r.text for r in catalog.table(spark, TABLES, "documents").collect()}
    rows = catalog.shp_swap(spark, TABLES).collect()
    assert rows and all(texts[r.idx] in (r.chosen, r.rejected) for r in rows)
    assert any(len(texts[r.idx]) > 40 for r in rows)
