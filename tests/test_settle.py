from __future__ import annotations

from pathlib import Path

import pytest
from batchloom.plans import settle


def tables(spark) -> set[str]:
    at = Path(settle.folder(spark).removeprefix("file://"))
    return {p.name for p in at.iterdir()} if at.exists() else set()


def test_scratch_leaves_what_is_kept(spark):
    before = tables(spark)
    with settle.scratch(spark):
        settle.cut(spark.range(3))
        with settle.scratch(spark):
            inner = settle.cut(spark.range(4), keep=True)
        assert inner.count() == 4
        kept = settle.cut(inner, keep=True)
    assert kept.count() == 4 and len(tables(spark) - before) == 1
    with pytest.raises(RuntimeError, match="no"), settle.scratch(spark):
        settle.cut(spark.range(1))
        raise RuntimeError("no")
    assert len(tables(spark) - before) == 1
    settle.clear(spark)
    assert tables(spark) <= before


def test_no_option_is_set(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    settle.folder(spark)
    assert spark.conf.get("spark.checkpoint.dir", None) == before
