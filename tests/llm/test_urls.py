from __future__ import annotations

import random
import re

import pytest
from batchloom.llm import urls
from pyspark.sql import functions as F

from tests.llm.common import empty

STRICT, SOFT = {"bad-win": 9, "xx": 5}, {"win": 2, "bad": 1, "été": 3, "xxx": 1}


def brute(url: str | None) -> tuple:
    low = "".join(c.lower() if c.isascii() else c for c in url or "")
    hits = {t: len(re.findall(f"(?<![a-z0-9])(?={re.escape(t)}(?![a-z0-9]))", low)) for t in (*STRICT, *SOFT)}
    strict, soft = sum(hits[t] for t in STRICT), sum(hits[t] for t in SOFT)
    terms = sum(hits[t] > 0 for t in SOFT)
    return strict, soft, terms, sum(n * {**SOFT, **STRICT}[t] for t, n in hits.items()), strict > 0 or terms >= 2


def test_equals_brute_force(spark):
    rng = random.Random(1)
    found = ["http://", "BAD", "win", "bad-win", "xx", "xxx", "-", "/", "_", ".", "a", "7", "été", "ÉTÉ", "é", "?", "=", "\n", "日本"]
    links = [None, "", "xx", "xxxx", "x" * 100_000, "bad-win-bad-win"] + ["".join(rng.choice(found) for _ in range(rng.randrange(1, 14))) for _ in range(500)]
    pages = spark.createDataFrame([(i % 400, u, "h") for i, u in enumerate(links)], "page_id bigint, url string, rejected string")
    got = urls.judge_urls(pages, strict=STRICT, soft=SOFT).collect()
    assert sorted(tuple(r) for r in got) == sorted((i % 400, *brute(u)) for i, u in enumerate(links))


def test_hits_stay_within_a_row(spark):
    pages = spark.createDataFrame([(1, "http://a/b"), (2, "ad"), (3, "/x")], "page_id bigint, url string").coalesce(1)
    assert not any(r.rejected for r in urls.judge_urls(pages, strict={"bad": 1, "d/x": 1}, soft={}).collect())


def test_limits_and_empty_cases(spark):
    pages = spark.createDataFrame([(1, "a/win/win"), (2, "a/win/bad"), (None, "xx")], "page_id bigint, url string")
    got = {r.page_id: r for r in urls.judge_urls(pages, strict=STRICT, soft=SOFT).collect()}
    assert not got[1].rejected and got[1].soft_hits == 2 and got[1].soft_terms == 1
    assert got[2].rejected and got[None].rejected
    assert not any(r.rejected for r in urls.judge_urls(pages, strict={}, soft={}).collect())
    assert urls.judge_urls(empty(spark, "page_id bigint, url string")).count() == 0
    assert urls.judge_urls(pages.withColumn("score", F.lit(1)), strict={"win": 1}, soft={"win": 1}).where("rejected").count() == 2
    with pytest.raises(ValueError):
        urls.judge_urls(pages, strict={f"t{i}": 1 for i in range(urls.MOST_TERMS + 1)})


def test_case_of_letters_beyond_ascii(spark):
    pages = spark.createDataFrame([(1, "/É/"), (2, "/é/"), (3, "/ÉB/"), (4, "/Éb/")], "page_id bigint, url string")
    got = {r.page_id: r.strict_hits for r in urls.judge_urls(pages, strict={"É": 1, "ÉB": 1}, soft={}).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1}
