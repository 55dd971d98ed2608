"""pages are ranked where their pairs are found, and ``gbt_scores`` ranks them once."""

from __future__ import annotations

import pytest

from kinmark.operators import blocking, ranking
from kinmark.params import DEFAULT
from kinmark.plans import queries
from kinmark.sources import entities as src


def _page(i: int, lang: str) -> tuple[int, str, str]:
    words = ("alder", "birch", "cedar", "dogwood", "elm")
    title = f"{words[i % 5]} {words[i // 3 % 5]}"
    return i, f"http://{words[i % 4]}.example/{i % 7}", f'<html lang="{lang}"><title>{title}</title>'


@pytest.mark.parametrize("langs", [("en", "fr"), ("en", "")])
def test_pages_are_ranked_in_cells(spark, tmp_path, langs):
    rows = [_page(i, langs[i % 8 == 3]) for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    prepared = queries.pages(spark, str(tmp_path))
    want = sorted(ranking.rank_by_overlap(blocking.block(prepared, DEFAULT), prepared, 60).collect())
    plan = queries._ranked_pages(spark, str(tmp_path))
    assert want and sorted(plan.collect()) == want
    assert ("Join" in plan._jdf.queryExecution().optimizedPlan().toString()) == ("" in langs)


def test_scores_come_from_one_ranking(spark, tmp_path, monkeypatch):
    spark.createDataFrame([_page(i, "en") for i in range(60)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    made, rank = [], queries._ranked_pages
    monkeypatch.setattr(queries, "_ranked_pages", lambda *x: made.append(x) or rank(*x))
    monkeypatch.setattr(queries, "GBT_ROUNDS", 1)
    scores = queries.gbt_scores(spark, str(tmp_path))
    assert len(made) == 1 and scores.count() == rank(spark, str(tmp_path)).count()
    spark.catalog.clearCache()
