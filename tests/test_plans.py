"""The physical plans that operators must keep."""

from notelake import queries
from notelake.model import DocumentFilter
from notelake.operators import graph, population
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_broken_links_are_an_anti_join(spark):
    assert "LeftAnti" in plan(graph.broken_links(queries.links(spark, SF), queries.nodes(spark, SF)))


def test_tag_filter_is_a_semi_join(spark):
    own = population.population(queries.notes(spark, SF), queries.tags(spark, SF), DocumentFilter(tags=(("lang", "en"),)))
    assert "LeftSemi" in plan(own)


def test_count_reads_no_text(spark):
    own = population.count(population.population(queries.notes(spark, SF), queries.tags(spark, SF), DocumentFilter(folder="en")))
    scan = plan(own).split("ReadSchema: ")[1].split("\n")[0]
    assert "text" not in scan


def test_pages_are_top_k(spark):
    assert "TakeOrderedAndProject" in plan(population.recent(queries.notes(spark, SF), 5))


def test_sections_per_note_are_limited_before_the_shuffle(spark):
    own = queries.sections(spark, SF)
    scores = own.select("path", "ordinal", own.ordinal.cast("double").alias("score"))
    assert "WindowGroupLimit" in plan(population.with_sections(queries.notes(spark, SF).select("path"), own, 2, scores))
