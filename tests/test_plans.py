"""What the plans look like: exchanges, joins, pruning."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as driver
from quire.operators import audit, figures, pages, resume, selection
from quire.operators.convert import convert
from quire.plans.documents import document_figures, documents
from tests.test_figures import RENDERS, image, renders
from tests.test_queries import SF_DIR


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def render_table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("renders") / "t")
    renders(spark, {"a": ("x", [image("k")])}).write.parquet(path)
    return spark.read.schema(RENDERS).parquet(path)


def test_narrow_operators_do_not_shuffle(render_table):
    for df in (
        pages.split_pages(render_table),
        pages.fold_preamble(render_table),
        documents(render_table),
        document_figures(documents(render_table)),
        figures.parse_figure_key(figures.explode_images(render_table)),
        figures.extract_image_refs(pages.split_pages(render_table)),
    ):
        assert "Exchange" not in physical(df)


def test_text_is_split_once_per_row(render_table):
    for df in (
        pages.split_pages(render_table).where("page_no > 1"),
        documents(render_table).where("status = 'failed'"),
    ):
        plan = physical(df)
        assert len(re.findall(r"regexp_extract_all\(markdown", plan)) == 1
        assert len(re.findall(r"[ (]split\(markdown", plan)) == 1


def test_only_needed_columns_are_read(render_table):
    plan = physical(pages.split_pages(render_table))
    assert "ReadSchema: struct<rel_key:string,markdown:string>" in plan
    plan = physical(documents(render_table).select("rel_key", "status"))
    assert "page_count:bigint" in plan and "processing_time" not in plan


def test_links_join_on_document_and_token(spark, render_table):
    table = pages.split_pages(render_table)
    figs = figures.figure_links(
        figures.number_figures(figures.parse_figure_key(figures.explode_images(render_table)))
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(figures.relink(table, figs))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(rel_key#\d+, _token#\d+", plan)
    assert not re.search(r"hashpartitioning\(rel_key#\d+, \d+\).*\n.*text#", plan)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.shuffle.partitions": "16",
}


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return physical(df)


def test_joins_split_a_key_that_holds_most_rows(spark):
    """A third and more of all links name one figure of one document."""
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    try:
        pages_ = spark.range(30_000, numPartitions=8).selectExpr(
            "if(id % 3 > 0, 'hot', concat('d', id)) as rel_key", "id as pos", "id + 1 as page_no",
            "if(id % 3 > 0, '![](logo.png)', concat('![](k', id, ')')) as text",
        )
        figs = spark.range(30_000, numPartitions=8).where("id % 3 = 0").selectExpr(
            "concat('d', id) as rel_key", "concat('k', id) as img_key", "1L as page_no",
            "0L as block_id", "1L as figure_no", "'./figures/figure_1_page1.png' as link",
        ).union(spark.sql(
            "select 'hot', 'logo.png', 1L, 0L, 1L, './figures/figure_1_page1.png'"
        ))
        linked = figures.relink(pages_, figs)
        assert "skew=true" in final_plan(linked)
        assert linked.where("text = '![](./figures/figure_1_page1.png)'").count() == 30_000
        assert "skew=true" in final_plan(audit.dangling_links(pages_, figs))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_done_documents_never_reach_the_converter(spark):
    schema = "rel_key string, path string, checksum string"
    files = spark.createDataFrame([("a", "a", "c")], schema)
    index = spark.createDataFrame(
        [], "key string, status string, checksum string, fingerprint string, output_path string"
    )
    todo = resume.pending(files, index, "fp", index.select("output_path"))
    plan = physical(convert(todo, lambda told: None))
    assert plan.index("MapInPandas") < plan.index("LeftAnti")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_no_query_pairs_everything_with_everything(spark, name):
    plan = physical(driver.queries()[name](spark, SF_DIR))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_selections_meet_pages_as_ranges(spark, render_table):
    """No id is unfolded, however many a selection names."""
    specs = spark.createDataFrame(
        [("a", "0-2000000000,5"), ("b", None), ("c", "x"), ("d", "1,3-4,8-9")], "rel_key string, spec string"
    )
    rows = [(k, n, n + 1, "t") for k in "abcde" for n in range(10)]
    table = spark.createDataFrame(rows, "rel_key string, pos bigint, page_no bigint, text string")
    made = selection.select_pages(table, specs)
    assert "Generate" not in physical(made)
    got = {}
    for r in made.collect():
        got.setdefault(r.rel_key, []).append(r.page_no - 1)
    assert {k: sorted(v) for k, v in got.items()} == {
        "a": list(range(10)), "b": list(range(10)), "d": [1, 3, 4, 8, 9]
    }


def test_pages_without_a_parenthesis_stay_where_they_are(spark, render_table):
    figs = figures.figure_links(
        figures.number_figures(figures.parse_figure_key(figures.explode_images(render_table)))
    )
    plan = figures.relink(pages.split_pages(render_table), figs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")
