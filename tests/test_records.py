from __future__ import annotations

import pytest

from quire.operators import audit, inventory, metadata, resume, selection
from quire.sources import files
from quire.sources.index import INDEX_SCHEMA


def paths(spark, *names):
    return spark.createDataFrame([(n, 1) for n in names], "path string, size_bytes bigint")


def test_supported_extensions(spark):
    df = paths(spark, "/a/x.pdf", "/a/x.PDF", "/a/x.jpg", "/a/x", "/a/.pdf", "/a.pdf/x", "/a/b.c.Pdf")
    got = [r.path for r in files.filter_supported(df).collect()]
    assert got == ["/a/x.pdf", "/a/x.PDF", "/a/b.c.Pdf"]


def test_only_the_resolved_output_root_is_excluded(spark):
    df = paths(spark, "/in/ocr/x.pdf", "/in/ocr2/x.pdf", "/in/sub/ocr/x.pdf", "/in/x.pdf")
    kept = files.exclude_output_subtree(df, "/in/ocr")
    keys = [r.rel_key for r in files.with_relative_key(kept, "/in").collect()]
    assert keys == ["ocr2/x.pdf", "sub/ocr/x.pdf", "x.pdf"]


def test_size_gate(spark):
    mb = 1024 * 1024
    df = spark.createDataFrame([(500 * mb,), (500 * mb + 1,), (600 * mb,)], "size_bytes bigint")
    got = [r.size_error for r in files.size_gate(df).collect()]
    assert got[0] is None and "500.00 MB" in got[1]
    assert got[2] == "too large: 600.00 MB, limit 500.0 MB"


def test_checksum(spark):
    df = spark.createDataFrame([(b"abc",), (None,)], "content binary")
    got = [r.checksum for r in files.with_checksum(df).collect()]
    assert got == ["sha256:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", None]


def test_inventory(spark):
    df = spark.createDataFrame(
        [("a/b.pdf", 1536, 3), ("c.pdf", 10, None)], "rel_key string, size_bytes bigint, page_count bigint"
    )
    assert [tuple(r)[1:] for r in inventory.inventory(df).collect()] == [
        ("b.pdf", "1.5 KB", "3"), ("c.pdf", "10.0 B", "-")
    ]
    assert tuple(inventory.inventory_totals(df).first()) == (2, 1546, "1.5 KB")
    assert tuple(inventory.inventory_totals(df.limit(0)).first()) == (0, 0, "0.0 B")


def fingerprint(spark, *options):
    return spark.range(1).selectExpr(selection.run_fingerprint(*options)).first()[0]


def test_fingerprint_sees_effects_not_spelling(spark):
    base = fingerprint(spark, "m", "b", False, "1,3")
    assert base == fingerprint(spark, "m", "b", False, "3, 1,1")
    assert fingerprint(spark, "m", "b", False, "1-3") == fingerprint(spark, "m", "b", False, "3,2,1")
    others = [("m", "b", False, "1-3"), ("m", "b", True, "1,3"), ("m", "b", False, None),
              ("n", "b", False, "1,3"), ("m", "it's", False, "1,3"), ("m", "b", False, "5-3")]
    assert len({base, *(fingerprint(spark, *o) for o in others)}) == 7


def test_expand_and_select(spark):
    docs = spark.createDataFrame([("a", "0-9000,3"), ("b", None), ("c", "x"), ("d", "5-3,2")],
                                 "rel_key string, spec string")
    got = sorted(map(tuple, selection.expand_page_specs(docs).collect()))
    assert got == [("a", i) for i in range(9001)] + [("d", 2)]
    pages = spark.createDataFrame([("a", 0, 9001, "x"), ("a", 1, 9002, "y"), ("d", 0, 3, "z"), ("d", 1, 3, "w"), ("b", 0, 1, "v")],
                                  "rel_key string, pos bigint, page_no bigint, text string")
    kept = selection.select_pages(pages, selection.expand_page_specs(docs))
    assert sorted(r.text for r in kept.collect()) == ["w", "x", "z"]
    assert sorted(r.text for r in selection.select_pages(pages, "2,0").collect()) == ["v", "w", "z"]
    assert selection.select_pages(pages, None).count() == 5
    assert selection.select_pages(pages, "5-3").count() == 0
    with pytest.raises(ValueError):
        selection.select_pages(pages, "a")
    literal = selection.expand_page_specs(docs.select("rel_key"), "1,0")
    assert literal.count() == 8


def test_plan(spark):
    f = spark.createDataFrame([(k, c) for k, c in (
        ("same", "c1"), ("changed", "c2"), ("partial", "c1"), ("other-fp", "c1"), ("gone", "c1"),
        ("new", "c1"), ("unreadable", None))], "rel_key string, checksum string")
    index = spark.createDataFrame(
        [("same", "completed", "c1", "fp", "same.md"), ("changed", "completed", "c1", "fp", "changed.md"),
         ("partial", "partial", "c1", "fp", "partial.md"), ("other-fp", "completed", "c1", "old", "other.md"),
         ("gone", "completed", "c1", "fp", "gone.md"), ("unreadable", "completed", "c1", "fp", "u.md")],
        "key string, status string, checksum string, fingerprint string, output_path string")
    there = spark.createDataFrame([(p,) for p in ("same.md", "changed.md", "partial.md", "other.md", "u.md")],
                                  "output_path string")
    plan = resume.plan_run(f, index, "fp", there)
    skipped = [r.rel_key for r in plan.collect() if r.action == "skip"]
    assert skipped == ["same"] and plan.count() == 7
    todo = {r.rel_key for r in resume.pending(f, index, "fp", there).collect()}
    assert todo == {"changed", "partial", "other-fp", "gone", "new", "unreadable"}
    assert [tuple(r) for r in resume.cached_outcomes(plan).collect()] == [("same", "completed", "same.md")]
    again = resume.plan_run(f, index, "fp", there, reprocess=True)
    assert {r.action for r in again.collect()} == {"convert"}
    assert resume.pending(f, index, "fp", there, reprocess=True).count() == 7


def test_output_paths(spark):
    cases = {"a/b/x.pdf": "a/b/x/x.md", "x.PDF": "x/x.md", "x": "x/x.md", "a.b/x.y.pdf": "a.b/x.y/x.y.md",
             ".pdf": ".pdf/.pdf.md", "a.b/x": "a.b/x/x.md"}
    df = spark.createDataFrame([(k,) for k in cases], "rel_key string")
    assert [r.output_path for r in metadata.output_paths(df).collect()] == list(cases.values())


def record(key, **changes):
    base = dict(key=key, status="completed", checksum="sha256:1", model="m", backend="b", processing_time=1.0,
                timestamp=None, output_path=f"{key}.md", pages=1, error=None, fingerprint="f")
    return tuple({**base, **changes}.values())


def test_upsert_keeps_the_newest_record(spark):
    old = spark.createDataFrame([record("a"), record("b"), record("c", pages=9)], INDEX_SCHEMA)
    new = spark.createDataFrame([record("b", status="partial", error="e"), record("d")], INDEX_SCHEMA)
    got = {r.key: (r.status, r.pages, r.error) for r in metadata.upsert_index(old, new).collect()}
    assert got == {"a": ("completed", 1, None), "b": ("partial", 1, "e"), "c": ("completed", 9, None),
                   "d": ("completed", 1, None)}
    assert [f.name for f in metadata.upsert_index(old, new).schema] == list(metadata.METADATA_COLUMNS)


def test_planning_and_upserting_neither_group_nor_sort_the_index(spark):
    index = spark.createDataFrame([record("a")], INDEX_SCHEMA)
    files_ = spark.createDataFrame([("a", "sha256:1")], "rel_key string, checksum string")
    for df in (metadata.upsert_index(index, index),
               resume.plan_run(files_, index, "f", index.select("output_path"))):
        assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_outcome(spark):
    df = spark.createDataFrame(
        [("a", "completed", "a.md"), ("b", "partial", "b.md"), ("c", "failed", "c.md"), ("d", "completed", "d.md")],
        "rel_key string, status string, output_path string")
    assert tuple(metadata.run_outcome(df).first()) == (2, 1, 1, 4, 1)
    assert tuple(metadata.run_outcome(df.where("status = 'completed'")).first()) == (2, 0, 0, 2, 0)
    assert tuple(metadata.run_outcome(df.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert {r.rel_key for r in metadata.written_outputs(df).collect()} == {"a", "b", "d"}


def test_audits(spark):
    pages = spark.createDataFrame(
        [("a", 0, 1, "![](./figures/figure_1_page1.png) ![](missing.png) ![](http://x/y.png) ![](#top)"),
         ("a", 1, 2, "![](./figures/figure_1_page1.png)"), ("b", 0, 1, "![](./figures/figure_1_page1.png)")],
        "rel_key string, pos bigint, page_no bigint, text string")
    figs = spark.createDataFrame([("a", "./figures/figure_1_page1.png"), ("b", None)], "rel_key string, link string")
    got = {(r.rel_key, r.link) for r in audit.dangling_links(pages, figs).collect()}
    assert got == {("a", "missing.png"), ("b", "./figures/figure_1_page1.png")}
    (row,) = audit.page_tag_mismatch(pages).collect()
    assert (row.rel_key, row.page_no, row.tag_page) == ("a", 2, 1)

    meta = spark.createDataFrame(
        [record("a"), record("b", pages=2), record("c", checksum="md5:1"), record("d", checksum="sha256:"),
         record("e", checksum=None)], INDEX_SCHEMA)
    assert {r.key for r in audit.bad_checksums(meta).collect()} == {"c", "d", "e"}
    expected = spark.createDataFrame(
        [("a", 1, "completed"), ("b", 1, "completed"), ("c", None, "failed"), ("d", None, "completed"),
         ("x", 1, "failed")], "rel_key string, pages bigint, status string")
    diff = {r.rel_key: r.problem for r in audit.expectation_diff(expected, meta).collect()}
    assert diff == {"b": "different", "c": "different", "e": "unexpected", "x": "missing"}
    index = spark.createDataFrame([record("a"), record("b"), record("c", checksum="md5:1"), record("z")], INDEX_SCHEMA)
    both = {r.key: r.problem for r in audit.index_vs_metadata(index, meta).collect()}
    assert both == {"b": "different", "d": "not in index", "e": "not in index", "z": "no metadata"}
    wanted = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 3, 3)], "rel_key string, figure_no bigint, page_no bigint")
    actual = spark.createDataFrame([("a", 1, 1), ("a", 2, 4), ("b", 1, 1), ("a", None, 9)], wanted.schema)
    got = {tuple(r) for r in audit.figure_diff(wanted, actual).collect()}
    assert got == {("a", 2, 3, 4), ("a", 3, 3, None), ("b", 1, None, 1)}
    keys = spark.createDataFrame([("a/x.pdf",), ("a/x.PDF",), ("b/x.pdf",)], "rel_key string")
    (hit,) = audit.path_collisions(keys).collect()
    assert tuple(hit) == ("a/x/x.md", 2, "a/x.PDF", "a/x.pdf")
