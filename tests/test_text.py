from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import figure_keys, text
from quire.functions.page_specs import merge_pieces, parse_literal, parsed_pieces, ranges_size


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).selectExpr(*exprs).collect()]


def test_whitespace_is_what_unicode_says():
    assert len(text.WHITESPACE) == 29
    assert all(c.isspace() for c in text.WHITESPACE)


def test_strip_every_kind_of_space(spark):
    rows = [(f"{c}x y{c}",) for c in text.WHITESPACE] + [("​z",), ("",), (" \n\t",)]
    got = values(spark, rows, "s string", text.strip("s"))
    assert [g for (g,) in got] == [s.strip() for (s,) in rows]


def test_human_size(spark):
    cases = {
        0: "0.0 B", 500: "500.0 B", 1023: "1023.0 B", 1024: "1.0 KB", 1280: "1.2 KB", 1536: "1.5 KB",
        1792: "1.8 KB", 1 << 20: "1.0 MB", (1 << 20) - 1: "1024.0 KB", 1280 << 10: "1.2 MB",
        1 << 30: "1.0 GB", 1792 << 20: "1.8 GB", 1 << 40: "1.0 TB", 5 << 50: "5120.0 TB", None: None,
    }
    got = values(spark, [(s,) for s in cases], "s bigint", text.human_size("s"))
    assert [g for (g,) in got] == list(cases.values())


def test_source_page_saturates(spark):
    rows = [("0",), ("11",), ("99999999999",), ("9" * 30,)]
    got = values(spark, rows, "s string", text.source_page("s"))
    assert got == [(1,), (12,), (100000000000,), ((1 << 63) - 1,)]


def test_figure_keys(spark):
    cases = {
        "_page_1_Figure_10.jpeg": (2, 10),
        "page_2_Picture_3.png": (3, 3),
        "Page-7-x.png": (8, 0),
        "PAGE12_4": (13, 4),
        "cover.png": (1, 0),
        "img_5": (1, 5),
        "img_5.tar.gz": (1, 0),
        "_page_3_page_9_Figure_1.jpeg": (4, 1),
    }
    exprs = [figure_keys.key_page("k"), figure_keys.key_block("k")]
    got = values(spark, [(k,) for k in cases], "k string", *exprs)
    assert got == list(cases.values())


def test_png_mode(spark):
    cases = {
        ("RGB", False): "RGB", ("RGBA", False): "RGBA", ("LA", False): "RGBA",
        ("PA", None): "RGBA", ("P", True): "RGBA", ("P", False): "RGB", ("P", None): "RGB",
        ("L", True): "RGB", ("1", False): "RGB", ("CMYK", False): "RGB",
    }
    got = values(spark, list(cases), "m string, t boolean", figure_keys.png_mode("m", "t"))
    assert [g for (g,) in got] == list(cases.values())


def test_key_token_is_found_around_every_occurrence(spark):
    keys = ["a.png", "a(1).png", "(x", "x)", ")(", "()", "a(b(c).d", "a)b(c", "x y", "("]
    rows = [(k, f"q (z) ({k} ![al(t)]({k}) (") for k in keys]
    got = values(
        spark, rows, "k string, t string",
        f"array_contains({figure_keys.text_tokens('t')}, {figure_keys.key_token('k')})",
    )
    assert got == [(True,)] * len(keys)


# Selections and how many pages they name.
SPECS = {"0-5": 6, "3,1": 2, "1-3, 2": 3, "5-3": 0, " 4 ": 1, "1,3,5": 3, "7-7,8,9-12": 6,
         "0-2,1-1,2-4": 5, "+3": 1, "1_0": 1, "2--1": 0, "0-100000": 100001}
BAD = ["a", "-3", "1,,2", " ", "1-", "-", "1.5", "1-2-3"]


def test_page_specs_agree_with_the_literal_parser(spark):
    rows = [(s,) for s in SPECS]
    ranged = spark.createDataFrame(rows, "s string").withColumn("p", F.expr(parsed_pieces("s")))
    got = ranged.selectExpr(f"{merge_pieces('p')} as r").selectExpr("r", ranges_size("r")).collect()
    for (spec,), (ranges, size) in zip(rows, got, strict=True):
        assert [tuple(r) for r in ranges] == parse_literal(spec), spec
        assert size == SPECS[spec], spec


def test_a_huge_range_stays_one_struct(spark):
    sized = f"{ranges_size(merge_pieces(parsed_pieces('s')))}"
    (got,) = values(spark, [("0-999999999999,5",)], "s string", sized)
    assert got == (10**12,)


@pytest.mark.parametrize("spec", BAD)
def test_unreadable_page_specs(spark, spec):
    with pytest.raises(ValueError):
        parse_literal(spec)
    from quire.operators.selection import parse_page_specs

    (row,) = parse_page_specs(spark.createDataFrame([(spec,)], "spec string")).collect()
    assert row.ranges is None and row.spec_error


def test_no_page_spec(spark):
    assert parse_literal(None) is None and parse_literal("") is None
    from quire.operators.selection import parse_page_specs

    rows = parse_page_specs(spark.createDataFrame([(None,), ("",)], "spec string")).collect()
    assert [(r.ranges, r.spec_error) for r in rows] == [(None, None)] * 2


def test_a_selection_that_cannot_be_counted_is_its_row_s_error(spark):
    from quire.operators.selection import expand_page_specs, parse_page_specs
    from quire.operators.status import expected_pages

    huge = "0-9223372036854775807"
    docs = spark.createDataFrame(
        [("a", huge, 3), ("b", "1,0", 3), ("c", f"0-{10**12}", 3)],
        "rel_key string, spec string, page_count bigint",
    )
    parsed = parse_page_specs(docs)
    errors = {r.rel_key: r.spec_error for r in parsed.collect()}
    assert errors == {"a": f"too many pages: {huge}", "b": None, "c": f"too many pages: 0-{10**12}"}
    assert sorted(map(tuple, expand_page_specs(docs).collect())) == [("b", 0), ("b", 1)]
    counts = {r.rel_key: r.expected for r in expected_pages(parsed, ranges="ranges").collect()}
    assert counts["b"] == 2
    assert values(spark, [(huge,)], "s string", ranges_size(merge_pieces(parsed_pieces("s")))) == [(None,)]
