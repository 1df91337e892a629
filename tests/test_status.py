from __future__ import annotations

from quire.operators import status
from quire.plans.documents import documents
from tests.brute import RULE
from tests.test_figures import RENDERS, image


def test_classification_precedence(spark):
    cases = [
        ((0, None, False, True), "failed"),
        ((2, False, True, True), "failed"),
        ((1, True, True, True), "partial"),
        ((1, True, True, False), "partial"),
        ((1, True, False, True), "completed"),
        ((1, True, False, False), "failed"),
    ]
    df = spark.createDataFrame(
        [(i, *c) for i, (c, _) in enumerate(cases)],
        "i int, recovered bigint, has_content boolean, degraded boolean, success boolean",
    )
    got = status.classify_status(df).orderBy("i").collect()
    assert [r.status for r in got] == [s for _, s in cases]


def test_expected_pages(spark):
    df = spark.createDataFrame([(0,), (3,), (None,)], "page_count bigint")

    def expected(spec):
        return [r.expected for r in status.expected_pages(df, spec).collect()]

    assert expected(None) == [None, 3, None]
    assert expected("") == [None, 3, None]
    assert expected("0-4,2") == [5, 5, 5]
    assert expected("5-3") == [None, None, None]


def test_shortfall_only(spark):
    df = spark.createDataFrame(
        [(1, 3), (3, 3), (4, 3), (1, None), (0, 3)], "recovered bigint, expected bigint"
    )
    got = [r.page_error for r in status.flag_shortfall(df).collect()]
    assert got[0] == "pages incomplete: 1 of 3 came back"
    assert got[1:] == [None] * 4


def pages(*texts):
    return "".join(f"\n\n{{{i}}}{RULE}\n\n{t}" for i, t in enumerate(texts))


def judged(spark, *rows, spec=None):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], RENDERS)
    return documents(df, spec).orderBy("rel_key").collect()


def test_documents_are_judged(spark):
    lost = image("_page_0_F_0", saved=False)
    got = judged(
        spark,
        (pages("a", "b"), None, 2, []),
        (pages("a"), None, 3, []),
        (pages(" ", ""), None, 1, []),
        (None, "boom", 2, [lost]),
        ("", None, 2, [lost]),
        (pages("![](_page_0_F_0)", "b"), None, 2, [lost]),
        (pages("a"), None, 2, [lost]),
        (pages("a", "b", "c"), None, 2, None),
        (pages(" "), None, 1, [lost]),
        (pages("", " "), None, 3, []),
    )
    short = "pages incomplete: {} of {} came back"
    unsaved = "figures without an image (1): '_page_0_F_0'"
    assert [(r.status, r.recovered, r.error) for r in got] == [
        ("completed", 2, None),
        ("partial", 1, short.format(1, 3)),
        ("failed", 2, None),
        ("failed", 0, "boom"),
        ("failed", 0, status.EMPTY_RENDER),
        ("partial", 2, unsaved),
        ("partial", 1, f"{short.format(1, 2)}; {unsaved}"),
        ("completed", 3, None),
        ("failed", 1, unsaved),
        ("failed", 2, short.format(2, 3)),
    ]
    assert got[5].pages[0].text == "" and got[3].figures == []


def test_page_subset_counts_as_expected(spark):
    (row,) = judged(spark, (pages("a", "b"), None, 50, []), spec="0-2")
    assert (row.status, row.expected) == ("partial", 3)
    (row,) = judged(spark, (pages("a", "b"), None, 50, []), spec="1,0")
    assert row.status == "completed"
