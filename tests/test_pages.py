from __future__ import annotations

import random

from quire.functions.page_text import FAILED_BODY
from quire.operators import pages
from tests import brute
from tests.brute import RULE

RENDER = "rel_key string, markdown string"


def split(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], RENDER)
    out = [[] for _ in texts]
    for r in pages.split_pages(df).orderBy("rel_key", "pos").collect():
        assert r.pos == len(out[int(r.rel_key)])
        out[int(r.rel_key)].append((r.page_no, r.text))
    return out


def test_split_cases(spark):
    cases = {
        "just one page of text": [(1, "just one page of text")],
        "": [],
        " \n \t": [],
        f"\n\n{{0}}{RULE}\n\nPage one\n\n{{1}}{RULE}\n\nPage two": [(1, "Page one"), (2, "Page two")],
        "Body with {5}--- inline": [(1, "Body with {5}--- inline")],
        f"Intro {{5}}--- here.\n\n{{0}}{RULE}\n\nOne": [(1, "Intro {5}--- here.\n\nOne")],
        f"Intro\n{{3}}{RULE}\n \n{{4}}{RULE}\nx": [(4, "Intro"), (5, "x")],
        "{0}---": [(1, "")],
        "{0}--": [(1, "{0}--")],
        f" \t{{2}}{RULE} \t\nx": [(3, "x")],
        f"{{2}}{RULE}\r\nx": [(1, f"{{2}}{RULE}\r\nx")],
        f"a {{2}}{RULE} x": [(1, f"a {{2}}{RULE} x")],
        f"{{1}}{RULE}\na\n{{1}}{RULE}\nb": [(2, "a"), (2, "b")],
        f"{{99999999999}}{RULE}\na": [(100000000000, "a")],
        f"{{5}}{RULE}\n  a  \n{{0}}{RULE}\n": [(6, "a"), (1, "")],
    }
    assert split(spark, list(cases)) == list(cases.values())


def test_null_text_has_no_pages(spark):
    assert split(spark, [None]) == [[]]


def test_split_agrees_with_brute_force(spark):
    rng = random.Random(7)
    bits = ["{0}---", "{12}-----", " {3}--- ", "\n", "\n\n", "text", " ", "{x}---", "{4}--", "\t", "---"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(400)]
    assert split(spark, texts) == [brute.pages_of(t) for t in texts]


def test_modes_of_the_split(spark):
    texts = ["plain ", f"pre\n{{0}}{RULE}\nx", f"{{0}}{RULE}\nx", " ", f"pre\n{{1}}{RULE}\n"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], RENDER)
    folded = pages.fold_preamble(df).orderBy("rel_key").collect()
    assert [tuple(r) for r in folded] == [("1", "pre", 1, "pre\n\nx"), ("4", "pre", 2, "pre")]
    assert [tuple(r) for r in pages.unpaginated_fallback(df).collect()] == [("0", 1, "plain")]


def page_table(spark, docs):
    rows = [(k, pos, no, t) for k, ps in docs.items() for pos, (no, t) in enumerate(ps)]
    return spark.createDataFrame(rows, "rel_key string, pos bigint, page_no bigint, text string")


DOCS = {
    "a": [(3, "Third"), (5, "Fifth"), (4, "")],
    "b": [(1, ""), (2, " ")],
    "hot": [(n % 50, f"t{n}") for n in range(107)],
}


def test_page_stats(spark):
    got = {r.rel_key: tuple(r)[1:] for r in pages.page_stats(page_table(spark, DOCS)).collect()}
    assert got == {"a": (3, True, 3, 5), "b": (2, False, 1, 2), "hot": (107, True, 0, 49)}


def values(df, name):
    got = {r.rel_key: r[name] for r in df.collect()}
    assert len(got) == df.count()  # a row per document
    return got


def test_pages_put_together(spark):
    docs = DOCS | {"long": [(n, f"p{n}") for n in range(5000)]}
    table = page_table(spark, docs)
    assert values(pages.page_numbers(table), "page_numbers") == {
        k: [no for no, _ in ps] for k, ps in docs.items()
    }
    bodies = values(pages.assemble_body(table), "body")
    assert bodies == {k: "".join(f"## Page {no}\n\n{t}\n\n" for no, t in ps) for k, ps in docs.items()}
    flat = values(pages.flat_text(table.where("rel_key <> 'b'")), "text")
    assert flat["long"] == "\n\n".join(t for _, t in docs["long"])
    assert flat["a"] == "Third\n\nFifth"


def test_bodies_of_documents_without_pages(spark):
    docs = spark.createDataFrame([("a",), ("none",)], "rel_key string")
    table = page_table(spark, {"a": DOCS["a"]})
    bodies = values(pages.assemble_body(table, docs), "body")
    assert bodies["none"] == FAILED_BODY and bodies["a"].startswith("## Page 3\n\nThird")


def test_parse_body_inverts_assemble_body(spark):
    table = page_table(spark, {k: [(n, t.strip()) for n, t in ps] for k, ps in DOCS.items()})
    back = pages.parse_body(pages.assemble_body(table))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))
