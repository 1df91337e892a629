from __future__ import annotations

import random
import re
import time

import pytest

from quire.operators import figures
from quire.operators.pages import split_pages
from quire.plans.documents import document_figures, document_pages, documents
from tests.brute import RULE

RENDERS = (
    "rel_key string, markdown string, error string, page_count bigint, "
    "images array<struct<key:string,mode:string,has_transparency:boolean,png:binary>>"
)


def image(key, saved=True):
    return (key, "RGB", False, b"png" if saved else None)


def renders(spark, docs):
    """docs: {rel_key: (markdown, [images])}"""
    rows = [(k, m, None, None, images) for k, (m, images) in docs.items()]
    return spark.createDataFrame(rows, RENDERS)


def linked(spark, docs):
    raw = figures.parse_figure_key(figures.explode_images(renders(spark, docs)))
    return figures.figure_links(figures.number_figures(raw))


def test_numbers_follow_page_and_block_not_spelling(spark):
    keys = [f"_page_{p}_Figure_{b}.jpeg" for p in (10, 2, 0) for b in (10, 2)]
    got = linked(spark, {"a": ("x", [image(k) for k in keys])}).orderBy("figure_no").collect()
    want = [(p, b) for p in (1, 3, 11) for b in (2, 10)]
    assert [(r.page_no, r.block_id) for r in got] == want
    assert [r.link for r in got] == [
        f"./figures/figure_{i + 1}_page{p}.png" for i, (p, _) in enumerate(want)
    ]


def test_a_failed_figure_takes_no_number(spark):
    images = [image("_page_0_A_0"), image("_page_0_A_1", saved=False), image("_page_0_A_2")]
    got = {r.img_key: (r.figure_no, r.link) for r in linked(spark, {"a": ("x", images)}).collect()}
    assert got["_page_0_A_1"] == (None, None)
    assert got["_page_0_A_2"][0] == 2


def test_numbering_starts_no_job_and_runs_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)
    raw = figures.parse_figure_key(figures.explode_images(renders(spark, {"a": ("x", [image("k")] * 3)})))

    def counting(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    numbered = figures.number_figures(raw.mapInPandas(counting, raw.schema))
    assert seen.value == 0
    assert sorted(r.figure_no for r in numbered.collect()) == [1, 2, 3] and seen.value == 3


def test_failures_are_listed_in_source_order_in_one_row(spark):
    images = [image(f"_page_{p}_F_0", saved=False) for p in (11, 2, 0)]
    many = [image(f"_page_{p}_F_0", saved=False) for p in range(4100)]
    raw = figures.parse_figure_key(
        figures.explode_images(
            renders(spark, {"a": ("x", images), "b": ("x", [image("k")]), "c": ("x", many)})
        )
    )
    one, two = figures.figure_failures(raw).orderBy("rel_key").collect()
    assert tuple(one) == (
        "a", 3, "figures without an image (3): '_page_0_F_0', '_page_2_F_0', '_page_11_F_0'"
    )
    assert two.failed == 4100 and two.detail.endswith("'_page_4099_F_0'")


SAVED = ["a.png", "fig(1).png", "p(q", ".*", "$1", "a b"]
LOST = ["b.png", "fig(2).png", "x)y", "\\E+"]


def composed(rng, link):
    """A page's text and the text that it should become, put together from the same pieces."""
    given, wanted = "", ""
    for _ in range(rng.randrange(0, 25)):
        key = rng.choice(SAVED + LOST)
        alt = rng.choice(["", "al\nt", "x"])
        kind = rng.randrange(4)
        if kind == 0:
            text = becomes = rng.choice(["word ", ")", " ", "![x]", key + " ", "(other)"])
        elif kind == 1:
            text = f"[see]({key}) "
            becomes = f"[see]({link.get(key, key)}) "
        else:
            text = f"![{alt}]({key}) "
            becomes = f"![{alt}]({link[key]}) " if key in link else " "
        given, wanted = given + text, wanted + becomes
    return given, wanted


@pytest.mark.parametrize("seed", [1, 2])
def test_links_are_set_and_dropped(spark, seed):
    rng = random.Random(seed)
    # Keys without numbers stand in the order of their spelling, on page 1.
    link = {k: f"./figures/figure_{i + 1}_page1.png" for i, k in enumerate(sorted(SAVED))}
    images = [image(k) for k in SAVED] + [image(k, saved=False) for k in LOST]
    docs, want = {}, []
    for d in range(40):
        pages = [composed(rng, link) for _ in range(rng.randrange(1, 5))]
        docs[f"d{d}"] = ("".join(f"\n\n{{{p}}}{RULE}\n\nx{t}x" for p, (t, _) in enumerate(pages)), images)
        want += [(f"d{d}", p, p + 1, f"x{t}x") for p, (_, t) in enumerate(pages)]
    r = renders(spark, docs)
    assert sorted(map(tuple, document_pages(documents(r)).collect())) == sorted(want)
    by_join = figures.relink(split_pages(r), linked(spark, docs))
    assert sorted(map(tuple, by_join.collect())) == sorted(want)
    columns = ["rel_key", "img_key", "figure_no", "link"]
    assert sorted(map(str, document_figures(documents(r)).select(columns).collect())) == sorted(
        map(str, linked(spark, docs).select(columns).collect())
    )


def test_rewrite_and_strip_apart(spark):
    text = "see (k1) ![](k1) and ![al\nt](k2) but [k2](k2)"
    pages = spark.createDataFrame(
        [("a", 0, 1, text), ("b", 0, 1, text)], "rel_key string, pos bigint, page_no bigint, text string"
    )
    figs = linked(spark, {"a": ("x", [image("k1"), image("k2", saved=False)])})
    link = "./figures/figure_1_page1.png"
    rewritten = {r.rel_key: r.text for r in figures.rewrite_links(pages, figs).collect()}
    assert rewritten == {"a": text.replace("(k1)", f"({link})"), "b": text}
    stripped = {r.rel_key: r.text for r in figures.strip_links(pages, figs).collect()}
    assert stripped == {"a": "see (k1) ![](k1) and  but [k2](k2)", "b": text}


def test_image_refs(spark):
    pages = spark.createDataFrame(
        [("a", 0, 4, "![](x) [no](y) ![a\nb](z z) ![]()")],
        "rel_key string, pos bigint, page_no bigint, text string",
    )
    refs = figures.extract_image_refs(pages).orderBy("ref_no").collect()
    assert [(r.page_no, r.ref_no, r.link) for r in refs] == [(4, 0, "x"), (4, 1, "z z"), (4, 2, "")]


@pytest.mark.parametrize("seed", [3, 4])
def test_texts_cut_once_are_those_of_one_pass_for_each_key(spark, seed):
    """Keys without parentheses, also twice and within alt texts, against a plain loop."""
    rng = random.Random(seed)
    saved, lost = ["a.png", "a b", ".*", "$1"], ["b.png", "\\E+", ""]
    images = [image(k) for k in saved] + [image(k, saved=False) for k in [*lost, "a.png"]]
    link = {k: f"./figures/figure_{i + 1}_page1.png" for i, k in enumerate(sorted(saved))}
    parts = ["![", "![x]", "(", ")", "]", " ", "w\n", "()", *(f"({k})" for k in saved + lost),
             *(f"![al](" + k + ")" for k in saved + lost)]
    docs, want = {}, []
    for d in range(60):
        text = "x" + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) + "x"
        made = text
        for k in saved:
            made = made.replace(f"({k})", f"({link[k]})")
        for k in lost:
            made = re.sub(r"!\[[^\]]*\]\(" + re.escape(k) + r"\)", "", made)
        docs[f"d{d}"] = (f"\n\n{{0}}{RULE}\n\n{text}", images)
        want.append((f"d{d}", 0, 1, made))
    r = renders(spark, docs)
    assert sorted(map(tuple, document_pages(documents(r)).collect())) == sorted(want)
    by_join = figures.relink(split_pages(r), linked(spark, docs))
    assert sorted(map(tuple, by_join.collect())) == sorted(want)


def test_many_figures_on_a_page_take_time_in_proportion(spark):
    def seconds(n):
        text = " ".join(f"see (k{i}) ![](k{i})" for i in range(n))
        images = [image(f"k{i}", saved=i % 4 > 0) for i in range(n)]
        df = documents(renders(spark, {"a": (text, images)}))
        best = 1e9
        for _ in range(2):
            start = time.perf_counter()
            (row,) = df.collect()
            best = min(best, time.perf_counter() - start)
        assert row.pages[0].text.count("./figures/") == 2 * (n - (n + 3) // 4)
        assert row.pages[0].text.count("(k") == (n + 3) // 4
        return best

    seconds(100)
    assert seconds(16_000) < 8 * seconds(4_000) + 1
