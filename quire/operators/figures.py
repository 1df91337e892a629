"""The figure table: keys, numbers, links, and the links inside page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.figure_keys import (
    by_key,
    failure_text,
    figure_link,
    has_odd_keys,
    key_block,
    key_page,
    linked_text,
    png_mode,
    text_tokens,
)
from quire.functions.rows import rows_of
from quire.functions.text import IMAGE_LINK, literal

FIGURE_ORDER = ("page_no", "block_id", "img_key")


def explode_images(renders: DataFrame) -> DataFrame:
    """Image lists of renders as rows; the PNG bytes stay behind."""
    return rows_of(renders, ["rel_key"], "images", "_i", "_no").selectExpr(
        "rel_key",
        "_i.key as img_key",
        "_i.png is not null as saved",
        f"{png_mode('_i.mode', '_i.has_transparency')} as png_mode",
    )


def parse_figure_key(figures: DataFrame) -> DataFrame:
    """Add the page and block numbers a figure's key names."""
    return figures.selectExpr(
        "*", f"{key_page('img_key')} as page_no", f"{key_block('img_key')} as block_id"
    )


def number_figures(figures: DataFrame) -> DataFrame:
    """Add ``figure_no``: saved figures of a document in source order.

    A figure that was not saved takes no number (null). The figures of a
    document came out of one cell, so a window holds no more than that.
    """
    order = Window.partitionBy("rel_key", "saved").orderBy(*FIGURE_ORDER)
    number = F.when(F.col("saved"), F.row_number().over(order).cast("bigint"))
    return figures.withColumn("figure_no", number)


def figure_links(figures: DataFrame) -> DataFrame:
    """Add ``link``: where a numbered figure lies relative to its body."""
    link = figure_link("figure_no", "page_no")
    return figures.selectExpr("*", f"if(figure_no is null, null, {link}) as link")


def figure_failures(figures: DataFrame) -> DataFrame:
    """Failed figures per document: count and diagnostic in source order."""
    lost = figures.where("not saved").select("rel_key", F.struct(*FIGURE_ORDER).alias("_f"))
    return (
        lost.groupBy("rel_key")
        .agg(F.expr("sort_array(collect_list(_f)).img_key as _keys"))
        .selectExpr(
            "rel_key",
            "cast(size(_keys) as bigint) as failed",
            f"{failure_text('_keys')} as detail",
        )
    )


def relink(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """Rewrite the links of saved figures and strip those of failed ones.

    Pages and figures meet on (document, token), never document by document:
    the work follows the parentheses in the texts, and what is gathered for a
    page is bounded by that page's own text. Pages without a parenthesis stay
    where they are.
    """
    open_ = pages.where("instr(text, '(') > 0")
    tokens = open_.selectExpr("rel_key", "pos", f"explode({text_tokens('text')}) as _token")
    keys = figures.selectExpr(
        "rel_key", "struct(figure_no, page_no, block_id, img_key, link) as _f"
    ).selectExpr("rel_key", f"{by_key('_f')} as _k").selectExpr("rel_key", "_k.token as _token", "_k")
    hits = (
        tokens.join(keys, ["rel_key", "_token"])
        .groupBy("rel_key", "pos")
        .agg(F.expr("sort_array(collect_list(_k)) as _keys"))
    )
    linked = linked_text("text", "_keys", has_odd_keys("_keys"))
    moved = (
        open_.join(hits, ["rel_key", "pos"], "left")
        .withColumn("text", F.expr(f"if(_keys is null, text, {linked})"))
        .select(*pages.columns)
    )
    return moved.unionByName(pages.where("not coalesce(instr(text, '(') > 0, false)"))


def rewrite_links(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """Point every literal '(key)' of a saved figure at its link."""
    return relink(pages, figures.where("link is not null"))


def strip_links(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """Remove the image markup of figures that were not saved."""
    return relink(pages, figures.where("link is null"))


def extract_image_refs(pages: DataFrame) -> DataFrame:
    """Image links in page texts, one row each, in the order of the text."""
    links = f"regexp_extract_all(text, {literal(IMAGE_LINK)}, 1)"
    return pages.selectExpr(
        "rel_key", "pos", "page_no", f"posexplode({links}) as (ref_no, link)"
    ).withColumn("ref_no", F.expr("cast(ref_no as bigint)"))
