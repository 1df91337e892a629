"""Checks on the output of a run; every operator returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.figure_keys import FIGURE_LINK_PAGE
from quire.functions.text import literal
from quire.operators.figures import extract_image_refs
from quire.operators.metadata import METADATA_COLUMNS, body_path

# A link with a scheme or host, or into the page itself, names no local file.
REMOTE_LINK = r"^([A-Za-z][A-Za-z0-9+.\-]*:|//|#)"


def dangling_links(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """Local image links no figure of the document answers to."""
    refs = extract_image_refs(pages).where(f"not link rlike {literal(REMOTE_LINK)}")
    known = figures.where("link is not null").select("rel_key", "link")
    return refs.join(known, ["rel_key", "link"], "left_anti").select(*refs.columns)


def page_tag_mismatch(pages: DataFrame) -> DataFrame:
    """Figure links whose page tag is not the number of the page they stand on."""
    tag = f"regexp_extract(link, {literal(FIGURE_LINK_PAGE)}, 1)"
    refs = extract_image_refs(pages).selectExpr("*", f"try_cast({tag} as bigint) as tag_page")
    return refs.where("tag_page <> page_no")


def expectation_diff(expected: DataFrame, metadata: DataFrame) -> DataFrame:
    """Expected documents against recorded ones, both ways.

    ``problem`` is missing, unexpected, or different (pages or status); an
    expected page count of null is not compared.
    """
    left = expected.selectExpr(
        "rel_key", "pages as expected_pages", "status as expected_status", "true as _e"
    )
    right = metadata.selectExpr(
        "key as rel_key", "pages as actual_pages", "status as actual_status", "true as _m"
    )
    problem = """
        case when _m is null then 'missing'
             when _e is null then 'unexpected'
             when (expected_pages is not null and not expected_pages <=> actual_pages)
               or not expected_status <=> actual_status then 'different' end"""
    return (
        left.join(right, "rel_key", "full_outer")
        .withColumn("problem", F.expr(problem))
        .where("problem is not null")
        .drop("_e", "_m")
    )


def figure_diff(expected: DataFrame, figures: DataFrame) -> DataFrame:
    """Expected figure numbers and pages (rel_key, figure_no, page_no) against actual ones."""
    left = expected.selectExpr("rel_key", "figure_no", "page_no as expected_page")
    right = figures.where("figure_no is not null").selectExpr(
        "rel_key", "figure_no", "page_no as actual_page"
    )
    return left.join(right, ["rel_key", "figure_no"], "full_outer").where(
        "not expected_page <=> actual_page"
    )


def bad_checksums(metadata: DataFrame) -> DataFrame:
    """Records whose checksum is not 'sha256:' and a payload."""
    return metadata.where("not coalesce(checksum rlike '(?s)^sha256:.', false)")


def index_vs_metadata(index: DataFrame, metadata: DataFrame) -> DataFrame:
    """Keys on which the index and the per-document records disagree."""
    record = ", ".join(c for c in METADATA_COLUMNS if c != "key")
    left = index.selectExpr("key", f"struct({record}) as _l")
    right = metadata.selectExpr("key", f"struct({record}) as _r")
    problem = """
        case when _r is null then 'no metadata'
             when _l is null then 'not in index'
             when not _l <=> _r then 'different' end as problem"""
    return (
        left.join(right, "key", "full_outer")
        .selectExpr("key", problem)
        .where("problem is not null")
    )


def path_collisions(docs: DataFrame) -> DataFrame:
    """Output paths that more than one document key maps to."""
    return (
        docs.selectExpr("rel_key", f"{body_path('rel_key')} as output_path")
        .groupBy("output_path")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.min("rel_key").alias("first_key"),
            F.max("rel_key").alias("last_key"),
        )
        .where("documents > 1")
    )
