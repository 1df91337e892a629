"""Document tables derived from the raw tables.

Conversations become rendered documents whose pages are the turns; the last
digit of the conversation id decides which defect a document has. Documents
become books whose pages are their rows. No document holds more than
TURNS_PER_DOCUMENT turns or IDS_PER_VOLUME ids: a longer conversation or source
goes on in further documents, so no group grows with the data ((conv_id, turn)
and doc_id are the keys of their tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS_PER_DOCUMENT = 64
IDS_PER_VOLUME = 1000
RULE = "-" * 48
PREAMBLE = "Preamble {5}--- inline."
OVERSIZE = 629145600
MODES = ("RGB", "RGBA", "LA", "P", "PA", "L")

NOT_CONVERTED = 9

SCHEMAS = {
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

CHECKSUM = "concat('sha256:', sha2(cast(array_join(turns.text, '') as binary), 256))"
OUTPUT = "regexp_replace(rel_key, '([^/]*)[.]pdf$', '$1/$1.md')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: conv_id, cls, rel_key, n, turns in order."""
    return (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id", F.expr(f"turn div {TURNS_PER_DOCUMENT}").alias("vol"))
        .agg(F.expr("sort_array(collect_list(struct(turn, role, text))) as turns"))
        .selectExpr(
            "conv_id",
            "conv_id % 10 as cls",
            "concat('d', conv_id % 5, '/doc', conv_id div 5, "
            "if(vol > 0, concat('-', vol), ''), '.pdf') as rel_key",
            "cast(size(turns) as bigint) as n",
            "turns",
        )
    )


def _image_key(turn: str, block: int) -> str:
    return f"concat('_page_', {turn}, '_Figure_{block}.jpeg')"


def _image_link(turn: str, block: int) -> str:
    return f"'\\n\\n![](', {_image_key(turn, block)}, ')'"


def _marked(page_id: str, body: str) -> str:
    return f"concat('\\n\\n{{', {page_id}, '}}{RULE}\\n\\n', {body})"


def renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel_key, markdown, error, page_count, images, checksum of converted documents."""
    body = (
        "concat(t.text, if(t.role = 'assistant', "
        f"concat({_image_link('t.turn', 10)}, {_image_link('t.turn', 2)}), ''))"
    )
    shown = _marked("t.turn", f"if(cls = 6, '   ', {body})")
    sections = f"transform(present, t -> {shown})"
    modes = ", ".join(f"'{m}'" for m in MODES)

    def image(block: int) -> str:
        key = _image_key("t.turn", block)
        lost = "cls in (5, 7)" if block == 10 else "false"
        return (
            f"named_struct('key', {key}, 'mode', array({modes})[cast(t.turn % {len(MODES)} as int)], "
            f"'has_transparency', t.turn % 2 = 1, 'png', if({lost}, null, cast({key} as binary)))"
        )

    return (
        volumes(spark, sf_dir)
        .where(f"cls <> {NOT_CONVERTED}")
        .selectExpr("*", "if(cls in (1, 7), slice(turns, 1, size(turns) - 1), turns) as present")
        .selectExpr(
            "conv_id",
            "rel_key",
            f"""case when cls = 2 then array_join(transform(present, t -> {body}), '\\n\\n')
                     when cls = 3 then null
                     when cls = 4 then concat('{PREAMBLE}', array_join({sections}, ''))
                     when cls = 8 then ''
                     else array_join({sections}, '') end as markdown""",
            "if(cls = 3, 'converter failed', null) as error",
            "if(cls = 2, 1L, n) as page_count",
            f"""flatten(transform(
                  filter(present, t -> t.role = 'assistant' and cls not in (3, 6, 8)),
                  t -> array({image(10)}, {image(2)}))) as images""",
            f"{CHECKSUM} as checksum",
        )
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, rel_key, path, size_bytes, page_count, checksum of every document."""
    return volumes(spark, sf_dir).selectExpr(
        "conv_id",
        "rel_key",
        "concat('/in/', rel_key) as path",
        f"if(cls = {NOT_CONVERTED}, {OVERSIZE}L, "
        "1000L * aggregate(turns, 0L, (a, t) -> a + length(t.text))) as size_bytes",
        "if(cls = 2, 1L, n) as page_count",
        f"{CHECKSUM} as checksum",
    )


def prior_index(files_df: DataFrame) -> DataFrame:
    """An index left by an earlier run over the same files."""
    stale = "concat('sha256:', sha2(cast(concat('old', conv_id) as binary), 256))"
    return files_df.where("conv_id % 3 <> 2").selectExpr(
        "conv_id",
        "rel_key as key",
        "if(conv_id % 5 = 0, 'partial', 'completed') as status",
        f"if(conv_id % 3 = 1, {stale}, checksum) as checksum",
        "if(conv_id % 7 = 0, 'fp-old', 'fp-now') as fingerprint",
        f"{OUTPUT} as output_path",
    )


def existing_outputs(files_df: DataFrame) -> DataFrame:
    return files_df.where("conv_id % 11 <> 0").selectExpr(f"{OUTPUT} as output_path")


def specs(files_df: DataFrame) -> DataFrame:
    """Page selections of the documents, one of each kind."""
    spec = """
        case conv_id % 6 when 0 then concat('0-', page_count) when 1 then '1,0'
             when 2 then concat(page_count, '-0') when 4 then ' 0, 2-3 ,2' when 5 then 'a' end"""
    return files_df.selectExpr("conv_id", "rel_key", "page_count", f"{spec} as spec")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered volumes of every source: a page per document row, every third with a figure."""
    link = "if(key is null, '', concat('\\n\\n![](', key, ')'))"
    return (
        table(spark, sf_dir, "documents")
        .selectExpr(
            f"concat(source, '/v', doc_id div {IDS_PER_VOLUME}, '.pdf') as rel_key",
            f"doc_id % {IDS_PER_VOLUME} as page_id",
            "text",
        )
        .selectExpr(
            "*",
            "if(page_id % 3 = 0, concat('_page_', page_id, '_Figure_0.jpeg'), null) as key",
        )
        .selectExpr(
            "rel_key",
            f"struct(page_id, {_marked('page_id', f'concat(text, {link})')} as section, key) as p",
        )
        .groupBy("rel_key")
        .agg(F.expr("sort_array(collect_list(p)) as ps"))
        .selectExpr(
            "rel_key",
            "array_join(ps.section, '') as markdown",
            "cast(null as string) as error",
            "cast(size(ps) as bigint) as page_count",
            """transform(filter(ps, p -> p.key is not null), p -> named_struct(
                 'key', p.key, 'mode', 'RGB', 'has_transparency', false,
                 'png', cast(p.key as binary))) as images""",
        )
    )
