"""Quality rules with thresholds that follow each language and source.

Mergeable quantile sketches are kept per (lang, source), of rows that pass the
base rules. First of the mean word length: its fence lies ``REACH_IQR`` times the
distance between the quartiles outside of them, so that junk moves it only where
it is a quarter of a group. Then, of the rows inside that fence, of the rates of
symbols, repeated lines, repeated windows and echoed words, and of the sizes that
these are rates of. A rate's limit is its 95th percentile, ``REACH`` times the
distance from the median to it, and its resolution, which is what ``EVENTS`` more
occurrences make in a document of the group's median size. Nothing in a limit is
a rate given by hand.

Groups of few rows take the merged sketch of their language, and languages of few
rows that of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.rows import computed_once
from quire.llm.tables import GAPS, words_of, written

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Fewer rows than this have no threshold of their own.
MIN_GROUP_ROWS = 200
REACH_IQR = 3.0
REACH = 6.0
EVENTS = 3
SKETCH_K = 400

LENGTH = "word_chars / greatest(n_words, 1)"
# name: (count, what one event adds to it, size that the rate refers to)
RATES = {
    "symbol_rate": ("n_symbols", 1, "word_chars"),
    "dup_line_rate": ("n_dup_lines", 1, "n_lines"),
    "repeat_rate": ("n_repeat_words", 2 * WINDOW, "n_words"),
    "echo_rate": ("n_echoes", 1, "n_words"),
}
SIZES = ("word_chars", "n_lines", "n_words")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``lang``, ``source`` and the counts of every row, without a shuffle.

    ``n_repeat_words`` counts the words in windows of 8 that occur twice or more
    in the text: windows are hashed, sorted with their positions, and the
    lengths of the runs of repeated ones are added up.
    """
    row = docs.selectExpr(
        *keep, "cast(lang as string) as lang", "cast(source as string) as source",
        "coalesce(cast(text as string), '') as _text",
    )
    row = computed_once(row.selectExpr("*", f"{words_of('_text')} as _words"))
    row = computed_once(
        row.selectExpr(
            "*",
            "size(_words) as _n",
            "length(array_join(_words, '')) as _chars",
            "regexp_count(_text, '[#*$%&|<>]') as _symbols",
            f"filter(split(_text, '\\n'), x -> btrim(x, '{GAPS}') <> '') as _lines",
            "transform(_words, w -> xxhash64(w)) as _hashes",
        ).drop("_text", "_words")
    )
    at = ", ".join(f"_hashes[i + {j}]" for j in range(WINDOW))
    row = computed_once(
        row.selectExpr(
            "*",
            "size(_lines) - size(array_distinct(_lines)) as _dup_lines",
            "size(_lines) as _line_count",
            "size(filter(_hashes, (h, i) -> h = get(_hashes, i - 1))) as _echoes",
            f"""if(_n < {WINDOW}, array(), transform(sequence(0, _n - {WINDOW}),
                    i -> xxhash64({at}))) as _windows""",
        ).drop("_lines", "_hashes")
    )
    row = computed_once(
        row.selectExpr(
            "*",
            """if(size(array_distinct(_windows)) = size(_windows), array(),
                  sort_array(transform(_windows, (h, i) -> struct(h, i)))) as _sorted""",
        ).drop("_windows")
    )
    again = """transform(filter(transform(_sorted, (x, k) -> struct(x.i as i,
        coalesce(get(_sorted, k - 1).h = x.h, false)
        or coalesce(get(_sorted, k + 1).h = x.h, false) as twice)), x -> x.twice), x -> x.i)"""
    return row.selectExpr(
        *keep, "lang", "source",
        "cast(_n as bigint) as n_words",
        "cast(_chars as bigint) as word_chars",
        "cast(_symbols as bigint) as n_symbols",
        "cast(_dup_lines as bigint) as n_dup_lines",
        f"""cast(aggregate(sort_array({again}), struct(0 as n, 0 as upto), (a, i) -> struct(
            a.n + i + {WINDOW} - greatest(i, a.upto) as n, i + {WINDOW} as upto),
            a -> a.n) as bigint) as n_repeat_words""",
        "cast(_line_count as bigint) as n_lines",
        "cast(_echoes as bigint) as n_echoes",
    ).withColumn("base_failed", F.expr(
        f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    ))


def _rate(name: str) -> str:
    count, _, size = RATES[name]
    return f"{count} / greatest({size}, 1)"


def _sketches(
    rows: DataFrame, groups: DataFrame, measures: dict[str, str], min_group_rows: int, name: str
) -> DataFrame:
    """``lang, source`` of ``groups`` with sketches of the measures over ``rows``.

    ``own`` are those of the group, or of its language where the group has few
    rows, or of all; ``wide`` those of the language, or of all.
    """
    own = rows.groupBy("lang", "source").agg(
        F.count("*").alias("n"),
        *(
            F.kll_sketch_agg_double(F.expr(f"cast({e} as double)"), F.lit(SKETCH_K)).alias(m)
            for m, e in measures.items()
        ),
    )
    own = written(own, name)
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(m).alias(m) for m in measures)]
    packed = F.struct("n", *measures)
    by_lang = written(own.groupBy("lang").agg(*merged), f"{name}-by-language")
    overall = by_lang.agg(*merged).select(packed.alias("top")).scalar()
    own = own.select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), packed.alias("g")
    )
    by_lang = by_lang.select(F.col("lang").alias("_l"), packed.alias("m"))
    found = (
        groups.join(own, F.expr("lang <=> _lang and source <=> _source"), "left")
        .join(by_lang, F.expr("lang <=> _l"), "left")
        .select("lang", "source", "g", "m", overall.alias("t"))
    )
    wide = f"if(m.n >= {min_group_rows}, m, t)"
    return found.selectExpr(
        "lang", "source", f"if(g.n >= {min_group_rows}, g, {wide}) as own", f"{wide} as wide"
    )


def _at(sketch: str, q: float) -> str:
    return f"kll_sketch_get_quantile_double({sketch}, {q}D)"


def thresholds(rows: DataFrame, min_group_rows: int = MIN_GROUP_ROWS) -> DataFrame:
    """``lang, source``, the fence of the word length and the limit of each rate."""
    groups = written(rows.select("lang", "source").distinct(), "quality-groups")
    sound = rows.where("not base_failed")
    lengths = _sketches(sound, groups, {"length": LENGTH}, min_group_rows, "quality-lengths")
    low, high = _at("own.length", 0.25), _at("own.length", 0.75)
    wide = f"{_at('wide.length', 0.75)} - {_at('wide.length', 0.25)}"
    spread = f"{REACH_IQR} * greatest({high} - {low}, {wide})"
    fences = lengths.selectExpr(
        "lang", "source", f"{low} - {spread} as min_word_length",
        f"{high} + {spread} as max_word_length",
    )
    fences = written(fences, "quality-fences")
    inside = _beside(sound, fences).where(_inside_fence())
    measures = {m: _rate(m) for m in RATES} | {size: size for size in SIZES}
    rates = _sketches(inside, groups, measures, min_group_rows, "quality-rates")
    limits = []
    for m, (_, event, size) in RATES.items():
        middle, upper = _at(f"own.{m}", 0.5), _at(f"own.{m}", 0.95)
        step = f"{EVENTS * event} / greatest({_at(f'own.{size}', 0.5)}, 1D)"
        limits.append(f"{upper} + {REACH} * ({upper} - {middle}) + {step} as max_{m}")
    return _beside(rates.selectExpr("lang", "source", *limits), fences).drop("_lang", "_source")


def _beside(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with the limits of their group."""
    named = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    return rows.join(named, F.expr("lang <=> _lang and source <=> _source"), "left")


def _inside_fence() -> str:
    return f"coalesce({LENGTH} between min_word_length and max_word_length, true)"


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with ``kept``: base rules passed and every measure within its group's limits."""
    tests = [_inside_fence(), *(f"coalesce({_rate(m)} <= max_{m}, true)" for m in RATES)]
    kept = f"not base_failed and {' and '.join(tests)}"
    return _beside(rows, limits).selectExpr(*(f"`{c}`" for c in rows.columns), f"{kept} as kept")


def verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every row of ``docs``.

    A null text has no words and fails the base rules. A null ``lang`` or
    ``source`` is a group of its own. Each of repeated rows gets a row. Other
    columns are not looked at; an empty table gives an empty one.
    """
    rows = written(measured(docs, "cast(doc_id as bigint) as doc_id"), "quality-counts")
    limits = written(thresholds(rows), "quality-limits")
    return judged(rows, limits).select("doc_id", *COUNTS, "base_failed", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Counts are taken twice, once for the thresholds and once beside the row, so
    that no text is shuffled; the thresholds are a row per group.
    """
    limits = written(thresholds(written(measured(docs), "quality-counts")), "quality-limits")
    rows = docs.select(F.struct("*").alias("_row"), "lang", "source", "text")
    return judged(measured(rows, "_row"), limits).where("kept").select("_row.*")
