"""N-gram Jaccard join: exact classes of near duplicates, by prefix trees.

A document's set holds the hashes of its distinct 5-word shingles. The join is
exact, without caps, and goes from the many sets to the few that can link:

1. Sets that are equal count once (``shingle_sets``, a set id per document).
2. Shingles are counted by range of their hash, packed in arrays. A set with
   links shares at least 75 % of its shingles, so those with more unshared ones
   are out, and so are unshared shingles: they are in no intersection.
3. What is left is ordered globally, rare shingles first. Linked sets share a
   shingle within their prefixes, the first ones of which not all can be
   unshared. The prefixes' shared shingles give groups without links between.
4. A group is cut into blocks. A block's sets are stored in a trie; each set
   walks it as a whole, links, and is stored as well (``trie``).
5. Groups of many blocks: one member of each class found is compared with those
   of other blocks, then every set outside of the group's largest class with all
   blocks, each in tasks of a block and a chunk of such sets.

Shingles that a thousandth of all documents share would make heavy keys in 2.
They are found first, by counts of what is frequent within slices of text, and
need no counting then; there are never more of them than 2,000 times the mean
size of a set, so their list is broadcast.

Set ids and shingles are 64-bit hashes (in 2 and later, 32 bits and the number
of the range, which grows with the data).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import encoded, slices, text_rows
from quire.llm.components import components
from quire.llm.hashing import mixed, runs, words_of
from quire.llm.tables import written
from quire.llm.trie import linked, linked_across

WORDS = 5
PERCENT = 75
#: Shingles of one counting task, which holds about a hundred bytes for each.
RANGE_SHINGLES = 1_500_000
#: Sets of one trie.
BLOCK_SETS = 256
#: A shingle counts as heavy from this part of all documents on.
HEAVY_PART = 2_000
HEAVY_LEAST = 64
#: 128 bits for a text as it stands; a null is like an empty one.
TEXT_KEY = {
    "h1": "xxhash64(coalesce(cast(text as string), ''))",
    "h2": "xxhash64(7L, coalesce(cast(text as string), ''))",
}
_LOW = np.uint64(0xFFFFFFFF)
_HEAVY_CLASS = 255


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of every text; all its words as one where they are fewer."""
    h, cuts = words_of(texts, fold=True)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = h[a:b]
        out.append(np.unique(runs(own, min(k, len(own)))) if len(own) else own)
    return out


def _set_id(s: np.ndarray) -> int:
    total = int(mixed(s).sum(dtype=np.uint64)) if len(s) else 0
    size = np.array([total ^ len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64)
    return int(mixed(size).view(np.int64)[0])


def shingle_sets(docs: DataFrame, k: int = WORDS, keyed: bool = False) -> DataFrame:
    """``doc_id, n_shingles, set_id``; equal sets have equal ids; no id for an empty set.

    If ``keyed``, also ``h1, h2``, 128 bits of the text's hash.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = _sets(encoded(batch.column(1)), k)
            ids = [_set_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(ids, pa.int64()), *batch.columns[2:]],
                ["doc_id", "n_shingles", "set_id", *batch.schema.names[2:]],
            )

    more = [F.expr(f"{h} as {name}") for name, h in TEXT_KEY.items()] if keyed else []
    schema = "doc_id bigint, n_shingles bigint, set_id bigint"
    return text_rows(docs, *more).mapInArrow(each, ", ".join([schema, *(f"{h} bigint" for h in TEXT_KEY if keyed)]))


# --- packed counts ------------------------------------------------------------


def _distinct_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and sets of a slice, those without shingles and repetitions left out."""
    found: dict[int, np.ndarray] = {}
    for s in _sets(encoded(batch.column(1)), k):
        if len(s):
            found.setdefault(_set_id(s), s)
    return np.fromiter(found, np.int64, len(found)), list(found.values())


def _located(flat: np.ndarray, ranges: int) -> np.ndarray:
    """Shingles as range number and 32 bits."""
    at = ((flat >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return (at << np.uint64(32)) | (flat & _LOW)


def _heavy(rows: DataFrame, ranges: int, n_docs: int, k: int) -> np.ndarray:
    """Sorted shingles that are frequent, among them all of at least a thousandth of the rows."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, sets = _distinct_sets(batch, k)
            if sets:
                shingles, counts = np.unique(_located(np.concatenate(sets), ranges), return_counts=True)
                often = counts >= max(3, batch.num_rows / HEAVY_PART)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingles[often].view(np.int64)), pa.array(counts[often], pa.int64())],
                    ["shingle", "n"],
                )

    found = rows.mapInArrow(frequent, "shingle bigint, n bigint").groupBy("shingle")
    enough = found.agg(F.sum("n").alias("n")).where(
        F.col("n") >= max(HEAVY_LEAST, n_docs / HEAVY_PART)
    )
    table = enough.select("shingle").toArrow()  # bounded, see above
    return np.sort(table.column(0).to_numpy().view(np.uint64))


def _is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


_PACKED = "part int, range int, sets binary, counts binary, shingles binary, more binary"
_PACKED_NAMES = [c.split()[0] for c in _PACKED.split(", ")]


def _packed(part: int, at: int, sets, counts, shingles, more) -> pa.RecordBatch:
    cells = [x.tobytes() for x in (sets, counts, shingles, more)]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([at], pa.int32()),
         *(pa.array([c], pa.binary()) for c in cells)],
        _PACKED_NAMES,
    )


def _unpacked(table: pa.Table, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table.column(name).to_pylist()]


def _by_set(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal owners."""
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return first, np.diff(np.concatenate((first, [len(owner)]))).astype(np.uint32)


def _asked(batches, k: int, ranges: int, heavy) -> Iterator[pa.RecordBatch]:
    """The shingles of every slice that aren't heavy, packed by range: to be counted."""
    for batch in slices(batches):
        ids, sets = _distinct_sets(batch, k)
        if not len(ids):
            continue
        flat = _located(np.concatenate(sets), ranges)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        light = ~_is_in(flat, heavy.value)
        flat, owner = flat[light], owner[light]
        at = (flat >> np.uint64(32)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        flat, owner, at = flat[order], owner[order], at[order]
        ends = np.searchsorted(at, np.arange(ranges + 1))
        for r in np.flatnonzero(np.diff(ends)):
            own = owner[ends[r] : ends[r + 1]]
            first, n = _by_set(own)
            low = (flat[ends[r] : ends[r + 1]] & _LOW).astype(np.uint32)
            yield _packed(int(r), int(r), ids[own[first]], n, low, np.zeros(0, np.uint8))


def _own(batches, k: int, ranges: int, parts: int, heavy) -> Iterator[pa.RecordBatch]:
    """Ids, sizes and heavy shingles of every slice's sets, packed by part of the set id."""
    for batch in slices(batches):
        ids, sets = _distinct_sets(batch, k)
        part = (ids.view(np.uint64) % np.uint64(parts)).astype(np.int32)
        for p in np.unique(part):
            chosen = np.flatnonzero(part == p)
            of = [_located(sets[i], ranges) for i in chosen]
            of = [s[_is_in(s, heavy.value)] for s in of]
            n = np.array([len(s) for s in of], np.uint32)
            sizes = np.array([len(sets[i]) for i in chosen], np.uint32)
            yield _packed(int(p), -1, ids[chosen], n, np.concatenate(of), sizes)


def _shared(table: pa.Table, parts: int) -> pa.Table:
    """Of one range: the shingles of two sets or more, back by set, with a class of frequency."""
    sets, counts = _unpacked(table, "sets", np.int64), _unpacked(table, "counts", np.uint32)
    low = np.concatenate(_unpacked(table, "shingles", np.uint32))
    owner = np.concatenate([np.repeat(s, n) for s, n in zip(sets, counts, strict=True)])
    order = np.argsort(low, kind="stable")
    low, owner = low[order], owner[order]
    first, n = _by_set(low)
    several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
    rarity = np.minimum(_HEAVY_CLASS - 1, np.round(8 * np.log2(n))).astype(np.uint8)
    chosen = np.repeat(several, n)
    low, owner, rarity = low[chosen], owner[chosen], np.repeat(rarity, n)[chosen]
    part = (owner.view(np.uint64) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((owner, part))
    low, owner, rarity, part = low[order], owner[order], rarity[order], part[order]
    ends = np.searchsorted(part, np.arange(parts + 1))
    at = table.column("range")[0].as_py()
    out = []
    for p in np.flatnonzero(np.diff(ends)):
        here = slice(ends[p], ends[p + 1])
        begin, n = _by_set(owner[here])
        out.append(_packed(int(p), at, owner[here][begin], n, low[here], rarity[here]))
    schema = pa.schema([("part", pa.int32()), ("range", pa.int32()),
                        *((c, pa.binary()) for c in _PACKED_NAMES[2:])])
    return pa.Table.from_batches(out, schema)


def _candidates(table: pa.Table, percent: int) -> pa.Table:
    """Of one part of the sets: those that share enough, in the global order of shingles."""
    shingles, owners, classes, ids, sizes = [], [], [], [], []
    rows = zip(
        table.column("range").to_pylist(), _unpacked(table, "sets", np.int64),
        _unpacked(table, "counts", np.uint32), table.column("shingles").to_pylist(),
        table.column("more").to_pylist(), strict=True,
    )
    for at, own, counts, data, more in rows:
        owners.append(np.repeat(own, counts))
        if at < 0:
            shingles.append(np.frombuffer(data, np.uint64))
            classes.append(np.full(len(shingles[-1]), _HEAVY_CLASS, np.uint8))
            ids.append(own)
            sizes.append(np.frombuffer(more, np.uint32))
        else:
            low = np.frombuffer(data, np.uint32).astype(np.uint64)
            shingles.append(low | np.uint64(at << 32))
            classes.append(np.frombuffer(more, np.uint8))
    ids, at = np.unique(np.concatenate(ids), return_index=True)
    sizes = np.concatenate(sizes)[at].astype(np.int64)
    shingle, owner, rarity = map(np.concatenate, (shingles, owners, classes))
    order = np.lexsort((shingle, rarity, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(owner), bool)  # a set that several slices have comes several times
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    shingle, owner = shingle[new], owner[new]
    begin, end = np.searchsorted(owner, ids), np.searchsorted(owner, ids, "right")
    need = (percent * sizes + 99) // 100
    chosen = np.flatnonzero(end - begin >= need)
    return pa.table(
        {
            "set_id": pa.array(ids[chosen], pa.int64()),
            "size": pa.array(sizes[chosen], pa.int64()),
            "prefix": pa.array((end - begin - need + 1)[chosen], pa.int32()),
            "shingles": pa.array([shingle[begin[i] : end[i]].tobytes() for i in chosen], pa.binary()),
        }
    )


def _whole(batches, made) -> Iterator[pa.RecordBatch]:
    """What ``made`` gives for all batches of a partition."""
    held = list(batches)
    if held := [b for b in held if b.num_rows]:
        yield from made(pa.Table.from_batches(held)).to_batches()


def candidates(rows: DataFrame, n_docs: int, n_shingles: int, k: int, percent: int) -> DataFrame:
    """``set_id, size, prefix, shingles``: the sets that may have links (steps 2 and 3)."""
    spark = rows.sparkSession
    ranges = max(1, -(-n_shingles // RANGE_SHINGLES))
    heavy = spark.sparkContext.broadcast(_heavy(rows, ranges, n_docs, k))
    asked = rows.mapInArrow(partial(_asked, k=k, ranges=ranges, heavy=heavy), _PACKED)
    own = rows.mapInArrow(partial(_own, k=k, ranges=ranges, parts=ranges, heavy=heavy), _PACKED)
    # Parts and partitions are the same: one range, or one part of the sets, to a task.
    shared = asked.repartitionById(ranges, F.col("part")).mapInArrow(
        partial(_whole, made=partial(_shared, parts=ranges)), _PACKED
    )
    made = shared.unionByName(own).repartitionById(ranges, F.col("part")).mapInArrow(
        partial(_whole, made=partial(_candidates, percent=percent)),
        "set_id bigint, size bigint, prefix int, shingles binary",
    )
    return written(made, "jaccard-candidates")


def _prefixes(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        of = [np.frombuffer(data, np.int64)[:n] for n, data in rows]
        if of:
            owner = np.repeat(batch.column(0).to_numpy(), [len(s) for s in of])
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner), pa.array(np.concatenate(of))], ["set_id", "shingle"]
            )


def prefix_groups(found: DataFrame) -> DataFrame:
    """``node, label``: groups of candidates, joined by the shingles of their prefixes."""
    prefixes = found.select("set_id", "prefix", "shingles").mapInArrow(
        _prefixes, "set_id bigint, shingle bigint"
    )
    lowest = prefixes.groupBy("shingle").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z"))
    lowest = lowest.where("a <> z").select("shingle", "a")
    links = prefixes.join(lowest, "shingle").selectExpr("a", "set_id as b")
    return components(links)


# --- links --------------------------------------------------------------------

_BLOCK = "grp bigint, block int, set_id bigint, size bigint, shingles binary"


def _grouped(batches, keys: list[str]) -> Iterator[list[dict]]:
    """Rows that agree in ``keys``, of batches that are sorted by them."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _arrays(rows: list[dict]) -> tuple[list[np.ndarray], list[int]]:
    return [np.frombuffer(r["shingles"], np.int64) for r in rows], [r["size"] for r in rows]


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _within(batches, percent: int) -> Iterator[pa.RecordBatch]:
    for rows in _grouped(batches, ["grp", "block"]):
        sets, sizes = _arrays(rows)
        lowest = linked(sets, sizes, percent)
        yield _links([(r["set_id"], rows[i]["set_id"]) for r, i in zip(rows, lowest, strict=True)])


def _across(batches, percent: int) -> Iterator[pa.RecordBatch]:
    for rows in _grouped(batches, ["grp", "block", "chunk"]):
        stored, probes = [[r for r in rows if r["probe"] == p] for p in (False, True)]
        made = linked_across(
            *_arrays(stored), [r["label"] for r in stored],
            *_arrays(probes), [r["label"] for r in probes], percent,
        )
        yield _links([(probes[i]["set_id"], stored[j]["set_id"]) for i, j in made])


def _in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links within each (``grp``, ``block``): every set with the lowest of its class there."""
    dealt = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "set_id")
    return dealt.mapInArrow(partial(_within, percent=percent), "a bigint, b bigint")


def _with_blocks(rows: DataFrame) -> DataFrame:
    """``block`` of about ``BLOCK_SETS`` sets and ``blocks`` for rows with a ``grp``."""
    sizes = rows.groupBy("grp").agg(F.count("*").alias("_n"))
    sizes = sizes.selectExpr("grp as _g", f"cast(ceil(_n / {BLOCK_SETS}) as int) as blocks")
    return rows.join(sizes, F.expr("grp = _g")).selectExpr(
        *rows.columns, "cast(pmod(xxhash64(set_id), blocks) as int) as block", "blocks"
    )


def set_classes(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, label``: classes of the candidates that have links (steps 3 to 5)."""
    groups = prefix_groups(found)
    rows = found.join(groups, F.expr("set_id = node")).selectExpr(
        "label as grp", "set_id", "size", "shingles"
    )
    rows = written(_with_blocks(rows), "jaccard-blocks")
    cells = ["grp", "block", "set_id", "size", "shingles"]
    links = written(_in_blocks(rows.select(*cells), percent), "jaccard-links")

    wide = rows.where("blocks > 1")
    if wide.isEmpty():
        return components(links)
    # One member of each class of a block stands for it ...
    leaders = wide.join(
        links.selectExpr("b as _lead").distinct(), F.expr("set_id = _lead"), "left_semi"
    )
    leaders = _with_blocks(leaders.select("grp", "set_id", "size", "shingles"))
    links = links.unionByName(written(_in_blocks(leaders.select(*cells), percent), "jaccard-links"))
    classes = components(links)
    # ... and what isn't in the largest class of its group by then meets every block.
    labelled = wide.join(classes, F.expr("set_id = node"), "left").selectExpr(
        *cells, "blocks", "coalesce(label, set_id) as label"
    )
    labelled = written(labelled, "jaccard-labelled")
    per_class = labelled.groupBy("grp", "label").agg(F.count("*").alias("n"))
    largest = per_class.groupBy("grp").agg(F.expr("max_by(label, struct(n, label))").alias("_main"))
    largest = largest.withColumnRenamed("grp", "_g")
    outside = labelled.join(largest, F.expr("grp = _g")).where("label <> _main")
    outside = outside.selectExpr(*cells, "blocks", "label")
    n_outside = outside.groupBy("grp").agg(F.count("*").alias("_n")).selectExpr(
        "grp as _g", f"cast(ceil(_n / {BLOCK_SETS}) as int) as chunks"
    )
    numbered = outside.join(n_outside, F.expr("grp = _g")).selectExpr(
        *cells, "blocks", "label", "chunks",
        "cast(pmod(xxhash64(set_id, 1), chunks) as int) as chunk",
    )
    probes = numbered.selectExpr(
        "grp", "explode(sequence(0, blocks - 1)) as block", "chunk", "true as probe", "set_id",
        "size", "shingles", "label",
    )
    stored = labelled.join(n_outside, F.expr("grp = _g")).selectExpr(
        "grp", "block", "explode(sequence(0, chunks - 1)) as chunk", "false as probe", "set_id",
        "size", "shingles", "label",
    )
    met = probes.unionByName(stored).repartition("grp", "block", "chunk")
    met = met.sortWithinPartitions("grp", "block", "chunk", "set_id")
    more = met.mapInArrow(partial(_across, percent=percent), "a bigint, b bigint")
    return components(links.unionByName(written(more, "jaccard-links")))


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Two rows link when their sets of ``k``-word shingles (A-Z lower-cased) have
    a Jaccard similarity of ``percent`` or more; ``component_id`` is the
    smallest ``doc_id`` that links lead to. Of fewer than ``k`` words all are one
    shingle. A null text, or one without words, has an empty set and links with
    nothing: its own ``doc_id`` is its component.

    Rows without an id link like others, but their null never is a component's
    smallest id; where all rows of one have none, it is null. Repeated rows and
    rows with equal ids get a row each. Other columns are not looked at; an
    empty table gives an empty one.
    """
    rows = text_rows(docs)
    sets = written(shingle_sets(docs, k), "jaccard-sets")
    n_docs, n_shingles = sets.selectExpr("count(*)", "coalesce(sum(n_shingles), 0)").first()
    if not n_shingles:
        return sets.selectExpr("doc_id", "n_shingles", "doc_id as component_id")
    classes = set_classes(candidates(rows, n_docs, n_shingles, k, percent), percent)
    lowest = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("low"))
    named = lowest.join(classes, F.expr("set_id = node"), "left").selectExpr(
        "set_id", "low", "coalesce(label, set_id) as label"
    )
    by_class = named.groupBy("label").agg(F.min("low").alias("component_id"))
    by_set = named.select("set_id", "label").join(by_class, "label")
    by_set = by_set.selectExpr("set_id as _s", "component_id")
    return sets.join(by_set, F.expr("set_id = _s"), "left").selectExpr(
        "doc_id", "n_shingles", "if(set_id is null, doc_id, component_id) as component_id"
    )


def one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component of near duplicates, with all its columns.

    The row with the smallest ``doc_id`` stays, and of equal ones that with the
    smallest text hash; a row without an id only where none of its component has
    one. Of repeated rows, which agree in both, the one whose other columns have
    the smallest hash stays. Rows without words, a null text among them, link
    with nothing and all stay. Other columns, whatever their names and types, go
    along; an empty table gives an empty one.
    """
    sets = written(shingle_sets(docs, k, keyed=True), "jaccard-sets")
    n_docs, n_shingles = sets.selectExpr("count(*)", "coalesce(sum(n_shingles), 0)").first()
    if not n_shingles:
        return docs
    classes = set_classes(candidates(text_rows(docs), n_docs, n_shingles, k, percent), percent)
    # Counted per key first, which combines ahead of the shuffle.
    keys = sets.groupBy("set_id", "doc_id", *TEXT_KEY).agg(F.count("*").alias("n"))
    key = "struct(doc_id is null as no_id, doc_id, h1, h2, n)"
    lowest = keys.where("set_id is not null").groupBy("set_id").agg(F.expr(f"min({key}) as low"))
    named = lowest.join(classes, F.expr("set_id = node"), "left").selectExpr(
        "coalesce(label, set_id) as label", "low"
    )
    first = named.groupBy("label").agg(F.min("low").alias("low"))
    kept = first.selectExpr("low.doc_id as _id", "low.h1 as _h1", "low.h2 as _h2", "low.n > 1 as _several")
    wordless = keys.where("set_id is null").selectExpr("doc_id", "h1", "h2", "false")
    kept = written(kept.union(wordless), "jaccard-kept")

    rows = docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_d"),
        *(F.expr(h).alias(name) for name, h in TEXT_KEY.items()),
    )
    same = F.expr("_d <=> _id and h1 = _h1 and h2 = _h2")
    single = rows.join(kept.where("not _several"), same, "left_semi").select("_row")
    several = kept.where("_several")
    if not several.isEmpty():
        repeated = rows.join(several, same, "left_semi")
        repeated = repeated.groupBy("_d", "h1", "h2").agg(
            F.expr("min_by(_row, struct(xxhash64(to_json(_row)), to_json(_row))) as _row")
        )
        single = single.union(repeated.select("_row"))
    return single.select("_row.*")
