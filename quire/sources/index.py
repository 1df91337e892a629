"""The run index: one record per document key, as a base and the runs since.

Records lie in buckets of their key's hash. A run appends a delta of its own
records and touches nothing else; readers put the newest record of a key first.
A compaction rewrites the buckets that have gathered many deltas, and only those.

What counts is the newest manifest, ``manifests/v-<number>.json``. It names every
file that belongs to the index, with the rows of its bucket, and shows itself
whole or not at all; a file that no manifest names does not count. A manifest
that can't be read, left by a store without that promise, is passed over, and
its number is not used again. So a run may stop anywhere: either its manifest is
there, or the index is as it was before.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Collection
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import literal
from quire.sources import store

INDEX_SCHEMA = (
    "key string, status string, checksum string, model string, backend string, "
    "processing_time double, timestamp timestamp, output_path string, pages bigint, "
    "error string, fingerprint string"
)
BUCKETS = 64
COMMIT_TRIES = 50
#: A bucket with more deltas than this, or with this share of its base in them, is rewritten.
MAX_DELTAS = 8
MAX_SHARE = 0.5

Manifest = dict[str, Any]


class IndexMoved(RuntimeError):
    """Other runs have kept writing the next manifest first."""


def _manifest_path(root: str, version: int) -> str:
    return f"{root}/_index/manifests/v-{version:010d}.json"


def _versions(spark: SparkSession, root: str) -> list[int]:
    found = store.listed(spark, f"{root}/_index/manifests/v-*.json")
    return [int(path.rsplit("/v-", 1)[1].removesuffix(".json")) for path, _ in found]


def _parsed(spark: SparkSession, root: str, version: int) -> Manifest | None:
    """A manifest, or None if it is torn."""
    try:
        made = json.loads(store.read_bytes(spark, _manifest_path(root, version)))
    except ValueError:
        return None
    return made if isinstance(made, dict) and made.get("version") == version else None


def current(spark: SparkSession, root: str) -> Manifest:
    """The newest whole manifest; an empty one where there is none. ``next`` is the number to take."""
    versions = _versions(spark, root)
    for version in reversed(versions):
        manifest = _parsed(spark, root, version)
        if manifest is not None:
            return manifest | {"next": versions[-1] + 1}
    return {"version": 0, "buckets": BUCKETS, "entries": [], "next": max(versions, default=0) + 1}


def _files(manifest: Manifest, base: bool, buckets: Collection[int] | None) -> list[str]:
    """Files of the bases or of the deltas, in some buckets or all, the oldest first."""
    return [
        f"{entry['name']}/{name}"
        for entry in manifest["entries"]
        if entry["base"] == base
        for bucket, part in entry["parts"].items()
        if buckets is None or int(bucket) in buckets
        for name in part["files"]
    ]


def _records(
    spark: SparkSession, root: str, manifest: Manifest, buckets: Collection[int] | None = None
) -> DataFrame:
    """The newest record of every key in some buckets or all."""

    def read(files: list[str]) -> DataFrame:
        if not files:
            return spark.createDataFrame([], INDEX_SCHEMA)
        return spark.read.schema(INDEX_SCHEMA).parquet(*(f"{root}/_index/data/{f}" for f in files))

    base = read(_files(manifest, True, buckets))
    late = _files(manifest, False, buckets)
    if not late:
        return base
    deltas = [e["name"] for e in manifest["entries"] if not e["base"]]
    new = read(late)
    if len(deltas) > 1:
        order = ", ".join(f"{literal(name)}, {i}" for i, name in enumerate(deltas))
        name = "regexp_extract(_metadata.file_path, '/_index/data/([^/]+)/', 1)"
        record = f"struct({', '.join(base.columns)})"
        newest = f"max_by({record}, element_at(map({order}), {name})) as _r"
        new = new.groupBy("key").agg(F.expr(newest)).select("_r.*")
    if not _files(manifest, True, buckets):
        return new
    return base.join(new.select("key"), "key", "left_anti").select(*base.columns).unionByName(new)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The newest record of every key; an empty index where there is none."""
    return _records(spark, root, current(spark, root))


def _write_entry(records: DataFrame, root: str, base: bool, runs: list[str], buckets: int) -> Manifest:
    """Write records by bucket into a folder of their own, which counts once a manifest names it."""
    spark = records.sparkSession
    name = f"{'base' if base else 'delta'}-{uuid.uuid4().hex}"
    folder = f"{root}/_index/data/{name}"
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    columns = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
    dealt = records.select(*columns, bucket).hint("rebalance", "bucket")
    dealt.write.partitionBy("bucket").parquet(folder)
    parts: dict[str, dict] = {}
    for path, _ in store.listed(spark, f"{folder}/bucket=*/*.parquet"):
        at, file = path.rsplit("/", 2)[1:]
        parts.setdefault(at.removeprefix("bucket="), {"rows": 0, "files": []})["files"].append(
            f"{at}/{file}"
        )
    if parts:
        for row in spark.read.parquet(folder).groupBy("bucket").count().collect():
            parts[str(row["bucket"])]["rows"] = row["count"]
    return {"name": name, "base": base, "runs": runs, "parts": parts}


def _commit(
    spark: SparkSession, root: str, change: Callable[[Manifest], list[Manifest] | None]
) -> int | None:
    """Make ``change`` of the newest entries the next manifest; None if it has nothing to do."""
    for _ in range(COMMIT_TRIES):
        now = current(spark, root)
        entries = change(now)
        if entries is None:
            return None
        made = {"version": now["next"], "buckets": now["buckets"], "entries": entries}
        try:
            store.publish(spark, _manifest_path(root, now["next"]), json.dumps(made).encode())
        except store.Taken:  # another run came first: its entries belong in as well
            continue
        return now["next"]
    raise IndexMoved(f"no manifest of {root} in {COMMIT_TRIES} tries")


def append_index(spark: SparkSession, records: DataFrame, root: str, run: str | None = None) -> int:
    """Add a run's records, one for each of its keys, and return the number of the manifest.

    As many rows are written as the run has, whatever the index holds. Of runs
    at the same time each one's delta goes in; for a key that both have, the
    later commit counts.
    """
    entry = _write_entry(records, root, False, [run] if run else [], current(spark, root)["buckets"])
    return _commit(spark, root, lambda now: [*now["entries"], entry])


def buckets_over(manifest: Manifest, max_deltas: int = MAX_DELTAS, max_share: float = MAX_SHARE) -> list[int]:
    """Buckets whose deltas are many, or hold many rows beside their base."""
    deltas: dict[str, int] = {}
    rows: dict[tuple[str, bool], int] = {}
    for entry in manifest["entries"]:
        for bucket, part in entry["parts"].items():
            deltas[bucket] = deltas.get(bucket, 0) + (not entry["base"])
            key = bucket, entry["base"]
            rows[key] = rows.get(key, 0) + part["rows"]
    return sorted(
        int(b)
        for b, n in deltas.items()
        if n > max_deltas or (n > 1 and rows.get((b, False), 0) > max_share * rows.get((b, True), 0) > 0)
    )


def compact_index(
    spark: SparkSession, root: str, max_deltas: int = MAX_DELTAS, max_share: float = MAX_SHARE
) -> list[int]:
    """Rewrite the buckets that are over a limit into a base, and return which ones.

    Deltas that came in meanwhile stay deltas. If another compaction has taken
    one of the buckets the result is dropped.
    """
    before = current(spark, root)
    chosen = buckets_over(before, max_deltas, max_share)
    if not chosen:
        return []
    taken = {
        (entry["name"], str(b)) for entry in before["entries"] for b in chosen if str(b) in entry["parts"]
    }
    runs = sorted({r for e in before["entries"] for r in e["runs"] if any(e["name"] == n for n, _ in taken)})
    base = _write_entry(_records(spark, root, before, chosen), root, True, runs, before["buckets"])

    def change(now: Manifest) -> list[Manifest] | None:
        there = {(entry["name"], b) for entry in now["entries"] for b in entry["parts"]}
        if not taken <= there:
            return None
        left = []
        for entry in now["entries"]:
            parts = {b: p for b, p in entry["parts"].items() if (entry["name"], b) not in taken}
            if parts:
                left.append(entry | {"parts": parts})
        return [base, *left]

    return chosen if _commit(spark, root, change) is not None else []


def expire_index(spark: SparkSession, root: str, keep: int = 10, days: float = 7.0) -> list[str]:
    """Remove what no kept manifest names, and return the paths.

    The newest ``keep`` manifests stay readable, for runs that have begun with
    them. Data folders, run folders and drafts that none of them names, left by
    interrupted runs and by compactions, go when nothing has changed in them for
    ``days``; a run must not take longer than that.
    """
    versions = _versions(spark, root)
    manifests = {v: _parsed(spark, root, v) for v in versions}
    whole = [v for v in versions if manifests[v] is not None]
    kept = set(whole[-keep:])
    named = {e["name"] for v in kept for e in manifests[v]["entries"]}
    named |= {r for v in kept for e in manifests[v]["entries"] for r in e["runs"]}
    limit = time.time() * 1000 - days * 86_400_000
    gone = [_manifest_path(root, v) for v in whole if v not in kept]
    for pattern in ("_index/data/*", "_runs/*", "_index/manifests/.v-*"):
        for path, changed in store.listed(spark, f"{root}/{pattern}"):
            if path.rsplit("/", 1)[1] not in named and changed < limit:
                gone.append(path)
    for path in gone:
        store.removed(spark, path)
    return gone
