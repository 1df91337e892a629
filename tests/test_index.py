"""The run index: deltas, compactions, and what a run leaves that stops somewhere."""

from __future__ import annotations

import json
import os

import pytest

from quire.sources import index, store
from quire.sources.index import (
    INDEX_SCHEMA,
    append_index,
    buckets_over,
    compact_index,
    current,
    expire_index,
    read_index,
)
from tests.test_records import record


def rows(spark, keys, **changes):
    return spark.createDataFrame([record(k, **changes) for k in keys], INDEX_SCHEMA)


def pages(spark, root):
    return {r.key: r.pages for r in read_index(spark, root).collect()}


def manifests(tmp_path):
    return sorted((tmp_path / "_index" / "manifests").glob("v-*.json"))


def test_a_run_writes_its_own_records_only(spark, tmp_path):
    root = str(tmp_path)
    assert pages(spark, root) == {}
    append_index(spark, rows(spark, [f"k{i}" for i in range(500)]), root)
    append_index(spark, rows(spark, ["k3", "new"], pages=7), root, "run-2")
    entries = current(spark, root)["entries"]
    assert [sum(p["rows"] for p in e["parts"].values()) for e in entries] == [500, 2]
    assert entries[1]["runs"] == ["run-2"]
    got = pages(spark, root)
    assert len(got) == 501 and got["k3"] == got["new"] == 7 and got["k4"] == 1
    append_index(spark, rows(spark, ["k3"], pages=9), root)
    append_index(spark, rows(spark, []), root)
    assert pages(spark, root)["k3"] == 9 and read_index(spark, root).count() == 501


def test_compaction_touches_buckets_over_a_limit_only(spark, tmp_path):
    root = str(tmp_path)
    append_index(spark, rows(spark, [f"k{i}" for i in range(300)]), root)
    assert compact_index(spark, root) == []  # one delta is none too many
    assert compact_index(spark, root, max_deltas=0) == sorted(
        int(b) for b in current(spark, root)["entries"][0]["parts"]
    )
    for n in range(4):
        append_index(spark, rows(spark, ["k3"], pages=n), root, f"run-{n}")
    before = current(spark, root)
    (bucket,) = buckets_over(before, max_deltas=3)
    touched = index._records(spark, root, before, [bucket])
    assert all(f"/bucket={bucket}/" in f for f in touched.inputFiles())
    files = {f for e in before["entries"] for b, p in e["parts"].items() for f in p["files"] if b != str(bucket)}
    assert compact_index(spark, root, max_deltas=3) == [bucket]
    after = current(spark, root)
    assert files < {f for e in after["entries"] for p in e["parts"].values() for f in p["files"]}
    assert [e["base"] for e in after["entries"]] == [True, True]
    assert {"run-0", "run-3"} <= set(after["entries"][0]["runs"])
    got = pages(spark, root)
    assert len(got) == 300 and got["k3"] == 3


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path, monkeypatch):
    """Another run commits just before the manifest of this one, twice, and once before a compaction's."""
    root = str(tmp_path)
    real, others = store.publish, iter([["b"], ["c"]])

    def late(spark_, path, data):
        for keys in others:
            monkeypatch.setattr(store, "publish", real)
            append_index(spark, rows(spark, keys), root)
            monkeypatch.setattr(store, "publish", late)
            break
        real(spark_, path, data)

    monkeypatch.setattr(store, "publish", late)
    append_index(spark, rows(spark, ["a"]), root)
    assert pages(spark, root) == {"a": 1, "b": 1, "c": 1}
    others = iter([["a", "d"]])
    assert compact_index(spark, root, max_deltas=0)
    assert set(pages(spark, root)) == {"a", "b", "c", "d"}
    assert any(not e["base"] for e in current(spark, root)["entries"])


def test_of_two_compactions_one_is_dropped(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for n in range(3):
        append_index(spark, rows(spark, ["a", "b"], pages=n), root)
    real = store.publish

    def late(spark_, path, data):
        monkeypatch.setattr(store, "publish", real)
        assert compact_index(spark, root, max_deltas=1)
        real(spark_, path, data)

    monkeypatch.setattr(store, "publish", late)
    assert compact_index(spark, root, max_deltas=1) == []
    assert pages(spark, root) == {"a": 2, "b": 2} and len(current(spark, root)["entries"]) == 1


def test_torn_and_unnamed_files_do_not_count(spark, tmp_path):
    root = str(tmp_path)
    append_index(spark, rows(spark, ["a"]), root)
    folder = tmp_path / "_index" / "manifests"
    whole = manifests(tmp_path)[0].read_text()
    for n, text in ((2, ""), (3, whole[:40]), (4, whole)):  # nothing, a half, another number's
        (folder / f"v-{n:010d}.json").write_text(text)
    (folder / ".v-0000000005.json.x").write_text(whole)  # a draft
    os.makedirs(tmp_path / "_index" / "data" / "delta-x" / "bucket=1")
    assert pages(spark, root) == {"a": 1}
    assert append_index(spark, rows(spark, ["b"]), root) == 5
    assert pages(spark, root) == {"a": 1, "b": 1}


@pytest.mark.parametrize("step", range(5))
def test_a_commit_that_stops_anywhere_is_repaired_by_the_next(spark, tmp_path, monkeypatch, step):
    """The storage calls of a commit, each of them the last one that is made."""
    root = str(tmp_path)
    append_index(spark, rows(spark, ["a"]), root)
    made = []

    def stopping(real, before):
        def call(*args, **kwargs):
            if before and len(made) == step:
                raise RuntimeError("stopped")
            made.append(1)
            out = real(*args, **kwargs)
            if not before and len(made) == step:
                raise RuntimeError("stopped")
            return out

        return call

    with monkeypatch.context() as patch:
        patch.setattr(index, "_write_entry", stopping(index._write_entry, step % 2 == 0))
        patch.setattr(os, "fsync", stopping(os.fsync, True))
        patch.setattr(os, "link", stopping(os.link, step != 3))
        try:
            append_index(spark, rows(spark, ["b"], pages=5), root)
        except RuntimeError:
            pass
    assert set(pages(spark, root)) in ({"a"}, {"a", "b"})
    append_index(spark, rows(spark, ["b"], pages=6), root)
    assert pages(spark, root) == {"a": 1, "b": 6}
    assert all(json.loads(m.read_text()) for m in manifests(tmp_path))


def test_a_name_is_taken_once(spark, tmp_path):
    path = f"file:{tmp_path}/sub folder/x.json"
    store.publish(spark, path, b"one")
    with pytest.raises(store.Taken):
        store.publish(spark, path, b"two")
    assert store.read_bytes(spark, path) == b"one"
    assert [p.name for p in (tmp_path / "sub folder").iterdir()] == ["x.json"]


def test_expiry_leaves_what_a_manifest_names(spark, tmp_path):
    root = str(tmp_path)
    for name in ("kept", "left", "fresh"):
        os.makedirs(tmp_path / "_runs" / name)
    for n in range(4):
        append_index(spark, rows(spark, ["a"], pages=n), root, "kept")
    compact_index(spark, root, max_deltas=1)
    (tmp_path / "_index" / "manifests" / ".v-1.json.draft").write_text("x")
    for path in [*(tmp_path / "_index" / "data").iterdir(), tmp_path / "_runs" / "left",
                 tmp_path / "_runs" / "kept", tmp_path / "_index" / "manifests" / ".v-1.json.draft"]:
        os.utime(path, (1, 1))
    gone = expire_index(spark, root, keep=1)
    assert len([p for p in gone if "/delta-" in p]) == 4
    assert sorted(p.name for p in (tmp_path / "_runs").iterdir()) == ["fresh", "kept"]
    assert len(manifests(tmp_path)) == 1 and pages(spark, root) == {"a": 3}
    assert not list((tmp_path / "_index" / "manifests").glob(".v-*"))
