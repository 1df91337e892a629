from __future__ import annotations

import tracemalloc

import pytest

from quire.operators.metadata import doc_metadata
from quire.operators.pages import assemble_body
from quire.plans.documents import document_pages, documents
from quire.sources.files import EXTENSION, list_files, scan_files
from quire.sources.remote import (
    SCHEMES,
    entry_pages,
    file_checksum,
    locate,
    with_file_checksum,
)
from quire.sources.scratch import scratch_root
from quire.sources.sinks import document_bodies, export_tree
from quire.sources.spread import dealt_by_weight
from tests.brute import RULE
from tests.test_figures import image, renders


def long_document(n):
    pages = "".join(f"\n\n{{{i}}}{RULE}\n\npage {i} ![](_page_{i}_F_0)" for i in range(n))
    return pages, [image(f"_page_{i}_F_0", saved=i % 3 > 0) for i in range(n)]


def test_bodies_in_rows_are_those_of_the_page_table(spark):
    docs = {"long.pdf": long_document(2500), "short.pdf": ("x", []), "none.pdf": (" ", [])}
    table = documents(renders(spark, docs))
    got = document_bodies(table)
    want = assemble_body(document_pages(table), table)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 3


def test_export_is_whole_and_repeatable(spark, tmp_path):
    path, tree = str(tmp_path / "docs"), tmp_path / "tree"
    df = documents(renders(spark, {"s/long.pdf": long_document(12)}))
    df.selectExpr("*", "'sha256:1' as checksum", "0D as processing_time").write.parquet(path)
    docs = spark.read.parquet(path)
    for _ in range(2):
        counts = export_tree(docs, doc_metadata(docs, "m", "b", "f"), f"file:{tree}")
        assert counts == {"bodies": 1, "figures": 8, "metadata": 1}
    figures = sorted(p.name for p in (tree / "s/long/figures").iterdir())
    body = (tree / "s/long/long.md").read_text()
    assert len(figures) == 8 and all(f"(./figures/{name})" in body for name in figures)
    assert "_F_0" not in body and sorted(p.name for p in (tree / "s/long").iterdir()) == [
        "figures", "long.md", "metadata.json"
    ]


def test_locations(tmp_path):
    odd = tmp_path / "a b%20#c.txt"
    odd.write_bytes(b"abc")
    for uri in (f"file:{odd}", f"file://{odd}", str(odd)):
        assert locate(uri)[1] == str(odd)
        assert file_checksum(uri).startswith("sha256:ba7816bf")
    assert file_checksum(f"file:{tmp_path}/nowhere") is None


def test_unknown_stores_raise():
    assert SCHEMES["s3a"] == SCHEMES["s3n"] == "s3" and SCHEMES["wasbs"] == "abfss"
    with pytest.raises(ValueError):
        file_checksum("nosuch://bucket/key.pdf")


def test_a_flat_folder_is_hashed_by_all_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"{i}.pdf").write_text(str(i))
    hashed = with_file_checksum(list_files(spark, f"file:{tmp_path}"))
    sizes = [len(p) for p in hashed.select("path").rdd.glom().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 2 * 400 / len(sizes) and min(sizes) > 0
    (one,) = list_files(spark, f"file:{tmp_path}/7.pdf").collect()
    assert one.path.endswith("/7.pdf") and one.size_bytes == 1 and one.modified


def test_partitions_of_equal_weight(spark):
    """One row of half the weight beside many small ones; as many partitions as asked for, about."""
    rows = [("big", 400)] + [(f"k{i}", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "path string, size int")
    for n in (1, 4, 40, 200):
        dealt = dealt_by_weight(df, "path", "size", lambda rows_, total, n=n: n)
        parts = [sum(r.size for r in p) for p in dealt.rdd.glom().collect()]
        assert sum(parts) == 800 and n / 2 <= len(parts) <= 2 * n + 8
        assert max((p for p in parts if p < 400), default=0) <= 2 * 800 / n + 2
        assert max(parts) <= 400 + 2 * 800 / n
    assert dealt.columns == df.columns and dealt_by_weight(df.limit(0), "path", "size", lambda *_: 3).count() == 0
    even = spark.createDataFrame([(f"k{i}", 1) for i in range(4000)], "path string, size int")
    parts = [len(p) for p in dealt_by_weight(even, "path", "size", lambda *_: 64).rdd.glom().collect()]
    assert max(parts) <= 2 * 4000 / 64 and min(parts) > 0


def test_scratch_folders_of_a_cluster(spark, monkeypatch):
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "local-cluster[2,1,512]", "getCheckpointDir": lambda self: None})()

    with pytest.raises(ValueError):
        scratch_root(Fake())


def test_a_large_flat_folder_is_listed_page_by_page(tmp_path):
    """No more than a page of entries is held, and names of other extensions don't count for one."""
    for i in range(30_000):
        (tmp_path / f"{'x' * 60}-{i}.{'PDF' if i % 3 else 'txt'}").touch()
    (tmp_path / "sub").mkdir()
    (tmp_path / ".pdf").touch()
    (tmp_path / "gone.pdf").symlink_to(tmp_path / "nowhere")
    tracemalloc.start()
    sizes, folders = [], 0
    for page in entry_pages(f"file:{tmp_path}", EXTENSION, [".pdf"]):
        sizes.append(len(page))
        folders += sum(is_dir for _, is_dir, _, _ in page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [10_000, 10_000, 1] and folders == 1
    assert peak < 10_000 * 1000
    assert sum(map(len, entry_pages(f"file:{tmp_path}", None, ()))) == 30_002
    assert list(entry_pages(f"file:{tmp_path}/nowhere", None, ())) == []


def test_listing_leaves_other_extensions_in_the_task(spark, tmp_path):
    for name in ("a.pdf", "b.txt", "s/c.PDF", "s/d", "s/.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = list_files(spark, f"file:{tmp_path}", exts=[".pdf"]).collect()
    assert {r.path.rsplit("/", 1)[1] for r in found} == {"a.pdf", "c.PDF"}
    assert all(r.size_bytes == 1 and r.modified.year >= 2024 for r in found)


def test_scanned_files_are_listed_and_dealt_by_tasks(spark, tmp_path):
    """The rows of Spark's own scan, in tasks that go by bytes and not by files."""
    for i in range(1500):
        (tmp_path / f"{i % 40}").mkdir(exist_ok=True)
        (tmp_path / f"{i % 40}/{i}.md").write_text(f"text {i}")
    odd = ["a b%20#c.md", "é/[x]{y}/z.PNG", ".hid.md", "_hid.md", "_a=b.md", "_hid/x.md", ".h/x.md",
           "_metadata.md", "_metadata_x/y.md", "x._COPYING_", "s/_x=1/y.md", "a._COPYING_b", "s/.d/e/f.md"]
    for name in odd:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty.md").touch()
    for i in range(3):
        (tmp_path / f"large{i}.md").write_bytes(bytes([i]) * (9 << 20))
    top = f"file:{tmp_path}"
    got = scan_files(spark, top)
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top)
    want = plain.selectExpr("path", "length as size_bytes", "modificationTime as modified", "content")
    assert got.dtypes == want.dtypes
    digest = ("path", "size_bytes", "modified", "sha2(content, 256)")
    rows = got.selectExpr(*digest).collect()
    assert sorted(rows) == sorted(want.selectExpr(*digest).collect()) and len(rows) == 1509
    assert got.rdd.getNumPartitions() <= 16
    assert "Python" not in got.select("path")._jdf.queryExecution().executedPlan().toString()
    assert [r.size_bytes for r in scan_files(spark, f"{top}/7/7.md").collect()] == [6]
    with pytest.raises(FileNotFoundError):
        scan_files(spark, f"{top}/nowhere")
