"""Whole runs over a folder, with a stand-in converter that reads text files."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.resource import (
    ExecutorResourceRequests,
    ResourceProfileBuilder,
    TaskResourceRequests,
)

from quire import Render, RunOptions, convert, documents, preview, run
from quire.functions.page_text import FAILED_BODY
from quire.operators.resume import planned_collisions
from quire.plans.run import fingerprint_options
from quire.sources import sinks
from quire.sources.index import read_index
from tests.brute import RULE


def factory(told):
    """Pages are separated by form feeds; a line 'img <key>' is a figure, 'lost <key>' a failed one."""

    def converter(doc):
        path = doc["path"].removeprefix("file:")
        if Path(path).name == "marks.pdf":
            with open(Path(path).parent / "calls.log", "a") as log:
                log.write("x")
        content = Path(path).read_text()
        if content == "boom":
            raise RuntimeError("conversion blew up")
        wanted = told.page_ranges
        text, images = "", []
        for i, body in enumerate(content.split("\f")):
            if wanted is not None and not any(a <= i <= b for a, b in wanted):
                continue
            lines = []
            for line in body.split("\n"):
                kind, _, key = line.partition(" ")
                if kind in ("img", "lost"):
                    images.append((key, "RGB", False, b"png:" + key.encode() if kind == "img" else None))
                    line = f"![]({key})"
                lines.append(line)
            text += f"\n\n{{{i}}}{RULE}\n\n" + "\n".join(lines)
        return Render(text, images, len(content.split("\f")))

    return converter


@pytest.fixture
def inputs(tmp_path):
    root = tmp_path / "in"
    for key, text in {
        "a/intro.pdf": "one\fimg _page_1_Figure_0.jpeg",
        "b/intro.PDF": "other\nimg _page_0_Figure_10.jpeg\nimg _page_0_Figure_2.jpeg",
        "bad.pdf": "boom",
        "blank.pdf": "   ",
        "empty.pdf": "",
        "lossy.pdf": "text\nlost _page_0_Figure_0.jpeg",
        "with space.pdf": "fine",
        "_draft/_x.pdf": "boom",
        "note.txt": "not an input",
    }.items():
        path = root / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root


def outcome(report):
    return tuple(report.outcome.first())


def test_run_and_rerun(spark, inputs):
    first = run(spark, str(inputs), factory)
    out = inputs / "ocr"
    assert outcome(first) == (3, 1, 4, 8, 1)
    assert {r.output_path for r in first.outputs.collect()} == {
        "a/intro/intro.md", "b/intro/intro.md", "lossy/lossy.md", "with space/with space.md"
    }
    assert all(r.path == f"file:{out}/{r.output_path}" for r in first.outputs.collect())
    body = (out / "a/intro/intro.md").read_text()
    assert body == "## Page 1\n\none\n\n## Page 2\n\n![](./figures/figure_1_page2.png)\n\n"
    assert (out / "a/intro/figures/figure_1_page2.png").read_bytes() == b"png:_page_1_Figure_0.jpeg"
    # Block 2 comes ahead of block 10.
    assert (out / "b/intro/figures/figure_1_page1.png").read_bytes().endswith(b"_2.jpeg")
    assert (out / "bad/bad.md").read_text() == FAILED_BODY
    assert (out / "lossy/lossy.md").read_text() == "## Page 1\n\ntext\n\n\n"
    assert not (out / "note").exists() and not list(out.rglob(".*.md.*"))
    meta = json.loads((out / "bad/metadata.json").read_text())
    assert meta["status"] == "failed" and meta["error"] == "conversion blew up"
    assert meta["checksum"].startswith("sha256:") and meta["key"] == "bad.pdf"
    assert meta["output_path"] == "bad/bad.md"
    meta = json.loads((out / "lossy/metadata.json").read_text())
    assert meta["status"] == "partial" and "figure" in meta["error"]
    index = {r.key: r.status for r in read_index(spark, str(out)).collect()}
    assert len(index) == 8 and index["blank.pdf"] == "failed" and index["a/intro.pdf"] == "completed"

    # Nothing but the completed documents is skipped; outputs are never read as inputs.
    again = run(spark, str(inputs), factory)
    assert outcome(again) == (3, 1, 4, 8, 1) and again.metadata.count() == 5
    assert len(read_index(spark, str(out)).collect()) == 8

    # A changed input, a missing output and other options are each converted anew.
    (inputs / "a/intro.pdf").write_text("new text")
    (out / "with space/with space.md").unlink()
    third = run(spark, str(inputs), factory)
    assert {"a/intro.pdf", "with space.pdf"} < {r.key for r in third.metadata.collect()}
    assert "b/intro.PDF" not in {r.key for r in third.metadata.collect()}
    assert (out / "a/intro/intro.md").read_text() == "## Page 1\n\nnew text\n\n"
    options = RunOptions(pages="0")
    fourth = run(spark, str(inputs), factory, options=options)
    assert fourth.metadata.count() == 8
    assert fingerprint_options(spark, options) != fingerprint_options(spark, RunOptions())
    everything = run(spark, str(inputs), factory, options=options, reprocess=True, export=False)
    assert everything.metadata.count() == 8


def test_page_subset_reaches_the_converter(spark, inputs):
    report = run(spark, str(inputs / "a/intro.pdf"), factory, str(inputs / "x"), RunOptions(pages="1"))
    assert outcome(report) == (1, 0, 0, 1, 0)
    assert (inputs / "x/intro/intro.md").read_text().startswith("## Page 2\n\n![]")
    beyond = run(spark, str(inputs / "a/intro.pdf"), factory, str(inputs / "y"), RunOptions(pages="1-4"))
    assert outcome(beyond) == (0, 1, 0, 1, 1)


def test_oversized_and_vanished_inputs_fail_alone(spark, inputs):
    listing = spark.createDataFrame(
        [(f"file:{inputs}/a/intro.pdf", 10), (f"file:{inputs}/big.pdf", 1 << 30), (f"file:{inputs}/gone.pdf", 1)],
        "path string, size_bytes bigint",
    )
    report = run(spark, str(inputs), factory, str(inputs / "out"), listing=listing)
    assert outcome(report) == (1, 0, 2, 3, 1)
    got = {r.key: r for r in report.metadata.collect()}
    assert "too large" in got["big.pdf"].error
    assert got["gone.pdf"].checksum == "sha256:" + "0" * 64


def test_bad_options_stop_before_any_file(spark, inputs):
    with pytest.raises(ValueError):
        RunOptions(pages="a")
    with pytest.raises(ValueError):
        run(spark, str(inputs / "nowhere"), factory)


def test_nothing_to_convert_loads_no_model(spark):
    def never(told):
        raise AssertionError("loaded")

    files = spark.createDataFrame([("a", None, "too big")], "rel_key string, path string, size_error string")
    (row,) = convert(files, never).collect()
    assert row.error == "too big"
    with pytest.raises(Exception, match="loaded"):  # a model that can't load is no document's fault
        convert(files.selectExpr("rel_key", "path"), never).collect()


def test_each_document_is_converted_once(spark, inputs):
    (inputs / "marks.pdf").write_text("x")
    run(spark, str(inputs), factory)
    assert (inputs / "calls.log").read_text() == "x"


def test_a_model_is_loaded_once_per_task(spark, tmp_path):
    def counting(told):
        with open(tmp_path / "loads.log", "a") as log:
            log.write("x")

        def fails(doc):
            raise RuntimeError("no")

        return fails

    files = spark.createDataFrame([(f"k{i}", "p") for i in range(12)], "rel_key string, path string")
    rows = convert(files, counting, tasks=3).collect()
    assert {r.error for r in rows} == {"no"} and all(r.processing_time >= 0 for r in rows)
    assert (tmp_path / "loads.log").read_text() == "xxx"


def test_a_listing_s_page_count_finds_lost_pages(spark, inputs):
    def silent(told):
        made = factory(told)

        def convert_(doc):
            out = made(doc)
            out.page_count = None
            return out

        return convert_

    listing = spark.createDataFrame(
        [(f"file:{inputs}/a/intro.pdf", 10, 9)], "path string, size_bytes bigint, page_count bigint"
    )
    report = run(spark, str(inputs), silent, str(inputs / "out"), listing=listing)
    assert outcome(report) == (0, 1, 0, 1, 1)


@pytest.mark.parametrize("kind", ["figures", "bodies", "records", "index"])
def test_an_interrupted_run_is_repaired_by_the_next(spark, inputs, monkeypatch, kind):
    """The run stops just ahead of the step; the next one leaves nothing out."""
    step = ["figures", "bodies", "records", "index"].index(kind)
    calls = []
    write_files, append_index = sinks.write_files, sinks.append_index

    def stop(real, *args):
        if len(calls) == step:
            raise RuntimeError("stopped")
        calls.append(1)
        return real(*args)

    monkeypatch.setattr(sinks, "write_files", lambda *a: stop(write_files, *a))
    monkeypatch.setattr(sinks, "append_index", lambda *a: stop(append_index, *a))
    with pytest.raises(RuntimeError):
        run(spark, str(inputs), factory)
    monkeypatch.undo()
    assert outcome(run(spark, str(inputs), factory)) == (3, 1, 4, 8, 1)
    out = inputs / "ocr"
    assert (out / "a/intro/figures/figure_1_page2.png").exists()
    assert (out / "a/intro/intro.md").exists() and (out / "a/intro/metadata.json").exists()
    assert len(read_index(spark, str(out)).collect()) == 8


def test_table_only_runs_skip_what_is_done(spark, inputs):
    first = run(spark, str(inputs), factory, export=False)
    assert outcome(first) == (3, 1, 4, 8, 1) and not (inputs / "ocr/a/intro/intro.md").exists()
    again = run(spark, str(inputs), factory, export=False)
    assert outcome(again) == (3, 1, 4, 8, 1)
    assert {r.key for r in again.metadata.collect()}.isdisjoint({"a/intro.pdf", "b/intro.PDF"})
    # With files wanted they are missing, and so made.
    run(spark, str(inputs), factory)
    assert (inputs / "ocr/a/intro/intro.md").exists()


def test_a_single_file_of_another_kind_is_an_error(spark, inputs):
    with pytest.raises(ValueError):
        run(spark, str(inputs / "note.txt"), factory)


def test_outputs_with_one_path_are_not_overwritten(spark, inputs):
    """One of the two documents is converted, the other one fails; what is done stays done."""
    for name in ("a/intro.PDF", "b/intro.pdf"):
        (inputs / name).write_text("the other one")
    first = run(spark, str(inputs), factory)
    assert outcome(first) == (3, 1, 6, 10, 1)
    got = {r.key: r for r in first.metadata.collect()}
    assert got["a/intro.PDF"].status == "completed"
    assert got["a/intro.pdf"].status == "failed" and got["a/intro.pdf"].output_path is None
    assert got["a/intro.pdf"].error == "output path belongs to a/intro.PDF"
    out = inputs / "ocr"
    assert "the other one" in (out / "a/intro/intro.md").read_text()
    assert json.loads((out / "a/intro/metadata.json").read_text())["key"] == "a/intro.PDF"
    # A document that is done keeps its path, whatever comes later.
    (inputs / "with space.PDF").write_text("later")
    again = run(spark, str(inputs), factory)
    got = {r.key: r for r in again.metadata.collect()}
    assert got["with space.PDF"].error == "output path belongs to with space.pdf"
    assert "fine" in (out / "with space/with space.md").read_text()


def test_paths_that_a_store_holds_for_one(spark):
    plan = spark.createDataFrame(
        [("A/x.pdf",), ("a/x.pdf",), ("e\u0301.pdf",), ("\u00e9.pdf",), ("z.pdf",)], "rel_key string"
    )
    got = {r.rel_key: r.path_error for r in planned_collisions(plan).collect()}
    assert set(got.values()) == {None}
    got = {r.rel_key: r.path_error for r in planned_collisions(plan, "UNICODE_CI").collect()}
    assert got["a/x.pdf"] == "output path belongs to A/x.pdf" and got["A/x.pdf"] is None
    assert got["\u00e9.pdf"] == "output path belongs to e\u0301.pdf" and got["z.pdf"] is None


def test_uris_of_one_file(spark, inputs):
    listing = spark.createDataFrame(
        [(f"file://{inputs}/a/intro.pdf", 10), (f"file:{inputs}/with space.pdf", 4),
         (f"file:{inputs}/with space.pdf", 4), (f"file://{inputs}/out/x.pdf", 4)],
        "path string, size_bytes bigint",
    )
    report = run(spark, str(inputs), factory, str(inputs / "out"), listing=listing)
    assert {r.key for r in report.metadata.collect()} == {"a/intro.pdf", "with space.pdf"}
    foreign = spark.createDataFrame([("file:/elsewhere/x.pdf", 1)], "path string, size_bytes bigint")
    with pytest.raises(Exception, match="not below"):
        run(spark, str(inputs), factory, str(inputs / "out2"), listing=foreign)


def test_a_preview_converts_nothing(spark, inputs):
    files, totals = preview(spark, str(inputs))
    assert {r.rel_key for r in files.collect()} >= {"a/intro.pdf", "_draft/_x.pdf"}
    assert {r.pages for r in files.collect()} == {"-"}
    assert totals.first().files == 8 and not (inputs / "ocr").exists()
    with pytest.raises(ValueError):
        preview(spark, str(inputs / "nowhere"))


def test_a_run_reads_nothing_to_count_it(spark, inputs):
    """The outcome is known when the run returns: collecting it reads no table."""
    report = run(spark, str(inputs), factory)
    assert "Parquet" not in report.outcome._jdf.queryExecution().executedPlan().toString()
    assert report.spent["pages"] == 7 and report.spent["figures"] == 3 and report.spent["seconds"] > 0
    again = run(spark, str(inputs), factory)
    assert outcome(again) == outcome(report) and again.spent["figures"] == 0
    empty = inputs / "nothing"
    empty.mkdir()
    assert outcome(run(spark, str(empty), factory)) == (0, 0, 0, 0, 0)


def test_the_converting_stage_has_a_profile_of_its_own(spark):
    needs = ResourceProfileBuilder().require(
        TaskResourceRequests().cpus(2).resource("gpu", 1)
    ).require(ExecutorResourceRequests().cores(4).resource("gpu", 2)).build
    files = spark.createDataFrame([("a", "a")], "rel_key string, path string")
    made = documents(convert(files, factory, profile=needs))
    nodes = [made._jdf.queryExecution().optimizedPlan()]
    profiles = []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "MapInPandas":
            profiles.append(node.profile().isDefined())
    assert profiles == [True]
    plain = documents(convert(files, factory))
    assert "ResourceProfile" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_pictures_lie_beside_the_rows(spark, inputs):
    """No table holds a picture; they come from a generator and are copied when the tree is made."""

    def drawing(told):
        def converter(doc):
            def pictures():
                for i in range(30):
                    yield f"_page_0_Figure_{i}.png", "RGB", False, bytes([i % 7]) * (1 << 20) if i != 5 else None
                if doc["rel_key"] == "bad.pdf":
                    raise RuntimeError("the last picture is broken")

            return Render("![](_page_0_Figure_4.png)", pictures(), 1)

        return converter

    report = run(spark, str(inputs), drawing)
    assert outcome(report) == (0, 7, 1, 8, 1)
    made = spark.read.parquet(f"{report.run_dir}/documents")
    assert "binary" not in made.schema.simpleString()
    kept = list(Path(report.run_dir.removeprefix("file:")).glob("images/*/*.png"))
    assert len(kept) == 7 and all(p.stat().st_size == 1 << 20 for p in kept)
    for i, name in ((1, 0), (6, 6), (29, 1)):  # the sixth picture takes no number
        png = inputs / f"ocr/lossy/figures/figure_{i}_page1.png"
        assert png.read_bytes() == bytes([name]) * (1 << 20)
    got = {r.key: r.error for r in report.metadata.collect()}
    assert got["bad.pdf"] == "the last picture is broken" and "figure" in got["lossy.pdf"]
