import csv
import json
import os
import struct
import sys
import zlib

import pytest
from pyspark import cloudpickle

from corpuslens import cli
from corpuslens.errors import ConfigurationError, EngineExecutionError, EngineNotFoundError, EngineNotInstalledError, EvaluationInputError, ImageLoadError, InvalidImageError, ProfileInputError, RecognitionDataError, UnsupportedEngineError
from corpuslens.operators import imaging
from corpuslens.plans import sinks
from corpuslens.sources import engines, images, json_files
from corpuslens.streaming import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write(tmp_path, value, name="x.json"):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def sample(i="a", g="x", p="y", **more):
    return {"sample_id": i, "ground_truth": g, "predicted": p, **more}


def test_samples(spark, tmp_path):
    found = json_files.load_samples(spark, write(tmp_path, [sample(g="", extra=1)])).collect()
    assert [tuple(r) for r in found] == [("a", "", "y")]


@pytest.mark.parametrize("bad", ["[{", {}, [], [1], [{"sample_id": "a", "ground_truth": "x"}], [sample(g=1)], [sample(p=None)], [sample(i="")], [sample(), sample()]])
def test_bad_samples(spark, tmp_path, bad):
    with pytest.raises(EvaluationInputError):
        json_files.load_samples(spark, write(tmp_path, bad))


def test_missing_file(spark, tmp_path):
    with pytest.raises(EvaluationInputError):
        json_files.load_samples(spark, str(tmp_path / "none.json"))


def test_ground_truth(spark, tmp_path):
    load = lambda v: {tuple(r) for r in json_files.load_ground_truth(spark, write(tmp_path, v)).collect()}
    assert load({"page-1.png": "t", "d/q.v1": {"ground_truth": "u"}}) == {("page-1", "t"), ("q", "u")}
    assert load([{"sample_id": "a.png", "ground_truth": "t"}, {"page": ".hidden", "ground_truth": ""}]) == {("a", "t"), (".hidden", "")}
    for bad in ([{"sample_id": None, "page": "a", "ground_truth": "t"}], [{"page": "a"}], {"a": 1}, [3], 5, {"a.png": "x", "a.jpg": "y"}, {"": "x"}):
        with pytest.raises(ProfileInputError):
            load(bad)


def png(path, w=12, h=9):
    rows = b"".join(b"\0" + b"\xff\x00\x00" * w for _ in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "B.png"), png(tmp_path / "a.PNG"), (tmp_path / "note.txt").write_text("x")
    assert [r["page"] for r in images.discover(spark, tmp_path).collect()] == ["a", "B"]
    assert images.load(spark, tmp_path / "B.png").select("image.width", "image.nChannels").first() == (12, 3)
    png(tmp_path / "a.bmp")
    with pytest.raises(ProfileInputError):
        images.discover(spark, tmp_path)
    for bad in (tmp_path / "none", tmp_path / "note.txt"):
        with pytest.raises(ProfileInputError):
            images.discover(spark, bad)
    with pytest.raises(ImageLoadError):
        images.load(spark, tmp_path / "note.txt")
    with pytest.raises(ImageLoadError):
        images.normalise_path(3)


def test_settings():
    assert engines.EngineSettings.from_environment({}).engine == "tesseract"
    assert engines.EngineSettings.from_environment({"OCR_ENGINE": " Paddle "}).engine == "paddle"
    assert engines.EngineSettings.resolve("tesseract", {"OCR_ENGINE": "paddle"}).engine == "tesseract"
    for bad in ("other", "", 3):
        with pytest.raises(ConfigurationError):
            engines.EngineSettings(bad)
    with pytest.raises(UnsupportedEngineError):
        engines.create("other")
    with pytest.raises((EngineNotInstalledError,)):
        engines.create("paddle")()
    if not engines.shutil.which("tesseract"):
        with pytest.raises(EngineNotFoundError):
            engines.create("tesseract")()
    assert engines.engine_version("no-such-engine") is None


class FixedEngine:
    name = "fixed"

    def extract(self, data, height, width, channels, psm):
        return {"text": ["Hi", "there."], "conf": [90, 50], "left": [0, 5], "top": [1, 1], "width": [4, 4], "height": [3, 3], "page_num": [1, 1], "block_num": [1, 1], "par_num": [1, 1], "line_num": [1, 1]}


class Model:
    """A line-recognition model with fixed results, in any of the shapes that the runtime returns."""

    def __init__(self, result=None, **options):
        self.result, self.options, self.seen = result, options, []

    def predict(self, image):
        self.seen.append(image)
        if isinstance(self.result, Exception):
            raise self.result
        return self.result


FIELDS = {"rec_texts": ["low", " ", "right", "left"], "rec_scores": [0.5, 7.0, 1, 0.25], "rec_boxes": [[0, 40, 20, 50], None, [30, 10, 50, 20], [[0, 10], [20, 10], [20, 20], [0, 20]]]}


def line_engine(result, **more):
    made = []
    return engines.LineRecogniser(model_factory=lambda **o: made.append(Model(result, **o)) or made[-1], **more), made


class Holder:
    def __init__(self, value, call=False):
        self.json = (lambda: value) if call else value


@pytest.mark.parametrize("result", [[FIELDS], FIELDS, [{"res": FIELDS, "rec_texts": ["other"]}], [Holder({"res": FIELDS})], [Holder(FIELDS, True)], iter([FIELDS])])
def test_line_recognition_shapes(result):
    engine, made = line_engine(result)
    assert not made
    found = engine.extract(bytes(60 * 100), 60, 100, 1, 3)
    assert found["text"] == ["left", "right", "low"] and found["conf"] == [25.0, 100.0, 50.0] and found["line_num"] == [1, 1, 2]
    assert [found[c][1] for c in ("left", "top", "width", "height")] == [30, 10, 20, 10] and set(found["page_num"]) == {1}
    assert made[0].seen[0].shape == (60, 100, 3) and made[0].options == engines.LINE_OPTIONS


def test_line_recognition_shrinks_and_maps_back():
    engine, made = line_engine([{"rec_texts": ["a"], "rec_scores": [1.0], "rec_boxes": [[-4, 1, 30, 25]]}], max_side=50)
    found = engine.extract(bytes(50 * 100 * 3), 50, 100, 3, 3)
    assert made[0].seen[0].shape == (25, 50, 3) and [found[c] for c in ("left", "top", "width", "height")] == [[0], [2], [60], [48]]
    engine.extract(bytes(3), 1, 1, 3, 3)
    assert len(made) == 1 and len(made[0].seen) == 2
    assert line_engine([])[0].extract(bytes(3), 1, 1, 3, 3)["text"] == []


@pytest.mark.parametrize("bad", [None, 5, "text", [{}], [{"res": 1}], [{**FIELDS, "rec_texts": "abcd"}], [{**FIELDS, "rec_scores": [1.0]}], [{**FIELDS, "rec_scores": [1.5] * 4}], [{**FIELDS, "rec_scores": [True] * 4}],
                                 [{**FIELDS, "rec_scores": ["1"] * 4}], [{**FIELDS, "rec_boxes": [[5, 0, 1, 1]] * 4}], [{**FIELDS, "rec_boxes": [[0, 0, float("nan"), 1]] * 4}], [{**FIELDS, "rec_boxes": ["x"] * 4}], [{**FIELDS, "rec_boxes": [[1, 2, 3]] * 4}]])
def test_bad_line_results(bad):
    with pytest.raises(RecognitionDataError):
        line_engine(bad)[0].extract(bytes(300), 10, 10, 3, 3)


def test_bad_line_engines_and_images():
    for side in (0, -1, True, 2.0, "9"):
        with pytest.raises(ValueError):
            engines.LineRecogniser(side, Model)
    for size in ((10, 10, 2, 200), (0, 10, 3, 0), (10, 10, 3, 299)):
        with pytest.raises(ValueError):
            line_engine([])[0].extract(bytes(size[3]), *size[:3], 3)
    with pytest.raises(EngineExecutionError):
        line_engine(RuntimeError("no memory"))[0].extract(bytes(300), 10, 10, 3, 3)

    def incomplete(**_):
        raise ModuleNotFoundError("part")

    with pytest.raises(EngineNotInstalledError):
        engines.LineRecogniser(model_factory=incomplete).extract(bytes(300), 10, 10, 3, 3)


def stand_in(tmp_path, monkeypatch, body):
    """A tesseract executable that runs a Python script."""
    path = tmp_path / "tesseract"
    path.write_text(f"#!{sys.executable}\n{body}")
    path.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")


def test_tesseract_process_and_version(tmp_path, monkeypatch):
    stand_in(tmp_path, monkeypatch, "import sys\nif '--version' in sys.argv:\n    print('tesseract 5.3.4')\nelse:\n    d = sys.stdin.buffer.read()\n    print('text\\tconf\\tleft')\n    print(d[-6:].hex() + '\\t9\\t' + sys.argv[4])")
    assert engines.engine_version("tesseract") == "5.3.4"
    found = engines.TesseractProcess().extract(bytes(range(6)), 1, 2, 3, 6)
    assert (found["text"], found["conf"], found["left"], found["top"]) == (["020100050403"], ["9"], ["6"], [])
    with pytest.raises(EngineExecutionError):
        engines.TesseractProcess().extract(b"", 0, 0, 3, 7)
    stand_in(tmp_path, monkeypatch, "import sys\nsys.exit(3)")
    assert engines.engine_version("tesseract") is None
    with pytest.raises(EngineExecutionError):
        engines.TesseractProcess().extract(bytes(6), 1, 2, 3, 3)


def test_unusable_images_raise_with_their_code(spark, tmp_path):
    png(tmp_path / "small.png", 2, 2)
    for run in (lambda: cli.recognise(spark, str(tmp_path / "small.png"), FixedEngine, 60.0), lambda: cli.run_profiles(spark, str(tmp_path), FixedEngine, None, 60.0)):
        with pytest.raises(InvalidImageError, match="too_small"):
            run()


def test_experiment_files(spark, tmp_path):
    png(tmp_path / "p.png", 40, 40)
    records = cli.run_profiles(spark, str(tmp_path / "p.png"), FixedEngine, write(tmp_path, {"p": "Hi there."}), 60.0)
    sinks.write_experiment(records, str(tmp_path / "out"), 60.0)
    report = json.loads((tmp_path / "out/results.json").read_text())
    assert len(report["results"]) == 20 and len(report["overall_ranking"]) == 20 and report["psm_modes"] == [4, 6, 11, 12] and len(report["notes"]) == 3
    with open(tmp_path / "out/results.csv", newline="") as f:
        table = list(csv.DictReader(f))
    assert len(table) == 20 and len(table[0]) == 18 and table[0]["raw_text"] == report["results"][0]["raw_text"] == "Hi there."


def test_runner(spark, tmp_path):
    png(tmp_path / "p.png", 40, 40)
    said = cli.run_all(spark, str(tmp_path / "p.png"), write(tmp_path, [sample(g="hello.", p="hello.")]), FixedEngine)
    assert said[0].startswith("recognition: done by fixed; 9 characters") and "cer 0.0000" in said[1] and "not run" in said[2] and said[3].endswith("0.5000")


def test_recognition_and_experiment_end_to_end(spark, tmp_path):
    png(tmp_path / "p.png", 40, 40)
    page = cli.recognise(spark, str(tmp_path / "p.png"), FixedEngine, 60.0).first()
    assert page["raw_text"] == "Hi there." and [r["text"] for r in page["low_confidence_regions"]] == ["there."]
    truth = write(tmp_path, {"p": "Hi there."})
    records = cli.run_profiles(spark, str(tmp_path / "p.png"), FixedEngine, truth, 60.0).collect()
    assert len(records) == 20 and {r["page_rank"] for r in records} == set(range(1, 21)) and all(r["composite_score"] == 1 for r in records)


def test_profile_images_are_written(spark, tmp_path):
    png(tmp_path / "p.png", 40, 40)
    made = imaging.preprocess_images(images.load(spark, tmp_path / "p.png"), all_profiles=True)
    sinks.write_profile_images(made, f"file://{tmp_path}/out")
    assert images.load(spark, tmp_path / "out").select("image.width", "image.height").distinct().collect() == [(40, 40)] and len(list((tmp_path / "out").iterdir())) == 5


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["evaluate", write(tmp_path, [sample(g="hello.", p="hello.")])]) == 0
    assert "MACRO (1) | 0.0000" in capsys.readouterr().out
    assert cli.main(["evaluate", write(tmp_path, "[{")]) == 2
    assert "Malformed JSON" in capsys.readouterr().err


def test_job_stream(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("e1", "j", "queued", at(0)), ("e1", "j", "queued", at(0)), ("e2", "j", "processing_ocr", at(5)), ("e3", "j", "completed", at(6)), ("e4", "j", "classifying", at(9))]
    spark.createDataFrame(rows, "event_id string, job_id string, state string, ts timestamp").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("event_id string, job_id string, state string, ts timestamp").parquet(str(tmp_path / "in"))
    q = jobs.transitions(jobs.deduplicated(events)).writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable(), q.stop()
    found = [(r["from_state"], r["to_state"], r["seconds"], r["accepted"]) for r in spark.table("steps").orderBy("ts").collect()]
    assert found == [(None, "queued", None, True), ("queued", "processing_ocr", 5.0, True), ("processing_ocr", "completed", None, False), ("processing_ocr", "classifying", 4.0, True)]
    assert {r["from_state"]: r["jobs"] for r in jobs.stage_latency(spark.table("steps")).collect()} == {"queued": 1, "processing_ocr": 1}
    assert {r["state"]: (r["entered"], r["left"], r["growth"]) for r in jobs.queue_depth(spark.table("steps")).collect()} == {"queued": (1, 1, 0), "processing_ocr": (1, 1, 0), "classifying": (1, 0, 1)}
    assert jobs.throughput(spark.table("steps")).collect() == []


class State:
    """The part of a group state that the job machine uses."""

    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.timeout = value, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms

    def getCurrentWatermarkMs(self):
        return 15_000


def test_jobs_are_forgotten():
    import pandas as pd

    state = State(("classifying", 0.0))
    (out,) = jobs._advance(("j",), iter([pd.DataFrame({"job_id": ["j", "j"], "state": ["completed", "queued"], "ts": [pd.Timestamp(10, unit="s"), pd.Timestamp(20, unit="s")]})]), state)
    assert out["accepted"].tolist() == [True, False] and state.value == ("completed", 10.0) and state.timeout == 20_000 + jobs.RETENTION_MS
    late = State(("completed", 10.0), True)
    assert list(jobs._advance(("j",), iter([]), late)) == [] and not late.exists


def test_scratch_tables_are_released(spark):
    from corpuslens.plans import scratch

    outer = scratch.Scratch(spark, "outer")
    kept = outer.save(spark.range(3))
    with scratch.released():
        inner = scratch.Scratch(spark, "inner")
        assert inner.save(spark.range(5)).count() == 5 and os.path.exists(inner.root.removeprefix("file://"))
    assert not os.path.exists(inner.root.removeprefix("file://")) and kept.count() == 3
    outer.drop(kept)
    assert not os.path.exists(kept._scratch_path.removeprefix("file://"))
