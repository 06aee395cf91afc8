"""Recognition engines behind one seam: settings, registry, and ``mapInPandas`` execution.

An engine is a factory without arguments that is called once per Python worker (lazily) and returns an
object with ``extract(data, height, width, channels, psm) -> dict of parallel lists``. Engine binaries
are optional: a missing runtime raises, nothing falls back. ``replay`` reads recorded payloads.
"""

from __future__ import annotations

import importlib
import importlib.metadata
import importlib.util
import math
import numbers
import os
import shutil
import subprocess
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from corpuslens.errors import ConfigurationError, EngineExecutionError, EngineNotFoundError, EngineNotInstalledError, RecognitionDataError, UnsupportedEngineError
from corpuslens.operators.experiment import MODES
from corpuslens.operators.imaging import resize_area
from corpuslens.operators.reading_order import line_numbers
from corpuslens.operators.tokens import MAX_SIDE

ENGINES = ("tesseract", "paddle")
SETTING = "OCR_ENGINE"
COLUMNS = ["text", "conf", "left", "top", "width", "height", "page_num", "block_num", "par_num", "line_num"]
PAYLOAD = "origin string, psm int, data struct<" + ", ".join(f"{c}: array<string>" for c in COLUMNS) + ">"
_REGISTRY: dict[str, Callable[[], object]] = {}


@dataclass(frozen=True)
class EngineSettings:
    engine: str = "tesseract"

    def __post_init__(self):
        if not isinstance(self.engine, str):
            raise ConfigurationError("engine must be a string")
        name = self.engine.strip().casefold()
        if name not in ENGINES and name not in _REGISTRY:
            raise ConfigurationError(f"unknown engine {self.engine!r}")
        object.__setattr__(self, "engine", name)

    @classmethod
    def from_environment(cls, environ=None) -> EngineSettings:
        return cls((environ if environ is not None else os.environ).get(SETTING, "tesseract"))

    @classmethod
    def resolve(cls, flag: str | None, environ=None) -> EngineSettings:
        """An explicit flag wins over the environment, the environment over the default."""
        return cls(flag) if flag is not None else cls.from_environment(environ)


def register(name: str, factory: Callable[[], object]) -> None:
    _REGISTRY[name.casefold()] = factory


def create(name: str | EngineSettings) -> Callable[[], object]:
    """Factory of a named engine."""
    name = name.engine if isinstance(name, EngineSettings) else name
    if not isinstance(name, str) or (name not in _REGISTRY and name not in ENGINES):
        raise UnsupportedEngineError(f"unsupported engine {name!r}")
    if name in _REGISTRY:
        return _REGISTRY[name]
    return TesseractProcess if name == "tesseract" else LineRecogniser


class TesseractProcess:
    """Runs the tesseract executable on a PNM image and parses its TSV output."""

    name = "tesseract"

    def __init__(self):
        self.executable = shutil.which("tesseract")
        if not self.executable:
            raise EngineNotFoundError("the tesseract executable is not installed")

    def extract(self, data: bytes, height: int, width: int, channels: int, psm: int) -> dict:
        if psm not in (3, *MODES):
            raise EngineExecutionError(f"unsupported segmentation mode {psm}")
        kind = b"P5" if channels == 1 else b"P6"
        raw = bytes(data) if channels == 1 else np.frombuffer(data, np.uint8).reshape(-1, 3)[:, ::-1].tobytes()  # BGR to RGB
        try:
            done = subprocess.run([self.executable, "-", "-", "--psm", str(psm), "tsv"], input=kind + b"\n%d %d\n255\n" % (width, height) + raw, capture_output=True, check=True)
        except (OSError, subprocess.CalledProcessError) as x:
            raise EngineExecutionError("tesseract failed") from x
        table = [line.split("\t") for line in done.stdout.decode("utf-8", "replace").splitlines()]
        if not table:
            raise RecognitionDataError("tesseract returned no table")
        columns = dict(zip(table[0], zip(*[r for r in table[1:] if len(r) == len(table[0])], strict=True), strict=False))
        return {c: list(columns.get(c, ())) for c in COLUMNS}


#: Options of the line-recognition runtime.
LINE_OPTIONS = {
    "text_detection_model_name": "PP-OCRv5_mobile_det",
    "text_recognition_model_name": "PP-OCRv5_mobile_rec",
    "use_doc_orientation_classify": False,
    "use_doc_unwarping": False,
    "use_textline_orientation": False,
    "device": "cpu",
    "enable_mkldnn": False,
    "cpu_threads": 1,
    "text_det_limit_type": "max",
    "text_det_limit_side_len": 1600,
}
LINE_FIELDS = ["rec_texts", "rec_scores", "rec_boxes"]


class LineRecogniser:
    """Line recognition by the optional paddleocr package, or by any model with ``predict(bgr image)``.

    The model is made at the first image of a Python worker, which has one task thread, so calls never overlap. Images
    larger than ``max_side`` are shrunk; boxes come back in source pixels, lines in reading order.
    """

    name = "paddle"

    def __init__(self, max_side: int = MAX_SIDE, model_factory: Callable[..., object] | None = None):
        if isinstance(max_side, bool) or not isinstance(max_side, int) or max_side < 1:
            raise ValueError("max_side must be an integer of at least 1")
        self.max_side, self.factory, self.model = max_side, model_factory, None
        if model_factory is None and importlib.util.find_spec("paddleocr") is None:
            raise EngineNotInstalledError("the paddleocr package is not installed")

    def _predict(self, image: np.ndarray):
        if self.model is None:
            try:
                make = self.factory or importlib.import_module("paddleocr").PaddleOCR
                self.model = make(**LINE_OPTIONS)
            except (ImportError, AttributeError) as x:
                raise EngineNotInstalledError("the paddleocr runtime is incomplete") from x
        try:
            return self.model.predict(image)
        except Exception as x:
            raise EngineExecutionError(f"line recognition failed: {x}") from x

    def extract(self, data: bytes, height: int, width: int, channels: int, psm: int) -> dict:
        if channels not in (1, 3) or height < 1 or width < 1 or len(data) != height * width * channels:
            raise ValueError("an image must hold height x width pixels of one or three bytes")
        image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        image = np.repeat(image, 3, axis=2) if channels == 1 else image.copy()
        ratio = min(1.0, self.max_side / max(height, width))
        sides = [max(1, round(n * ratio)) for n in (width, height)]
        shown = resize_area(image, *sides) if ratio < 1 else image
        return parse_lines(self._predict(shown), width, height, sides[0] / width, sides[1] / height)


def _recognition(page, number: int) -> Mapping:
    """The fields of one result page: under "res", at the top, or in its ``json`` (an attribute or a method)."""
    for offered in (lambda: page, lambda: page.json() if callable(getattr(page, "json", None)) else getattr(page, "json", None)):
        found = offered()
        if isinstance(found, Mapping):
            if "res" in found:
                if not isinstance(found["res"], Mapping):
                    raise RecognitionDataError(f"page {number}: res holds no fields")
                return found["res"]
            if all(f in found for f in LINE_FIELDS):
                return found
    raise RecognitionDataError(f"page {number} has no recognition fields")


def _number(value, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, numbers.Real) or not math.isfinite(value):
        raise RecognitionDataError(f"{what} must be a finite number")
    return float(value)


def _edges(value, what: str) -> tuple[float, float, float, float]:
    """left, top, right, bottom of four numbers, or of a polygon of at least four points."""
    try:
        points = np.asarray(value, float)
    except (TypeError, ValueError) as x:
        raise RecognitionDataError(f"{what} is no box") from x
    if points.ndim == 2 and points.shape[0] >= 4 and points.shape[1] == 2:
        points = np.concatenate([points.min(0), points.max(0)])
    if points.shape != (4,) or not np.isfinite(points).all() or (points[2:] < points[:2]).any():
        raise RecognitionDataError(f"{what} is no box")
    return tuple(points.tolist())


def parse_lines(result, width: int, height: int, scale_x: float, scale_y: float) -> dict:
    """Columns of recognised lines in reading order, from results in the coordinates of the shrunk image."""
    if result is None:
        raise RecognitionDataError("the model returned nothing")
    if isinstance(result, (str, bytes, Mapping)):
        result = [result]
    try:
        pages = list(result)
    except TypeError as x:
        raise RecognitionDataError("the model must return pages") from x
    found = []
    for number, page in enumerate(pages):
        fields = _recognition(page, number)
        columns = [fields.get(f) for f in LINE_FIELDS]
        if any(not isinstance(c, (Sequence, np.ndarray)) or isinstance(c, (str, bytes)) for c in columns) or len({len(c) for c in columns}) > 1:
            raise RecognitionDataError(f"page {number}: recognition fields must be lists of one length")
        for i, (text, score, box) in enumerate(zip(*columns, strict=True)):
            if not str(text).strip():
                continue
            confidence = _number(score, f"score {i}")
            if not 0 <= confidence <= 1:
                raise RecognitionDataError(f"score {i} must lie between 0 and 1")
            place = lambda v, scale, most: min(max(round(v / scale), 0), most)
            l, t, r, b = _edges(box, f"box {i}")
            x, y = place(l, scale_x, width), place(t, scale_y, height)
            found.append((str(text), confidence * 100, x, y, max(0, place(r, scale_x, width) - x), max(0, place(b, scale_y, height) - y)))
    sides = [np.array([f[i] for f in found], float) for i in (3, 2, 4, 5)]
    line, at = line_numbers(*sides, np.arange(len(found)))
    order = np.argsort(at)
    out = {c: [found[k][i] for k in order] for i, c in enumerate(COLUMNS[:6])}
    return out | {"page_num": [1] * len(found), "block_num": [0] * len(found), "par_num": [0] * len(found), "line_num": line[order].tolist()}


def engine_version(name: str) -> str | None:
    """Version of an engine: what the tesseract executable says, or of the installed package; null if there is none."""
    if name == "tesseract":
        executable = shutil.which("tesseract")
        try:
            said = subprocess.run([executable, "--version"], capture_output=True, check=True) if executable else None
        except (OSError, subprocess.CalledProcessError):
            return None
        first = (said.stdout or said.stderr).decode("utf-8", "replace").split("\n")[0].split() if said else []
        return first[1].lstrip("v") if len(first) > 1 else None
    try:
        return importlib.metadata.version({"paddle": "paddleocr"}.get(name, name))
    except importlib.metadata.PackageNotFoundError:
        return None


_workers: dict = {}


def extract(images: DataFrame, factory: Callable[[], object], psm: int = 3) -> DataFrame:
    """origin, psm, data (payload of parallel arrays) of images (origin, height, width, data); one engine per worker."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = _workers.get(factory) or _workers.setdefault(factory, factory())
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                channels = len(r.data) // max(1, r.height * r.width)
                payload = engine.extract(r.data, r.height, r.width, channels, psm)
                if not isinstance(payload, dict):
                    raise RecognitionDataError("an engine must return a mapping of columns")
                rows.append((r.origin, psm, {c: [str(v) for v in payload.get(c, [])] for c in COLUMNS}))
            yield pd.DataFrame(rows, columns=["origin", "psm", "data"])

    return images.select("origin", "height", "width", "data").mapInPandas(work, PAYLOAD)
