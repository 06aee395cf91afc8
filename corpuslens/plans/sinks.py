"""Report files: page results, experiment records, evaluation tables."""

from __future__ import annotations

import csv
import io
import json
import os
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.errors import ProfileExecutionError
from corpuslens.operators.experiment import MODES, PROFILES, configuration_means, overall_ranking
from corpuslens.operators.lines import page_payload
from corpuslens.operators.metrics import evaluate, format_report, macro_average, require_samples
from corpuslens.plans.scratch import Scratch
from corpuslens.sources.json_files import load_samples, stem


def write_pages(pages: DataFrame, path: str, compression: str = "none") -> None:
    """Page results as JSON lines; with "gzip", about a tenth of the bytes, and Spark reads them back alike."""
    page_payload(pages).select("json").write.mode("overwrite").option("compression", compression).text(path)


def write_page_file(pages: DataFrame, path: str) -> None:
    """One page result as an indented UTF-8 JSON file (a driver-side report)."""
    row = page_payload(pages).first()
    path = os.path.expanduser(path)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(json.loads(row["json"]), ensure_ascii=False, indent=2) + "\n")


def png(data: bytes, height: int, width: int) -> bytes:
    """A grey 8-bit PNG file."""
    rows = b"".join(b"\0" + data[i * width : (i + 1) * width] for i in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_profile_images(made: DataFrame, uri: str) -> None:
    """One PNG per row of preprocess_images, named page_profile.png, written by the executors to a shared URI."""
    rows = made.filter("error IS NULL").select(F.concat_ws("_", stem(F.col("origin")), "profile").alias("name"), "height", "width", "data")

    def save(partition) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for r in partition:
            with store.open_output_stream(f"{root}/{r['name']}.png") as f:
                f.write(png(bytes(r["data"]), r["height"], r["width"]))

    rows.foreachPartition(save)


#: What a reader of the results should know.
NOTES = [
    "An engine's confidence says little about accuracy.",
    "Removing ruled lines can remove strokes of letters too.",
    "Confidence alone never decides the ranking.",
]


def write_experiment(records: DataFrame, path: str, threshold: float) -> None:
    """records as folders of JSON lines and CSV (for any size), and results.json and results.csv as single files.

    The single files are streamed row by row to the shared store under ``path``, so the driver holds one partition at a time.
    """
    from pyarrow import fs

    saved = Scratch(records.sparkSession, "experiment").save(records)
    try:
        saved.write.mode("overwrite").json(f"{path}/records")
        saved.write.mode("overwrite").option("header", True).csv(f"{path}/records_csv")
        ranking = [r.asDict() for r in overall_ranking(configuration_means(saved)).orderBy("overall_rank").collect()]
        summary = {
            "notes": NOTES,
            "low_confidence_threshold": threshold,
            "psm_modes": MODES,
            "profiles": PROFILES,
            "ranking_basis": "composite score, source fidelity, sentence F1, word and character error rate of pages with a ground truth; none without one",
            "overall_ranking": ranking,
        }
        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(os.path.expanduser(path))}")
        ordered = saved.orderBy("page", "profile", "psm")
        with store.open_output_stream(f"{root}/results.json") as out, store.open_output_stream(f"{root}/results.csv") as table:
            head = json.dumps(summary, ensure_ascii=False, indent=2)
            out.write((head.removesuffix("\n}") + ',\n  "results": [').encode())
            table.write((csv_line(saved.columns)).encode())
            for i, row in enumerate(ordered.toLocalIterator()):
                out.write((("," if i else "") + "\n    " + json.dumps(row.asDict(), ensure_ascii=False)).encode())
                table.write(csv_line(["" if v is None else v for v in row]).encode())
            out.write(b"\n  ]\n}\n")
    except OSError as x:
        raise ProfileExecutionError(f"could not write {path}") from x


def csv_line(values: list) -> str:
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerow(values)
    return text.getvalue()


def report_samples(samples: DataFrame) -> str:
    """Per-sample table and macro row of an evaluation set; results are collected, so this is for reports."""
    results = evaluate(samples)
    results = results.select(*[F.col(c) for c in results.columns if c not in ("ground_truth", "predicted")]).cache()
    try:
        aggregate = require_samples(macro_average(results)).first()
        return format_report(results.orderBy("sample_id").collect(), aggregate)
    finally:
        results.unpersist()


def report_file(spark, path: str) -> str:
    return report_samples(load_samples(spark, path))
