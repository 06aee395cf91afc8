"""Command line: evaluate a JSON file, run recognition on images, run the profile experiment.

Exit code 2 on bad input.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from corpuslens.errors import CorpusLensError, InvalidImageError
from corpuslens.operators import experiment, imaging, lines, metrics, tokens
from corpuslens.functions import text as T
from corpuslens.plans import sinks
from corpuslens.plans.scratch import Scratch, clear
from corpuslens.session import get_session
from corpuslens.sources import engines, images, json_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpuslens")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("evaluate", help="metrics of a JSON file of samples")
    e.add_argument("path")
    o = sub.add_parser("recognise", help="text of one image")
    o.add_argument("image")
    o.add_argument("--engine")
    o.add_argument("--output")
    o.add_argument("--confidence-threshold", type=float, default=lines.LOW_CONFIDENCE)
    x = sub.add_parser("experiment", help="all profiles and modes of images")
    x.add_argument("images")
    x.add_argument("--ground-truth")
    x.add_argument("--output", required=True)
    x.add_argument("--confidence-threshold", type=float, default=lines.LOW_CONFIDENCE)
    r = sub.add_parser("run", help="recognition, evaluation and a source-fidelity example, one line each")
    r.add_argument("image")
    r.add_argument("samples")
    r.add_argument("--engine")
    return p


def run_all(spark, image: str, samples: str, factory) -> list[str]:
    """One line for each part of the engine, whether it ran or needs something from outside."""
    page = recognise(spark, image, factory, lines.LOW_CONFIDENCE).first()
    said = [f"recognition: done by {page['engine_name']}; {len(page['raw_text'])} characters, {len(page['sentences'])} sentences, {len(page['low_confidence_regions'])} uncertain tokens"]
    macro = metrics.require_samples(metrics.macro_average(metrics.evaluate(json_files.load_samples(spark, samples)))).first()
    figures = ", ".join(f"{m} {macro[m]:.4f}" for m in ("cer", "wer", "sentence_f1", "composite_score"))
    said.append(f"evaluation: done; samples {macro['sample_count']}, {figures}")
    said.append("classification: not run; it needs a client")
    example = spark.sql("SELECT 'Please wait!!!' AS truth, 'Please wait!' AS predicted").select(T.source_fidelity(F.col("truth"), F.col("predicted"))).first()[0]
    return [*said, f"source fidelity: done; example {example:.4f}"]


def usable(spark, made):
    """The preprocessed images, saved so that every mode reads them; an image that can't be used raises."""
    saved = Scratch(spark, "images").save(made)
    bad = saved.filter("error IS NOT NULL").select("origin", "error").limit(1).collect()
    if bad:
        raise InvalidImageError(f"{bad[0]['origin']}: {bad[0]['error']}")
    return saved


def recognise(spark, path: str, factory, threshold: float):
    """Page results of images through preprocessing, an engine and line assembly."""
    tokens.validate_threshold(threshold)
    loaded = images.load(spark, path)
    made = usable(spark, imaging.preprocess_images(loaded))
    found = engines.extract(made, factory).withColumnRenamed("origin", "doc_id")
    heights = loaded.select(F.col("image.origin").alias("doc_id"), F.col("image.height").alias("image_height"))
    rows = tokens.require_valid(tokens.word_table_tokens(found))
    name = getattr(factory, "name", "custom")
    return lines.recognise_pages(rows, heights, threshold, name, engines.engine_version(name))


def run_profiles(spark, path: str, factory, truth_path: str | None, threshold: float):
    tokens.validate_threshold(threshold)
    pages = images.discover(spark, path)
    made = usable(spark, imaging.preprocess_images(images.load(spark, path), all_profiles=True))
    keyed = made.withColumn("origin", F.concat_ws("\t", json_files.stem(F.col("origin")), "profile"))
    found = None
    for mode in experiment.MODES:
        part = engines.extract(keyed, factory, mode)
        found = part if found is None else found.unionByName(part)
    words = tokens.require_valid(tokens.word_table_tokens(found.withColumn("doc_id", F.concat_ws("\t", "origin", "psm"))))
    parts = F.split("doc_id", "\t")
    words = words.withColumns({"page": parts[0], "profile": parts[1], "psm": parts[2].cast("int")})
    truth = json_files.load_ground_truth(spark, truth_path) if truth_path else spark.createDataFrame([], "page string, ground_truth string")
    return experiment.run_experiment(pages.select("page", F.col("path").alias("source_image")), words, truth, threshold)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = get_session()
    try:
        if args.command == "evaluate":
            print(sinks.report_file(spark, args.path))
        elif args.command == "recognise":
            factory = engines.create(engines.EngineSettings.resolve(args.engine))
            pages = recognise(spark, args.image, factory, args.confidence_threshold)
            if args.output:
                sinks.write_page_file(pages, args.output)
            else:
                print(lines.page_payload(pages).first()["json"])
        elif args.command == "run":
            factory = engines.create(engines.EngineSettings.resolve(args.engine))
            print("\n".join(run_all(spark, args.image, args.samples, factory)))
        else:
            factory = engines.create(engines.EngineSettings.from_environment())
            sinks.write_experiment(run_profiles(spark, args.images, factory, args.ground_truth, args.confidence_threshold), args.output, args.confidence_threshold)
    except CorpusLensError as x:
        print(f"error: {x}", file=sys.stderr)
        return 2
    finally:
        clear()
    return 0


if __name__ == "__main__":
    sys.exit(main())
