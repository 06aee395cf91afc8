"""Image discovery and loading through Spark's file sources."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.errors import ImageLoadError, ProfileInputError
from corpuslens.sources.json_files import duplicates, stem

#: Fixed value: recognised suffixes.
SUFFIXES = [".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp"]


def normalise_path(path) -> str:
    """A str or PathLike with ~ expanded; not resolved."""
    if not isinstance(path, (str, os.PathLike)):
        raise ImageLoadError(f"a path must be a string, not {type(path).__name__}")
    return os.path.expanduser(os.fspath(path))


def discover(spark: SparkSession, path) -> DataFrame:
    """path, page (stem) of one image or of the images directly in a folder, by case-folded name.

    Errors: nothing there, no supported suffix, or two images with one stem.
    """
    from pyspark.sql.utils import AnalysisException

    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(normalise_path(path)).select("path")
        found = files.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).filter(F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(SUFFIXES))
        found = found.withColumn("page", stem(F.col("name")))
        empty = found.isEmpty()
    except AnalysisException as x:
        raise ProfileInputError(f"no such path: {path}") from x
    if empty:
        raise ProfileInputError(f"no supported image at {path}")
    if not duplicates(found, "page").isEmpty():
        raise ProfileInputError("two images share a stem")
    return found.select("path", "page").orderBy(F.lower("name"))


def load(spark: SparkSession, path, strict: bool = True) -> DataFrame:
    """Spark image rows; undecodable files raise, or are kept with nChannels -1."""
    images = spark.read.format("image").option("dropInvalid", False).load(normalise_path(path))
    if strict and not images.filter("image.nChannels < 0").isEmpty():
        raise ImageLoadError(f"an image at {path} can't be decoded")
    return images
