"""Files of any encoding as a text table, routed by extension, and hooks for converters of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quireframe.functions.encoding import encoding_warning, with_decoded

Converter = Callable[[DataFrame], DataFrame]


class Converters:
    """Extension -> converter; a file whose extension is not registered is left out."""

    def __init__(self) -> None:
        self._by_ext: dict[str, Converter] = {}

    def register(self, *extensions: str):
        def keep(fn: Converter) -> Converter:
            for e in extensions:
                self._by_ext[e.lower().lstrip(".")] = fn
            return fn

        return keep

    def get(self, extension: str) -> Converter | None:
        return self._by_ext.get(extension.lower().lstrip("."))

    def convert(self, files: DataFrame) -> DataFrame | None:
        """Each registered converter over its own files; all must give the same columns."""
        out = None
        for ext, fn in self._by_ext.items():
            part = fn(files.filter(F.col("extension") == ext))
            out = part if out is None else out.unionByName(part)
        return out


def extension_glob(extensions: tuple[str, ...]) -> str:
    """A file name pattern for these extensions in any case, so that other files are never opened."""
    names = ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    return f"*.{{{','.join(names)}}}"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "length", "content")


def read_text_corpus(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md", "markdown")) -> DataFrame:
    """path, extension, text, encoding, assumed, warning: one row per text file under ``path``."""
    files = read_files(spark, path, extension_glob(extensions))
    t = with_decoded(files, "content")
    return t.select("path", "extension", "text", "encoding", "assumed", encoding_warning(F.col("encoding"), F.col("assumed")).alias("warning"))


def map_images(images: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """A recogniser, encoder or extractor of the user's over an image table: ``make`` is called once per task, its result
    once per Arrow batch, so a model is loaded once and never sees more than a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make()
        for pdf in batches:
            yield fn(pdf)

    return images.mapInPandas(run, schema)
