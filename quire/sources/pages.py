"""Page text extraction from document files (SR1, with SR2 in the same task).

``spark.read.format("binaryFile")`` lists and reads the files (one row per
file, partitioned across the cluster); a user extractor turns one file's
bytes into its pages. The reference rasterises PDFs and runs OCR per page;
here the extractor is a plain callable so any engine can be plugged in. The
default decodes UTF-8 text and splits pages on form feeds.

Extractor contract: ``extract(content: bytes) -> list[page]`` where a page is
either its text or a zero-argument callable producing it (so one page can
fail without losing the others). Semantics (D23): a failing page is reported
in ``error`` and skipped; a file whose page list is empty assembles to null;
a file whose pages all fail assembles to ''.

``extract_text`` assembles inside the extracting task: all pages of a file are
produced by one task already, so assembly needs no shuffle.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schemas import PAGE

PAGE_SPLIT = "\f"
#: Spark lists up to 10,000 folders in a task each; here a listing is shared by a few tasks a core.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS = 4


def default_extractor(content: bytes) -> list:
    text = content.decode("utf-8")
    return text.split(PAGE_SPLIT) if text else []


def _pages_of(content: bytes, extract: Callable) -> tuple[list, str | None]:
    try:
        pages = list(extract(content))
    except Exception as e:  # the whole file could not be opened: no pages
        return [], f"{type(e).__name__}: {e}"
    out = []
    for i, p in enumerate(pages):
        try:
            out.append((i + 1, p() if callable(p) else p, None))
        except Exception as e:
            out.append((i + 1, None, f"page {i + 1}: {type(e).__name__}: {e}"))
    return out, None


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    conf, tasks = spark.conf, str(LISTING_TASKS * spark.sparkContext.defaultParallelism)
    before = conf.get(LISTING, None)
    conf.set(LISTING, tasks)  # ``load`` lists the files
    try:
        return r.load(path)
    finally:
        conf.unset(LISTING) if before is None else conf.set(LISTING, before)


def extract_pages(files: DataFrame, extract: Callable = default_extractor) -> DataFrame:
    """SR1: (doc_id = file path, page_no from 1, text, error); failing pages keep a row with the error."""

    def run(it):
        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                pages, err = _pages_of(bytes(content), extract)
                if err:
                    rows.append((path, 0, None, err))
                rows.extend((path, n, t, e) for n, t, e in pages)
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "error"])

    return files.select("path", "content").mapInPandas(run, PAGE)


def extract_text(files: DataFrame, extract: Callable = default_extractor, sep: str = "\n") -> DataFrame:
    """SR1 + SR2 without a shuffle: (doc_id, text, n_pages, n_failed)."""

    def run(it):
        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                pages, err = _pages_of(bytes(content), extract)
                if not pages:
                    rows.append((path, None, 0, 0))
                    continue
                good = [t for _, t, e in pages if e is None and t is not None]
                rows.append((path, sep.join(good), len(pages), len(pages) - len(good)))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_pages", "n_failed"])

    return files.select("path", "content").mapInPandas(
        run, "doc_id string, text string, n_pages int, n_failed int")
