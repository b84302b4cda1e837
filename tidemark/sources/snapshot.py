"""Repository snapshots as tables of files."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Folders that a snapshot leaves out.
PRUNED = (".git", "node_modules", "__pycache__")


def archived_files(archives: DataFrame, max_bytes: int = 1_000_000) -> DataFrame:
    """SRC-3: repo, path, size, content of the files in tar archives (repo, content; compressed or not).

    Archives keep every name; Spark's own listing of a folder would lose those that begin with '_' or
    '.', such as ``__init__.py``. Read them with ``spark.read.format("binaryFile")``: one archive is
    one row of one task, streamed file by file. Paths are relative with slashes; pruned folders,
    links and files over ``max_bytes`` are left out before they are read; bytes that are no UTF-8
    become U+FFFD. A damaged archive gives the files before the damage.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for repo, body in zip(pdf["repo"], pdf["content"], strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(body), mode="r|*") as tar:
                        for m in tar:
                            path = m.name.removeprefix("./")
                            if m.isfile() and m.size <= max_bytes and not set(path.split("/")[:-1]) & set(PRUNED):
                                rows.append((repo, path, m.size, tar.extractfile(m).read().decode("utf-8", "replace")))
                                if len(rows) == 200:
                                    yield pd.DataFrame(rows, columns=["repo", "path", "size", "content"])
                                    rows = []
                except (tarfile.TarError, EOFError, OSError):
                    pass
                yield pd.DataFrame(rows, columns=["repo", "path", "size", "content"])

    return archives.select("repo", "content").mapInPandas(run, "repo string, path string, size long, content string")


def repository_tree(files: DataFrame) -> DataFrame:
    """repo, path, size and content hash of snapshot files: what the index compares."""
    return files.select("repo", "path", "size", F.sha2("content", 256).alias("content_hash"))
