"""Lines of text files with their places, whole whatever characters they hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "file string, start long, line long, value string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start, line, value: each line with the byte at which its split of the file begins and its number in the split, from 0.

    A task reads the splits it was given one after another, so it numbers lines as
    they come; nothing is shuffled. The first line of a file has start and line 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            start = batch.column("start").to_numpy()
            file = batch.column("file").dictionary_encode()
            code = file.indices.to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | (code[1:] != code[:-1])]))
            line = np.arange(batch.num_rows) - np.repeat(new, np.diff(np.append(new, batch.num_rows)))
            first = (file.dictionary[int(code[0])].as_py(), int(start[0]))
            if first == last:
                line[: new[1] if len(new) > 1 else None] += so_far
            last, so_far = (file.dictionary[int(code[-1])].as_py(), int(start[-1])), int(line[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("start"), pa.array(line), batch.column("value")], ["file", "start", "line", "value"])

    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value").mapInArrow(run, LINES)
