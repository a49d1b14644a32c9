"""A bounded sample of labelled documents, from which the classifiers learn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import id_crc, text_of

#: Bounds of the sample: rows, and characters of all their texts.
SAMPLE_ROWS = 4_000
SAMPLE_CHARS = 16_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out, id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[bytes], np.ndarray]:
    """Texts (UTF-8) and 0/1 labels of at most ``rows`` rows, the first by a hash of the id that are not held out.

    Rows whose label is null or neither 0 nor 1 teach nothing; of several labels
    of one id the largest counts; a row that repeats id and text teaches once. A
    text that would exceed ``chars`` is passed over, later ones may still fit. If
    there are labelled texts but none fits, that is an error. Lengths are chosen
    from first, so only texts of the bounded sample leave their tasks.
    """
    some = labels.select(F.col(id).alias("__id"), F.col(label).cast("int").alias("__y")).filter(F.col("__y").isin(0, 1) & F.col("__id").isNotNull())
    some = some.filter(~held_out(id_crc("__id"))).groupBy("__id").agg(F.max("__y").alias("__y"))
    some = some.orderBy(F.xxhash64("__id"), "__id").limit(rows)  # so bounded for the broadcast
    found = docs.select(F.col(id).alias("__id"), text_of(text).alias("__text")).join(F.broadcast(some), "__id").withColumn("__h", F.xxhash64("__id", "__text"))
    sizes = found.groupBy("__h").agg(F.min(F.xxhash64("__id")).alias("__at"), F.max(F.length("__text")).alias("__n")).orderBy("__at", "__n", "__h").limit(rows)
    picked, total, any_text = [], 0, False
    for h, _, n in sizes.collect():
        any_text = True
        if total + n <= chars:
            picked.append((h,))
            total += n
    if any_text and not picked:
        raise ValueError(f"No labelled text has at most {chars} characters.")
    if not picked:
        return [], np.zeros(0)
    wanted = docs.sparkSession.createDataFrame(picked, "__h long")
    got = found.join(F.broadcast(wanted), "__h").select("__h", F.col("__text").cast("binary").alias("__text"), "__y").collect()
    one = {r[0]: (bytes(r[1]), float(r[2])) for r in got}
    taken = [one[h] for h in sorted(one)]
    return [t for t, _ in taken], np.array([y for _, y in taken])
