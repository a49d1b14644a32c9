"""What the shuffles of words outside the head write."""

import numpy as np

from timberline.llm import brown


def test_a_word_is_shuffled_as_three_numbers(spark):
    coded = spark.createDataFrame([(0, 0, False, [-1, 0], [7])], "row long, id long, held boolean, ids array<int>, others array<long>")
    pairs = np.ones((brown.CLASSES + 1, brown.CLASSES + 1))
    made = brown.tail_round(coded, np.zeros(1, np.int64), pairs)
    dealt = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line]
    assert dealt and not any("place" in line for line in dealt)
    assert [(r.row, len(r.tails), r.known, r.new, r.once) for r in made.collect()] == [(0, 1, 1, 1, 1)]
