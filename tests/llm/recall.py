"""Measures op9's recall: documents whose id is divisible by 50 against all, by exact likeness.

python -m tests.llm.recall /root/testdata/sf0.1
"""

import sys

import numpy as np
import pyarrow.dataset as ds

from pixelweave.llm import icws

BORDERS = (0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def measured(where: str, classes: dict | None = None) -> list[tuple]:
    """(from, to, pairs of different texts, share that meets in a band, share in one class) by likeness."""
    table = ds.dataset(f"{where}/documents.parquet").to_table(columns=["doc_id", "text"]).combine_chunks()
    keys = table.column("doc_id").to_numpy()
    column = table.column("text").combine_chunks()
    row, gram, count = icws.shingles(column)
    known, which, df = np.unique(gram, return_inverse=True, return_counts=True)
    common = df >= len(keys) * icws.COMMON_SHARE
    weights = icws.Weights(known[common], df[common], len(keys))
    w = weights.of(gram, count)
    whole = np.bincount(row, w, minlength=len(keys))
    by_gram = np.argsort(which, kind="stable")
    begin = np.concatenate([[0], np.cumsum(df)])
    starts = np.searchsorted(row, np.arange(len(keys) + 1))
    has, samples, _ = icws._samples(column, weights, icws.Sampler())
    bands = np.zeros((len(keys), icws.BANDS), dtype=np.uint64)
    bands[has] = icws.band_hashes(samples)
    texts = column.to_pylist()
    found = []
    for q in np.flatnonzero(keys % 50 == 0):
        both = np.zeros(len(keys))
        for k in range(starts[q], starts[q + 1]):
            at = by_gram[begin[which[k]] : begin[which[k] + 1]]
            both[row[at]] += np.minimum(w[at], w[k])
        like = both / (whole + whole[q] - both + 1e-300)
        for d in np.flatnonzero(like >= BORDERS[0]):
            if texts[d] != texts[q]:
                found.append((like[d], (bands[d] == bands[q]).any(), classes is not None and classes[keys[d]] == classes[keys[q]]))
    x = np.array(found, dtype=float).reshape(-1, 3)
    out = []
    for low, high in zip(BORDERS, BORDERS[1:]):
        own = x[(x[:, 0] >= low) & ((x[:, 0] < high) | (high == 1.0))]
        out.append((low, high, len(own), own[:, 1].mean() if len(own) else None, own[:, 2].mean() if len(own) else None))
    return out


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from pixelweave.llm import queries

    spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    made = {r.doc_id: r.class_id for r in queries.op9_near_duplicates(spark, sys.argv[1]).collect()}
    for line in measured(sys.argv[1], made):
        print(*line)
