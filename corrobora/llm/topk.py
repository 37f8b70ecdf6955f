"""Exact top-k search by pivot-table elimination.

Every component x of a vector becomes floor(256 x), and the score of two vectors is the integer inner product. For a
query q and a candidate c no pivot p allows |q - c| to be below |d(q, p) - d(c, p)|, so the largest such difference
bounds the distance from below, and with both lengths it bounds the score from above: 2 q.c = |q|^2 + |c|^2 - |q - c|^2.
A second bound uses what the first pivots span: the score is at most the product of both projections on that span plus
the product of the lengths left over. Candidates are evaluated in the order of the smaller bound, and the search of a
query stops when no bound left reaches its k-th best score.

Pivots are chosen farthest first from a bounded sample (the ``SAMPLE`` rows of smallest hashed id), so that they differ.
The same sample gives each query a score that k candidates reach before any block is searched; every block starts from
it. Queries and candidates are dealt to blocks; each pair of blocks is one task of bounded size, which works out the
pivot table of its candidates once for all its queries, and returns at most k rows per query to be ranked again.

Null and empty cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows
without an id; a query shares no score with vectors of another length; rows that repeat an id are candidates of their
own but never of a query with the same id; ties go to the smaller id; an empty table gives an empty result. Vectors so
long that a score could pass 64 bits end in an error, never in a wrong score.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corrobora.llm.vectors import cells
from corrobora.session import cut_lineage

K = 5
SCALE = 256
PIVOTS = 64
SAMPLE = 2048  # rows that pivots are chosen from, and that give queries their first scores
BLOCK = 4096   # rows of one side that meet in one task
STEP = 64      # candidates evaluated first in the order of their bounds; each further step is twice as long
LONGEST = 3e9  # a vector's length; products of two stay below 2^63

#: All scores by brute force.
SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)
, scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) with integer components."""
    whole = F.transform("x", lambda v: F.floor(v * SCALE).cast("long"))
    return cells(vectors).select("vec_id", whole.alias("x"))


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` different rows of ``sample``, each the farthest from those before it."""
    if not len(sample):
        return sample.astype(float)
    rows, at = sample.astype(float), [0]
    gap = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(at) < n and gap.max() > 0:
        at.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[at[-1]]) ** 2).sum(axis=1))
    return rows[at]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1)[None, :] - 2.0 * (x @ pivots.T)))


def whole(rows) -> np.ndarray:
    x = np.array(rows.tolist(), dtype=np.int64)
    if len(x) and np.sqrt((x.astype(float) ** 2).sum(axis=1)).max() > LONGEST:
        raise OverflowError("integer scores of vectors this long may pass 64 bits")
    return x


def first_scores(ids, x: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> list:
    """Per query a score that k candidates of the sample reach, or None where there are fewer."""
    told = []
    for query, row in zip(ids, x):
        scores = sample[sample_ids != query] @ row if len(sample) else sample
        told.append(int(np.partition(scores, -k)[-k]) if len(scores) >= k else None)
    return told


def searched(queries: pd.DataFrame, candidates: pd.DataFrame, pivots: np.ndarray, k: int, told=None) -> pd.DataFrame:
    """The k best candidates of each query by bounds and exact scores; both sides have vectors of one length.

    ``queries`` may carry ``known``, a score that k candidates reach somewhere. ``told`` collects how many candidates of
    each query were evaluated.
    """
    exact_q, c = whole(queries["x"]), whole(candidates["x"])
    q, near = exact_q.astype(float), c.astype(float)
    ids, found = candidates["vec_id"].to_numpy(), []
    known = queries["known"].tolist() if "known" in queries else [None] * len(q)
    to_q, to_c = distances(q, pivots), distances(near, pivots)
    square_q, square_c = (q * q).sum(axis=1), (near * near).sum(axis=1)
    # what fewer than half of the dimensions' pivots span, so that a projection is cheaper than a score
    span = np.linalg.qr(pivots[:q.shape[1] // 2].T)[0]
    flat_q, flat_c = q @ span, near @ span
    left_q, left_c = (np.sqrt(np.maximum(0.0, square - (flat * flat).sum(axis=1)))
                      for square, flat in ((square_q, flat_q), (square_c, flat_c)))
    # rounding must not make a bound too strong
    loose = 1e-6 * (1.0 + to_c.max(initial=0.0) + to_q.max(initial=0.0))
    slack = 1e-6 * (1.0 + square_q.max(initial=0.0) + square_c.max(initial=0.0))
    for row, query in enumerate(queries["vec_id"].tolist()):
        floor = -np.inf if known[row] is None or known[row] != known[row] else known[row] - 0.5
        bound = flat_c @ flat_q[row] + left_c * left_q[row] + slack
        at = np.flatnonzero((bound >= floor) & (ids != query))
        if len(pivots):
            low = np.maximum(0.0, np.abs(to_c[at] - to_q[row]).max(axis=1) - loose)
            bound[at] = np.minimum(bound[at], (square_q[row] + square_c[at] - low * low) / 2 + slack)
            at = at[bound[at] >= floor]
        at = at[np.argsort(-bound[at], kind="stable")]
        best_scores, best_ids, done, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, STEP
        while done < len(at):
            # a tie with the k-th best may still bring a smaller id, so only smaller bounds stop
            if len(best_scores) == k:
                floor = max(floor, best_scores[-1] - 0.5)
            part = at[done:done + step]
            part = part[bound[part] >= floor]
            if not len(part):
                break
            best_scores = np.concatenate([best_scores, c[part] @ exact_q[row]])
            best_ids = np.concatenate([best_ids, ids[part]])
            first = np.lexsort((best_ids, -best_scores))[:k]
            best_scores, best_ids, done, step = best_scores[first], best_ids[first], done + len(part), step * 2
            if len(part) < min(step // 2, len(at) - done + len(part)):
                break
        if told is not None:
            told.append(done)
        found += [(query, i, s) for s, i in zip(best_scores.tolist(), best_ids.tolist())]
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")


def top_k(vectors: DataFrame, is_query: Column, k=K, n_pivots=PIVOTS, block=BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query row."""
    rows = cut_lineage(quantised(vectors).withColumn("n", F.size("x")).withColumn("asks", is_query))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # a fixed number of rows
    samples = {}
    for row in chosen:
        samples.setdefault(row.n, []).append((row.vec_id, row.x))
    samples = {n: (np.array([i for i, _ in part]), np.array([x for _, x in part], dtype=np.int64))
               for n, part in samples.items()}
    pivots = {n: farthest_first(x, n_pivots) for n, (_, x) in samples.items()}

    def start(batches):
        for batch in batches:
            known = pd.Series([None] * len(batch), dtype="Int64", index=batch.index)
            for width, part in batch.groupby("n"):
                if width in samples:
                    known[part.index] = first_scores(part["vec_id"].tolist(), whole(part["x"]), *samples[width], k)
            yield batch.assign(known=known)

    asked = rows.filter("asks").select("n", "vec_id", "x").mapInPandas(start, "n int, vec_id long, x array<bigint>, known long")
    total, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    n_q, n_c = max(1, -(-asking // block)), max(1, -(-total // block))
    spread = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    left = asked.select(
        "n", "vec_id", "x", "known", F.lit(True).alias("asks"), spread(n_q, 1).alias("i"),
        F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("j"))
    right = rows.select(
        "n", "vec_id", "x", F.lit(None).cast("long").alias("known"), F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("i"),
        spread(n_c, 2).alias("j"))

    def meet(both: pd.DataFrame) -> pd.DataFrame:
        width = int(both["n"].iloc[0])
        left, right = both[both["asks"]], both[~both["asks"]]
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return searched(left, right, pivots.get(width, np.zeros((0, width))), k)
    local = left.unionByName(right).groupBy("n", "i", "j").applyInPandas(meet, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
