"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is turned by a seeded random rotation once, and what the method needs of it is stored: the signs of its
components as a packed code, the correction factor (the inner product of the turned vector with its code), and the
turned vector itself in four bits a component for the other role of a pair. The inner product of one vector's code with
the other's rounded vector, divided by the factor, is an unbiased estimate of the cosine; factor and rounding step give
the width of its error. A pair whose estimate plus its bound lies below the threshold is settled. All others are
recomputed exactly, in double precision, and only exact cosines make links.

Candidates share a table's bits; these come from rotations of their own, so meeting tells nothing about the stored
code. Bits per table grow with the logarithm of the number of vectors, so that unlike vectors seldom meet, and the
number of tables follows from the bits such that a pair at the threshold is missed with a probability of ``MISS``.
A first pass over the buckets ships stored codes only and names the vectors that have an open pair in a bucket; the
second one fetches vectors for these alone. A pair that meets in several tables counts in the first one. Small buckets
are put together into tasks of even size; a large bucket is dealt to pairs of blocks. A task returns one row per vector
with links: how many, and the smallest vector it joins, so no pairs leave it.

Identical vectors are one vertex with a multiplicity. Null and empty cases: a vector that is null, empty, zero, or holds
null or non-finite components links with nothing; vectors of different length never link; rows that repeat an id are
vectors of their own; a row without an id links like any other, and its component is named by the ids in it, if there
are any; an empty table gives an empty result.
"""

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrobora.llm.graph import components
from corrobora.llm.tables import in_batches
from corrobora.llm.vectors import usable
from corrobora.session import cut_lineage

THRESHOLD = 0.95
MISS = 1e-4
WIDTHS = 4.0      # of the error, that an estimate may fall short of the threshold
BLOCK = 1024      # vectors of one side that meet in one task
TOGETHER = 2048   # vectors of small buckets in one task
LEVELS = 15       # steps between the smallest and the largest component of a rounded vector
PAIRS = 1 << 15   # pairs whose vectors are held side by side at once
SEED = 20240917

#: All pairs by brute force, for small tables; ids are unique there.
SQL = f"""
WITH RECURSIVE fit AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, len(embedding) AS width FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0)
, link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND a.width = b.width
  WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD})
, reach AS (
  SELECT vec_id AS root, vec_id AS node FROM fit UNION SELECT r.root, l.b FROM reach r JOIN link l ON l.a = r.node)
, part AS (SELECT root, min(node) AS component_id FROM reach GROUP BY root)
, counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN part ON root = vec_id LEFT JOIN counted ON a = vec_id
"""


def shape(n: int, threshold=THRESHOLD, miss=MISS) -> tuple[int, int]:
    """(bits per table, tables) for n vectors."""
    same = 1 - math.acos(threshold) / math.pi
    bits = min(40, max(8, math.ceil(math.log2(max(2, n))) + 2))
    return bits, math.ceil(math.log(miss) / math.log1p(-same ** bits))


@functools.lru_cache(maxsize=4)
def rotations(width: int, needed: int) -> np.ndarray:
    """Random rotations side by side, (width, columns), with at least ``needed`` columns."""
    rng = np.random.default_rng(SEED)
    parts = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(-(-needed // width))]
    return np.hstack(parts)


def sketched(turned: np.ndarray) -> dict:
    """What is stored of turned unit vectors: packed signs, packed four-bit components, factor, and the rounding."""
    width = turned.shape[1]
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / LEVELS, 1e-12)
    parts = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    parts = np.pad(parts, ((0, 0), (0, width % 2)))
    return {"code": np.packbits(turned > 0, axis=1), "rounded": parts[:, 0::2] << 4 | parts[:, 1::2],
            "factor": np.abs(turned).sum(axis=1) / math.sqrt(width), "low": low, "step": step}


def table_keys(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Packed signs to one number per table."""
    cut = np.unpackbits(signs, axis=1, count=bits * tables).reshape(len(signs), tables, bits)
    return (cut * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(axis=2)


def byte_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), -1)


STORED = "node long, width int, code binary, rounded binary, factor float, low float, step float, signs binary"


def stored(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``nodes`` (node, width, x) to what is stored of each, with its table keys."""
    def work(batch):
        xs, widths = batch.column("x").to_pylist(), np.array(batch.column("width").to_pylist())
        parts = []
        for width in sorted(set(widths.tolist())):
            at = np.flatnonzero(widths == width)
            x = np.array([xs[i] for i in at])
            turned = (x / np.linalg.norm(x, axis=1)[:, None]) @ rotations(width, width + bits * tables)
            kept = sketched(turned[:, :width])
            signs = np.packbits(turned[:, width:width + bits * tables] > 0, axis=1)
            packed = {name: [row.tobytes() for row in rows] for name, rows in (
                ("code", kept["code"]), ("rounded", kept["rounded"]), ("signs", signs))}
            parts.append(pa.RecordBatch.from_pydict({
                "node": batch.column("node").take(pa.array(at)), "width": pa.array(widths[at], pa.int32()),
                "code": pa.array(packed["code"], pa.binary()), "rounded": pa.array(packed["rounded"], pa.binary()),
                **{name: pa.array(kept[name].astype(np.float32)) for name in ("factor", "low", "step")},
                "signs": pa.array(packed["signs"], pa.binary()),
                "keys": pa.array(table_keys(signs, bits, tables).tolist(), pa.list_(pa.int64()))}))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
    return in_batches(nodes, work, STORED + ", keys array<bigint>")


def bucket_sides(rows: pd.DataFrame):
    """(left, right) positions of every bucket of a task: the bucket twice, or its two blocks."""
    own, i_block, j_block, block = (rows[c].to_numpy() for c in ("bucket", "i", "j", "block"))
    order = np.argsort(own, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        if i_block[at[0]] == j_block[at[0]]:
            yield at, at
        else:
            yield at[block[at] == i_block[at]], at[block[at] == j_block[at]]


def open_pairs(rows: pd.DataFrame, threshold: float):
    """(a, b) positions per bucket whose estimate does not settle them, each pair once."""
    width, node = int(rows["width"].iloc[0]), rows["node"].to_numpy()
    factor, low, step = (rows[c].to_numpy().astype(np.float32)[:, None] for c in ("factor", "low", "step"))
    halves = byte_rows(rows["rounded"])
    rounded = low + step * np.stack([halves >> 4, halves & 15], axis=2).reshape(len(rows), -1)[:, :width]
    codes = (np.unpackbits(byte_rows(rows["code"]), axis=1, count=width) * np.float32(2) - 1) / (
        np.float32(math.sqrt(width)) * factor)
    factor = factor.astype(np.float64)
    spread = (1 - factor ** 2).clip(0) / max(1, width - 1)
    error = WIDTHS * np.sqrt(spread + step.max() ** 2 / 12) / factor + 1e-5
    for left, right in bucket_sides(rows):
        if not len(left) or not len(right):
            continue
        a, b = np.nonzero(codes[left] @ rounded[right].T + error[left] >= threshold)
        a, b = left[a], right[b]
        if left is right:
            once = node[a] < node[b]
            a, b = a[once], b[once]
        if len(a):
            yield a, b


def open_vectors(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The rows of one task's buckets that have an open pair there; only stored codes are read."""
    some = np.zeros(len(rows), dtype=bool)
    for a, b in open_pairs(rows, threshold):
        some[a] = some[b] = True
    return rows.loc[some, ["node", "width", "band", "bucket", "block", "slot", "i", "j"]]


def links_inside(rows: pd.DataFrame, bits: int, tables: int, threshold: float) -> pd.DataFrame:
    """(node, n, joined) of one task's buckets: links counted in their first table, and the smallest vector joined."""
    x = np.array(rows["x"].tolist())
    norm = np.linalg.norm(x, axis=1)
    keys = table_keys(byte_rows(rows["signs"]), bits, tables)
    node, copies, table = rows["node"].to_numpy(), rows["copies"].to_numpy(), int(rows["band"].iloc[0])
    count, least = np.zeros(len(x), dtype=np.int64), node.copy()
    for every_a, every_b in open_pairs(rows, threshold):
        found = []
        for at in range(0, len(every_a), PAIRS):  # a slice of the pairs at a time
            a, b = every_a[at:at + PAIRS], every_b[at:at + PAIRS]
            linked = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= threshold
            a, b = a[linked], b[linked]
            fresh = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
            found.append((a[fresh], b[fresh]))
        a, b = (np.concatenate(side) for side in zip(*found))
        np.add.at(count, a, copies[b])
        np.add.at(count, b, copies[a])
        while len(a):  # the smallest vector reachable inside the bucket
            low = np.minimum(least[a], least[b])
            if (least[a] == low).all() and (least[b] == low).all():
                break
            np.minimum.at(least, a, low)
            np.minimum.at(least, b, low)
    some = count > 0
    return pd.DataFrame({"node": node[some], "n": count[some], "joined": least[some]})


def near_vectors(vectors: DataFrame, threshold=THRESHOLD, block=BLOCK, together=TOGETHER) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``block`` vectors of one side of a large bucket meet in a task, ``together`` vectors of small buckets share one.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    fit = usable("x") & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False))
    rows = cut_lineage(rows.select("vec_id", F.when(fit, F.col("x")).alias("x")).withColumn(
        "twin", F.md5(F.col("x").cast("string"))))
    twins = rows.filter("x is not null").groupBy("twin").agg(
        F.min("vec_id").alias("least"), F.first("x").alias("x"), F.count(F.lit(1)).alias("copies"))
    nodes = cut_lineage(twins.select(F.monotonically_increasing_id().alias("node"), "*"))
    n_nodes = nodes.count()
    bits, tables = shape(n_nodes, threshold)
    ready = cut_lineage(stored(nodes.select("node", F.size("x").alias("width"), "x"), bits, tables))
    placed = ready.select("node", "width", F.posexplode("keys").alias("band", "bucket"))
    full = placed.groupBy("width", "band", "bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    slots = max(1, -(-n_nodes // together))
    large = F.col("members") > block
    blocks = F.when(large, F.ceil(F.col("members") / block)).otherwise(F.lit(1)).cast("int")
    dealt = (
        placed.join(full, ["width", "band", "bucket"])
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("node", "width", "band", "bucket", "block", F.least("block", "other").alias("i"),
                F.greatest("block", "other").alias("j"),
                F.when(large, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("bucket"), F.lit(slots))).alias("slot"))
    )
    codes = ready.select("node", "code", "rounded", "factor", "low", "step")
    task = ["width", "band", "slot", "i", "j"]
    undecided = cut_lineage(dealt.join(codes, "node").groupBy(*task).applyInPandas(
        lambda part: open_vectors(part, threshold),
        "node long, width int, band int, bucket long, block int, slot long, i int, j int"))
    fetched = undecided.join(ready.drop("width", "keys"), "node").join(nodes.select("node", "x", "copies"), "node")
    found = cut_lineage(fetched.groupBy(*task).applyInPandas(
        lambda part: links_inside(part, bits, tables, threshold), "node long, n long, joined long"))
    labels = components(found.select(F.col("node").alias("a"), F.col("joined").alias("b")))
    told = cut_lineage(
        nodes.select("twin", "node", "least", "copies")
        .join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left")
        .join(labels, "node", "left")
        .select("twin", "least", F.coalesce("component", "node").alias("component"),
                (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    )
    names = told.groupBy("component").agg(F.min("least").alias("name"))
    told = told.drop("least").join(names, "component")
    return rows.join(told, "twin", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).alias("n_links"),
        F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("name")).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
