"""Quality by co-training: two classifiers on separate views teach each other.

The *content* view is the hashed distribution of a text's neighbouring bytes. The *metadata* view is what a page says
about itself and its layout: language, source, recorded length, lines and their lengths, repeated lines and words,
shares of capitals, digits and marks. Both views are computed once for all documents and kept in compact form.

Each classifier starts from the labelled rows of its view. In every round both score all documents without a label,
and each hands the rows it is surest of, with the label it gives them, to the other, which is fitted again with them.
In the end both views are calibrated on labelled rows that no fit has seen, and a logistic model joins them.

Labels come from rows whose crc32 of the id modulo 5 is not 0, at most ``MOST_LABELLED`` of them (smallest hashes of
the id); a round hands over at most ``HANDED`` rows of each class and view, the surest of all documents. These bounds
concern the fit only; scores are for all documents, whole texts.

Null and empty cases: null text, lang and source count as empty, a null length as 0; a null id has no label; without
labels of both classes every score is the share of label 1 (0.5 without any); an empty table gives an empty result.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrobora.llm.logistic import fit, logit, sigmoid, spread_of
from corrobora.llm.tables import in_batches, labelled_rows, whole_text
from corrobora.llm.toxicity import held_out
from corrobora.session import cut_lineage

MOST_LABELLED = 20_000
HANDED = 1000
ROUNDS = 3
SURE = 0.95      # a row is handed over only beyond this probability
CONTENT = 256    # bins of the content view
HASHED = 16      # bins each of language and source
LAYOUT = 12
METADATA = LAYOUT + 2 * HASHED


def content_view(data: bytes) -> bytes:
    """Square roots of the shares of neighbouring byte pairs in hashed bins, one byte each."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(x) < 2:
        return bytes(CONTENT)
    bins = ((x[:-1] * 256 + x[1:]) * np.uint32(2654435761)) >> np.uint32(24)
    share = np.bincount(bins, minlength=CONTENT) / (len(x) - 1)
    return np.round(np.sqrt(share) * 255).astype(np.uint8).tobytes()


def layout(text: str, data: bytes, n_chars: int) -> list[float]:
    x = np.frombuffer(data, dtype=np.uint8)
    n = max(1, len(x))
    kinds = np.bincount(x, minlength=256)
    lines, words = text.split("\n"), text.split()
    upper, lower, digit = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    marks = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    return [
        math.log1p(max(0, n_chars)), math.log1p(len(text)), math.log1p(len(lines)), math.log1p(len(text) / len(lines)),
        1 - len(set(lines)) / len(lines), 1 - len(set(words)) / max(1, len(words)),
        len(text) / max(1, len(words)), upper / n, lower / n, digit / n, marks / n, kinds[128:].sum() / n]


def views(docs: DataFrame) -> DataFrame:
    """(doc_id, content, metadata), both binary, written once; everything later reads these and no text."""
    rows = docs.select("doc_id", whole_text().alias("text"), whole_text("lang").alias("lang"),
                       whole_text("source").alias("source"), F.coalesce(F.col("n_chars").cast("long"), F.lit(0)).alias("n"))

    def work(batch):
        content, metadata = [], []
        for text, lang, source, n in zip(*[batch.column(c).to_pylist() for c in ("text", "lang", "source", "n")]):
            data = text.encode()
            content.append(content_view(data))
            own = np.zeros(METADATA, dtype=np.float32)
            own[:LAYOUT] = layout(text, data, n)
            own[LAYOUT + zlib.crc32(lang.encode()) % HASHED] = 1
            own[LAYOUT + HASHED + zlib.crc32(source.encode()) % HASHED] = 1
            metadata.append(own.tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(content, pa.binary()), pa.array(metadata, pa.binary())],
            ["doc_id", "content", "metadata"])
    key = rows.schema["doc_id"].dataType.simpleString()
    return cut_lineage(in_batches(rows, work, f"doc_id {key}, content binary, metadata binary"))


def matrix(view: str, cells) -> np.ndarray:
    kind = np.uint8 if view == "content" else np.float32
    width = CONTENT if view == "content" else METADATA
    return np.frombuffer(b"".join(cells), dtype=kind).reshape(len(cells), width).astype(np.float64)


class View:
    """One classifier: standardised columns, logistic, and its calibration."""

    def __init__(self, view: str, cells, y):
        x = matrix(view, cells)
        self.view, (self.mean, self.deviation) = view, spread_of(x)
        self.beta = fit((x - self.mean) / self.deviation, np.asarray(y, dtype=float), ridge=10.0)
        self.slope, self.shift = 1.0, 0.0

    def raw(self, cells) -> np.ndarray:
        x = np.clip((matrix(self.view, cells) - self.mean) / self.deviation, -20, 20)
        return x @ self.beta[:-1] + self.beta[-1]

    def calibrate(self, cells, y):
        self.slope, self.shift = fit(self.raw(cells)[:, None], np.asarray(y, dtype=float), ridge=0.1)

    def score(self, cells) -> np.ndarray:
        return sigmoid(self.raw(cells) * self.slope + self.shift)


def scored_views(rows: DataFrame, content: View, metadata: View, keep=("doc_id",)) -> DataFrame:
    """``keep`` columns and the scores of both views."""
    def work(batch):
        return pa.RecordBatch.from_arrays(
            [batch.column(c) for c in keep] + [pa.array(v.score(batch.column(v.view).to_pylist())) for v in (content, metadata)],
            [*keep, "content_score", "metadata_score"])
    names = list(dict.fromkeys([*keep, "content", "metadata"]))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return in_batches(rows.select(*names), work, f"{schema}, content_score double, metadata_score double")


def train(rows: DataFrame, labels: DataFrame, most=MOST_LABELLED, rounds=ROUNDS, handed=HANDED):
    """(content, metadata, joint coefficients), or the share of label 1 if there is nothing to tell apart."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
    few = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = cut_lineage(few)  # at most ``most`` rows
    told = labelled_rows(rows, ids, "quality", F.concat("content", "metadata"), most).select(
        "quality", "content", "metadata", (F.xxhash64("doc_id") % 4 == 0).alias("checks")).collect()
    fitted, checks = [r for r in told if not r.checks], [r for r in told if r.checks]
    if min(len({r.quality for r in part}) for part in (fitted, checks)) < 2:
        return float(np.mean([r.quality for r in told])) if told else 0.5
    own = {v: ([getattr(r, v) for r in fitted], [r.quality for r in fitted]) for v in ("content", "metadata")}
    model = {v: View(v, *own[v]) for v in own}
    open_rows = rows.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_anti")
    for _ in range(rounds):
        for v in model:
            model[v].calibrate([getattr(r, v) for r in checks], [r.quality for r in checks])
        scores = cut_lineage(scored_views(open_rows, *model.values(), keep=("doc_id", "content", "metadata")))
        taught = {}
        for teacher, pupil in (("content", "metadata"), ("metadata", "content")):
            p = F.col(f"{teacher}_score")
            sure = [scores.filter(p >= SURE).orderBy(p.desc(), F.xxhash64("doc_id")).limit(handed),
                    scores.filter(p <= 1 - SURE).orderBy(p, F.xxhash64("doc_id")).limit(handed)]
            taught[pupil] = [(getattr(r, pupil), y) for y, part in zip((1, 0), sure) for r in part.select(pupil).collect()]
        for v, rows_given in taught.items():
            cells, y = own[v]
            model[v] = View(v, cells + [c for c, _ in rows_given], y + [k for _, k in rows_given])
    for v in model:
        model[v].calibrate([getattr(r, v) for r in checks], [r.quality for r in checks])
    both = np.array([logit(model[v].score([getattr(r, v) for r in checks])) for v in ("content", "metadata")]).T
    return model["content"], model["metadata"], fit(both, np.array([r.quality for r in checks], dtype=float), ridge=1.0)


def quality(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """One row per document: doc_id, held_out, content_score, metadata_score, score, predicted (1: good)."""
    rows = views(docs)
    model = train(rows, labels, **bounds)
    if isinstance(model, float):
        flat = F.lit(model)
        told = rows.select("doc_id", flat.alias("content_score"), flat.alias("metadata_score"), flat.alias("score"))
    else:
        content, metadata, (a, b, shift) = model
        odds = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-9)) / F.greatest(1 - F.col(c), F.lit(1e-9)))
        told = scored_views(rows, content, metadata).withColumn("score", 1 / (1 + F.exp(-(
            odds("content_score") * float(a) + odds("metadata_score") * float(b) + float(shift)))))
    return told.select("doc_id", held_out().alias("held_out"), "content_score", "metadata_score", "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))
