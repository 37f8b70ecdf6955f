"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into overlapping windows
of bytes; a window that the toxic dictionary compresses better than the ordinary one speaks for toxicity. The length
differences of a text's windows are summed up in a few numbers, and a logistic model turns these into a calibrated score.

What the toxic dictionary is trained on: pieces of labelled toxic texts, of any length and script. Whole toxic texts are
mostly ordinary, so their pieces are narrowed to the parts that speak for the label: every run of ``GRAMS`` bytes is
counted in toxic and in ordinary pieces, and the parts covered by runs that are far too frequent in toxic pieces to be
chance are the samples. A run counts once per surroundings (``AROUND`` bytes on both sides) and piece, so copies of one
labelled text don't count as many texts. Without such parts the samples are the whole pieces. Both dictionaries get the
same ordinary part behind their own, so they differ in what is special only.

Labels are learnt from rows whose crc32 of the id modulo 5 is not 0, at most ``MOST_LABELLED`` of each class (smallest
hashes of the id); scores are for all documents, whole texts.

Null and empty cases: a null text counts as empty and has one empty window; a null id counts as empty text for the
remainder; repeated ids in ``labels`` count once with each label, repeated ids of
documents once per text, with a few texts at most; without learnable texts of both classes there
is no model: every score is the share of toxic labels (0 without any), and ``without_toxic`` keeps all documents; an
empty table gives an empty result. Only doc_id and text are read; columns may have any other names.
"""

import collections
import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from corrobora.llm.logistic import fit, sigmoid, spread_of
from corrobora.llm.tables import in_batches, labelled_rows, packed, unpacked, whole_text
from corrobora.session import cut_lineage

MOST_LABELLED = 4000     # texts of each class that the fit may use
MOST_PIECES = 8192       # of each class that telling parts are looked for in
PIECE = 256              # bytes
GRAMS = (4, 6, 8, 12)    # bytes of the runs that are counted
AROUND = 16              # bytes before and after a run that tell its occurrences apart
LEAST_RATIO = 8.0        # of its rates in toxic and ordinary pieces
EVIDENCE = 1.5           # log-likelihood that it needs, in logarithms of the number of distinct runs
MOST_TIMES = 60          # that one telling part is a sample
MOST_WINDOWS = 20_000    # ordinary windows that the ordinary dictionary is trained on
WINDOW, STRIDE = 64, 40  # bytes
TOXIC_BYTES, SHARED_BYTES = 2048, 16_384
LEVEL = 9
PAD = b"\n" * 10         # zstandard looks for no matches in the last bytes of a block
FEATURES = 8


def held_out(doc_id="doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def windows_of(text: str) -> list[bytes]:
    data = text.lower().encode()
    return [data[i:i + WINDOW] + PAD for i in range(0, max(1, len(data) - (WINDOW - STRIDE)), STRIDE)]


@functools.lru_cache(maxsize=4)
def compressor(content: bytes):
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False,
                                    write_dict_id=False)


def features(text: str, toxic: bytes, ordinary: bytes) -> list[float]:
    """What the differences in compressed length say: extremes, shares beyond some bytes, mean, number of windows."""
    short, long = compressor(toxic).compress, compressor(ordinary).compress
    gain = np.array([len(long(w)) - len(short(w)) for w in windows_of(text)], dtype=np.float64)
    top = np.sort(gain)[-3:]
    return [top[-1], top.mean(), *[(gain >= k).mean() for k in (2, 3, 4, 5)], gain.mean(), math.log(len(gain))]


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; too few to train on are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def labelled_sample(docs: DataFrame, labels: DataFrame, most=MOST_LABELLED) -> DataFrame:
    """(toxic, text), written, of at most ``most`` learnable rows of each class; the ids go out to all tasks, so they are bounded."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    by_hash = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = known.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= most)
    few = cut_lineage(few.select("doc_id", "toxic"))
    rows = docs.select("doc_id", whole_text().alias("text"))
    return labelled_rows(rows, few, "toxic", F.col("text"), most).select("toxic", "text")


def pieces_of(text: str) -> list[bytes]:
    """The text in pieces of ``PIECE`` bytes, each with what surrounds it; beyond the text's ends are line ends."""
    tail = AROUND + max(GRAMS)
    data = b"\n" * AROUND + text.lower().encode() + b"\n" * tail
    return [data[i:i + AROUND + PIECE + tail] for i in range(0, max(1, len(data) - AROUND - tail), PIECE)]


def pieces(sample: DataFrame, toxic: int, most=MOST_PIECES) -> list[bytes]:
    """At most ``most`` distinct pieces of one class, by hash."""
    def work(batch):
        told = [p for t in batch.column("text").to_pylist() for p in pieces_of(t)]
        return pa.RecordBatch.from_arrays([pa.array(told, pa.binary())], ["piece"])
    cut = in_batches(sample.filter(F.col("toxic") == toxic).select("text"), work, "piece binary")
    few = cut_lineage(cut.distinct().orderBy(F.xxhash64("piece"), "piece").limit(most))
    return sorted(bytes(r.piece) for r in few.collect())


def hashed(data: np.ndarray, n: int, block=1 << 18) -> np.ndarray:
    """A hash of the n bytes from each place, in blocks that keep what numpy holds between steps small."""
    told = np.zeros(len(data) - n + 1, dtype=np.uint64)
    for at in range(0, len(told), block):
        part = told[at:at + block]
        for k in range(n):
            part *= np.uint64(0x9E3779B97F4A7C15)
            part += data[at + k:at + k + len(part)]
            part ^= part >> np.uint64(29)
    return told


class Runs:
    """The pieces of a class laid out, and how often each run of n bytes comes in different surroundings."""

    def __init__(self, cut: list[bytes]):
        self.data = np.frombuffer(b"".join(cut), dtype=np.uint8)
        around = hashed(self.data, 2 * AROUND + max(GRAMS))
        first, piece, start = [], [], 0
        for k, p in enumerate(cut):
            first.append(np.arange(start + AROUND, start + len(p) - AROUND - max(GRAMS), dtype=np.int32))
            piece.append(np.full(len(first[-1]), k, dtype=np.int32))
            start += len(p)
        self.start, self.piece = np.concatenate(first), np.concatenate(piece)
        self.once = np.zeros(len(self.start), dtype=bool)
        around = around[self.start - AROUND]
        for part in parts_of(around):
            self.once[part[np.unique(around[part], return_index=True)[1]]] = True

    def runs(self, n: int) -> np.ndarray:
        return hashed(self.data, n)[self.start]

    def counted(self, runs: np.ndarray, part: np.ndarray):
        """(distinct runs, counts) of a part of the places."""
        part = part[self.once[part]]
        order = part[np.lexsort((self.piece[part], runs[part]))]
        kind, piece = runs[order], self.piece[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (kind[1:] != kind[:-1]) | (piece[1:] != piece[:-1])
        return np.unique(kind[fresh], return_counts=True)


def parts_of(hashes: np.ndarray, bits=3):
    """The places dealt by the first bits of their hash."""
    top = (hashes >> np.uint64(64 - bits)).astype(np.uint8)
    for k in range(1 << bits):
        yield np.flatnonzero(top == k)


def telling_parts(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The parts of toxic pieces that ordinary ones lack, with a byte on both sides; the most frequent first."""
    bad, good = Runs(toxic), Runs(ordinary)
    covered = np.zeros(len(bad.data) + 1, dtype=np.int8)
    for n in GRAMS:
        runs, other_runs = bad.runs(n), good.runs(n)
        found, n_kinds, n_times, n_others = [], 0, 0, 0
        for part, other_part in zip(parts_of(runs), parts_of(other_runs)):
            kinds, times = bad.counted(runs, part)
            others, other_times = good.counted(other_runs, other_part)
            n_kinds, n_times, n_others = n_kinds + len(kinds), n_times + times.sum(), n_others + other_times.sum()
            kinds, times = kinds[times > 1], times[times > 1]  # once is never evidence
            at = np.searchsorted(others, kinds).clip(0, max(0, len(others) - 1))
            there = np.where(others[at] == kinds, other_times[at], 0) if len(others) else np.zeros(len(kinds), dtype=int)
            found.append((kinds, times, there))
        if not n_kinds or not n_others:
            continue
        kinds, times, there = (np.concatenate(x) for x in zip(*found))
        chance = (there + 1) * (n_times / n_others)
        evidence = times * np.log(times / chance) - (times - chance)
        kept = np.sort(kinds[(times >= LEAST_RATIO * chance) & (evidence >= EVIDENCE * math.log(n_kinds))])
        if len(kept):
            hits = bad.start[kept[np.searchsorted(kept, runs).clip(0, len(kept) - 1)] == runs]
            for k in range(n):
                covered[hits + k] = 1
    edges = np.diff(covered, prepend=0)
    parts = collections.Counter(bad.data[max(0, i - 1):j + 1].tobytes() for i, j in zip(
        np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
    return [p for p, n in sorted(parts.items(), key=lambda x: (-x[1], x[0])) for _ in range(min(n, MOST_TIMES))]


def train(docs: DataFrame, labels: DataFrame, most=MOST_LABELLED) -> dict:
    """The model: both dictionaries and the coefficients. Everything it collects is bounded by the constants above."""
    counts = dict(labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("toxic").count().collect())
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    model = {"share": share, "beta": None}
    if not 0 < share < 1:
        return model
    sample = labelled_sample(docs, labels, most)
    bad, good = pieces(sample, 1), pieces(sample, 0)
    if not bad or not good:
        return model
    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / WINDOW).cast("int")),
                       lambda i: F.lower(F.substring(F.col("text"), i * WINDOW + 1, F.lit(WINDOW))))
    ordinary = [r[0].encode() for r in sample.filter("toxic = 0")
                .select(F.explode(cuts).alias("w")).orderBy(F.xxhash64("w"), "w").limit(MOST_WINDOWS).collect()]
    special = trained(telling_parts(bad, good) or bad, TOXIC_BYTES)
    shared = trained(ordinary, SHARED_BYTES)
    filler = shared[:len(special)].ljust(len(special), b"\n")  # as long as what the other has in this place
    model |= {"toxic": special + shared, "ordinary": filler + shared}
    told = featured(sample, model, ["toxic"]).collect()
    x = np.array([[getattr(r, f"f{i}") for i in range(FEATURES)] for r in told])
    y = np.array([r.toxic for r in told], dtype=float)
    if len({*y.tolist()}) < 2:
        return model
    # the sample has as many toxic texts as ordinary ones, if there are; the corpus has not
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    mean, deviation = spread_of(x)
    return model | {"mean": mean, "deviation": deviation, "beta": fit((x - mean) / deviation, y, weight)}


def featured(rows: DataFrame, model: dict, keep: list[str], text="text") -> DataFrame:
    names = [f"f{i}" for i in range(FEATURES)]

    def work(batch):
        told = np.array([features(t, model["toxic"], model["ordinary"]) for t in batch.column(text).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column(c) for c in keep] + [pa.array(told[:, i]) for i in range(FEATURES)], [*keep, *names])
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return in_batches(rows.select(*keep, text), work, schema + "".join(f", {n} double" for n in names))


def scored(rows: DataFrame, model: dict, text: str) -> DataFrame:
    """``rows`` with a column score. ``text`` is a column or the field of a struct; a null text counts as empty."""
    if model["beta"] is None:
        return rows.withColumn("score", F.lit(float(model["share"])))

    def work(batch):
        column, *fields = text.split(".")
        texts = pa.compute.struct_field(batch.column(column), fields) if fields else batch.column(column)
        x = np.array([features(t or "", model["toxic"], model["ordinary"]) for t in texts.to_pylist()])
        score = sigmoid(((x - model["mean"]) / model["deviation"]) @ model["beta"][:-1] + model["beta"][-1])
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(score)], [*batch.schema.names, "score"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return in_batches(rows, work, f"{schema}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, most=MOST_LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, most)
    rows = docs.select("doc_id", whole_text().alias("text"))
    return scored(rows, model, "text").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, most=MOST_LABELLED) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns only; all of them if there is no model."""
    model = train(docs, labels, most)
    if model["beta"] is None:
        return docs
    return unpacked(scored(docs.select(packed(docs).alias("doc")), model, "doc.text").filter(F.col("score") < 0.5))
