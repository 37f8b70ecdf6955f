"""Personal data by candidates and gradient boosting.

Base spans come from four fixed patterns and always stay. Beside them, generators with a high recall propose spans that
may overlap: addresses with an at sign or a word for it, and every way to cut a run of numbers at its separators that
has the digits of a phone number, a card or a network address. Boosted trees score each proposal by its format and its
context, their scores are calibrated, and a threshold per kind selects what is added. Where selected spans overlap, the
better score stays; a span that touches a base span is never added.

The trees learn from every text of the corpus. A base span is an example of its kind; so are its other ways of writing
(without a plus sign, in other groups, with words for signs, beside another number). Base spans whose check digits or
lengths are spoilt, and proposals that are no base spans, are counterexamples. Equal examples are counted and written;
each level of a tree is one job that sums slopes by node, column and bin over all of them, so only sums of a fixed number
reach the driver. Up to ``FEW`` different examples are summed on the driver instead; the sums are of whole numbers and so
the same. One text in three, by hash, is held out: all its examples calibrate the scores and give each kind the
lowest threshold at which ``PRECISION`` is reached; a kind without such a threshold adds nothing.

Null and empty cases: a null text is empty and has no spans; rows may repeat, and each is reported; an empty table, or a
corpus without base spans, gives no model and base spans only. Other columns play no part. All patterns are linear in
the text; offsets are code points.
"""

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corrobora.llm.boosting import BINS, BoostedTrees
from corrobora.llm.logistic import fit, sigmoid
from corrobora.llm.tables import in_batches, packed, whole_text
from corrobora.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
PRECISION = 0.98   # on held-out proposals, of what is added
NEAR = 40          # characters of context
TOP = 255          # features are whole numbers, counted up to this one
FEW = 50_000       # different examples, 2 MB, that are summed without a job for each level
GRID = 256         # steps of a score (log odds) that are told apart, in one unit

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
DIGITS = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# generators
AT = re.compile(r"@|[(\[{] ?at ?[)\]}]| at ", re.I)
SPELT = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[{] ?dot ?[)\]}]| dot ) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)
BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?\Z")
NUMBERS = re.compile(r"[0-9][0-9 ().-]{4,}[0-9]")
GROUP = re.compile(r"[0-9]+")
#: Words that announce personal data, by kind.
CUES = (("email", "mail", "e-mail", "contact", "write"), ("ip", "host", "server", "address", "addr"),
        ("card", "visa", "credit", "account", "iban"), ("phone", "tel", "call", "mobile", "fax", "whatsapp"))
SPANS = "array<struct<start:int,rank:int,end:int,base:boolean,score:double>>"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) by start, then kind."""
    out = []
    if "@" in text:
        at, done = text.find("@"), 0
        while at >= 0:
            start = at
            while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
                start -= 1
            domain = DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                out.append((start, EMAIL, domain.end()))
                done = domain.end()
            at = text.find("@", max(done, at + 1))
    if GROUP.search(text):
        if "." in text:
            out += [(m.start(), IP, m.end()) for m in DOTTED.finditer(text) if all(map(small, m[0].split(".")))]
        for m in DIGITS.finditer(text):
            if m.end() - m.start() > 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), CARD, m.end()))
        if "+" in text:
            out += [(m.start(), PHONE, m.end()) for m in PLUS.finditer(text)
                    if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) of everything that may be personal data."""
    out = []
    for m in AT.finditer(text):
        left = BEFORE_AT.search(text[max(0, m.start() - 65):m.start()])
        right = SPELT.match(text, m.end())
        if left and right and (m[0] != " at " or "dot" in right[0].lower()):
            out.append((m.start() - len(left[0]), EMAIL, right.end()))
    for run in NUMBERS.finditer(text):
        groups = [(m.start(), m.end()) for m in GROUP.finditer(text, run.start(), run.end())]
        for i, (start, end) in enumerate(groups):
            if i + 4 <= len(groups) and all(
                    groups[k][1] + 1 == groups[k + 1][0] and text[groups[k][1]] == "." for k in range(i, i + 3)):
                out.append((start, IP, groups[i + 3][1]))
            n = 0
            for a, b in groups[i:i + 8]:
                n += b - a
                if n > 19:
                    break
                if n >= 14 and luhn("".join(filter(str.isdigit, text[start:b]))):
                    out.append((start, CARD, b))
                if 9 <= n <= 15:
                    open_ = start - 1 if start and text[start - 1] == "(" else start
                    out.append((open_ - (open_ > 0 and text[open_ - 1] == "+"), PHONE, b))
    return out


def features(text: str, start: int, rank: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - NEAR):start], text[end:end + NEAR]
    groups = [len(g) for g in GROUP.findall(span)] or [0]
    parts = GROUP.findall(span)
    digits = "".join(parts)
    last, first = before[-1:], after[:1]
    words = re.findall(r"[a-z-]+", before.lower())[-3:]
    lead, trail = before.rstrip(" -(+")[-1:], after.lstrip(" -)")[:1]
    return [
        rank, len(span), len(digits), len(groups), min(groups), max(groups), groups[0], groups[-1],
        span[:1] == "+", "(" in span, span.count(" "), span.count("-"), span.count("."), len(set(digits)),
        luhn(digits), int(digits[:1] or 0), all(map(small, parts)), "@" in span, len(span.rpartition(".")[2]),
        span.lower().count("dot"), len(re.split(r"@|at", span)[0]),
        last.isalpha(), last.isdigit(), last in ("", " ", "\n"), first.isalpha(), first.isdigit(), first in ("", " ", "\n"),
        lead.isdigit(), trail.isdigit(), *[any(w in cue for w in words) for cue in CUES],
        sum(map(str.isdigit, before)), sum(map(str.isdigit, after)), last in ".,", first in ".,"]


WIDTH = len(features("a", 0, 0, 1))


def other_ways(text: str, start: int, rank: int, end: int, pick) -> list[tuple[str, int, int, int, int]]:
    """(text, start, rank, end, label) of a base span written in other ways, and of spoilt ones."""
    span, out = text[start:end], []
    before, after = text[max(0, start - NEAR):start], text[end:end + NEAR]

    def put(new, label, lead="", trail=""):
        whole = before + lead + new + trail + after
        out.append((whole, len(before) + len(lead), rank, len(before) + len(lead) + len(new), label))
    digits = "".join(GROUP.findall(span))
    if rank == EMAIL:
        local, _, domain = span.partition("@")
        put(f"{local} at {domain.replace('.', ' dot ')}", 1)
        put(f"{local}[at]{domain}", 1)
        put(f"{local} (at) {domain.replace('.', ' (dot) ')}", 1)
    elif rank == IP:
        put(span, 1, trail=":8080")
        put(".".join(str(int(p[-3:]) + 256) for p in span.split(".")), 0)
        put(span, 0, lead="7.")
    elif rank == CARD:
        put("-".join(digits[i:i + 4] for i in range(0, len(digits), 4)), 1)
        put(digits, 1, trail=" " + digits)
        put(digits, 1, lead=digits + " ")
        at = pick % len(digits)
        put(digits[:at] + str((int(digits[at]) + 1 + pick % 9) % 10) + digits[at + 1:], 0)
    else:
        put(span.lstrip("+"), 1)
        put(span.lstrip("+").replace("(", "").replace(")", "").replace(" ", "-"), 1)
        put(digits, 0)
        put(f"{digits[:4]}-{digits[4:6]}-{digits[6:8]} {digits[8:10]}", 0)
    return out


class Taken:
    """Spans that are taken; tells whether another one touches them."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touched(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int):
        at = bisect.bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def examples(text: str, seed: int) -> Iterator[tuple[list[float], int]]:
    """Features and labels of a text's base spans, their other ways of writing, and its other proposals."""
    base = base_spans(text)
    taken = Taken((a, b) for a, _, b in base)
    for start, rank, end in base:
        yield features(text, start, rank, end), 1
        for whole, a, k, b, label in other_ways(text, start, rank, end, seed):
            yield features(whole, a, k, b), label
    for start, rank, end in proposals(text):
        if not taken.touched(start, end):
            yield features(text, start, rank, end), 0


class Model:
    """Trees, calibration, and thresholds on the calibrated scores per kind.

    ``held``: of the held-out proposals, rows of kind, step of the score, label and number.
    """

    def __init__(self, trees: BoostedTrees, held: np.ndarray, precision=PRECISION):
        self.trees = trees
        kind, step, label, n = held.T
        self.line = fit(step[:, None] / GRID, label.astype(float), n.astype(float))
        self.least = np.full(len(KINDS), np.inf)
        for k in range(len(KINDS)):
            steps, at = np.unique(step[kind == k], return_inverse=True)
            every, ones = (np.bincount(at, w, len(steps))[::-1].cumsum() for w in (n[kind == k], (n * label)[kind == k]))
            own = self.calibrated(steps[::-1] / GRID)
            # a threshold is a step that is told apart, and above one half
            good = (ones >= precision * every) & (own >= 0.5)
            if good.any():
                self.least[k] = own[np.flatnonzero(good)[-1]]

    def calibrated(self, raw):
        return sigmoid(raw * self.line[0] + self.line[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(steps_of(self.trees.score(np.minimum(x, TOP))) / GRID)


def steps_of(raw: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(raw, -30, 30) * GRID).astype(np.int64)


def counted_examples(docs: DataFrame) -> DataFrame:
    """x (a byte per feature), y, held, n: all examples of all texts with a digit or an at sign, equal ones counted."""
    rows = docs.select(whole_text().alias("text")).filter(F.col("text").rlike("[0-9@]"))
    rows = rows.withColumn("hash", F.xxhash64("text"))

    def work(batch):
        met = Counter()
        for text, h in zip(batch.column("text").to_pylist(), batch.column("hash").to_pylist()):
            met.update((bytes(min(int(v), TOP) for v in row), label, h % 3 == 0) for row, label in examples(text, h & 0xFFFFFFFF))
        columns = zip(*met) if met else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), kind) for c, kind in zip(columns, (pa.binary(), pa.int32(), pa.bool_()))]
            + [pa.array(list(met.values()), pa.int64())], ["x", "y", "held", "n"])
    told = in_batches(rows, work, "x binary, y int, held boolean, n long", texts="text")
    return told.groupBy("x", "y", "held").agg(F.sum("n").alias("n"))


def by_feature(xs) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(xs), np.uint8).reshape(-1, WIDTH).T)


def added_up(rows: DataFrame, work) -> np.ndarray:
    """Rows of cell and sum: ``work(x, y, n)`` gives an array of whole numbers for a batch of examples (x by feature, then
    example); the arrays of all batches are added up, cell by cell."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(by_feature(batch.column("x").to_pylist()), batch.column("y").to_numpy(), batch.column("n").to_numpy())
                total = part if total is None else total + part
        if total is not None:
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total.ravel()[cells], pa.int64())], ["cell", "n"])
    sums = rows.select("x", "y", "n").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return np.array([(r["cell"], r["n"]) for r in sums], dtype=np.int64).reshape(-1, 2)


def trained(docs: DataFrame, precision=PRECISION, few=FEW) -> Model | None:
    """The model of a corpus, or none if it has no examples of both labels to learn and to calibrate from."""
    told = cut_lineage(counted_examples(docs))
    groups = told.groupBy("held", "y").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")).collect()
    sizes = {(r["held"], r["y"]): r["n"] for r in groups}
    if len(sizes) < 4:
        return None
    learned, held = told.filter(~F.col("held")), told.filter("held")

    def whole(rows, size, work):
        out = np.zeros(size, dtype=np.int64)
        found = added_up(rows, work)
        out[found[:, 0]] = found[:, 1]
        return out
    values = whole(learned, WIDTH * (TOP + 1), lambda x, y, n: np.stack(
        [np.bincount(c, n, TOP + 1) for c in x]).astype(np.int64))
    trees = BoostedTrees()
    trees.edges_from(values.reshape(WIDTH, TOP + 1))
    if sum(r["different"] for r in groups if not r["held"]) <= few:
        rows = learned.select("x", "y", "n").collect()
        columns, y, n = trees.binned(by_feature(r["x"] for r in rows).T), *np.array([(r["y"], r["n"]) for r in rows]).T

        def sums():
            return trees.sums(columns, y, n)
    else:
        def sums():
            return whole(learned, 2 * 2 ** trees.level * WIDTH * BINS, lambda x, y, n: trees.sums(trees.binned(x.T), y, n))
    trees.grow(sizes[False, 0] + sizes[False, 1], sizes[False, 1], sums)

    span = 2 * 30 * GRID + 1

    def graded(x, y, n):
        cell = (x[0].astype(np.int64) * span + steps_of(trees.score(x.T)) + 30 * GRID) * 2 + y
        return np.bincount(cell, n, len(KINDS) * span * 2).astype(np.int64)
    found = added_up(held, graded)
    cell, n = found[np.argsort(found[:, 0])].T
    return Model(trees, np.stack([cell // (2 * span), cell // 2 % span - 30 * GRID, cell % 2, n], axis=1), precision)


def added(text: str, base, model: Model) -> list[tuple[int, int, int, float]]:
    """(start, rank, end, score) of the selected proposals: none touches a base span or another one."""
    taken = Taken((a, b) for a, _, b in base)
    open_ = [p for p in dict.fromkeys(proposals(text)) if not taken.touched(p[0], p[2])]
    if not open_:
        return []
    scores = model.score(np.array([features(text, *p) for p in open_], dtype=float))
    out = []
    for score, start, rank, end in sorted(
            ((-s, *p) for s, p in zip(scores.tolist(), open_) if s >= model.least[p[1]])):
        if not taken.touched(start, end):
            taken.add(start, end)
            out.append((start, rank, end, -score))
    return out


def personal_spans(docs: DataFrame, model: Model | None, keep: Column | None = None) -> DataFrame:
    """One row per document: kept (``keep``, the doc_id by default) and spans, by start, then kind."""
    rows = docs.select((F.col("doc_id") if keep is None else keep).alias("kept"), whole_text().alias("_whole_text"))

    def work(batch):
        found = []
        for text in batch.column("_whole_text").to_pylist():
            base = base_spans(text)
            more = added(text, base, model) if model is not None else []
            spans = sorted([(a, k, b, True, 1.0) for a, k, b in base] + [(a, k, b, False, s) for a, k, b, s in more])
            found.append([dict(zip(("start", "rank", "end", "base", "score"), s)) for s in spans])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()),
                                   ("base", pa.bool_()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(found, kind)], ["kept", "spans"])
    return in_batches(rows, work, f"kept {rows.schema['kept'].dataType.simpleString()}, spans {SPANS}", texts="_whole_text")


def listed(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and offsets per document from ``personal_spans``."""
    base = F.filter("spans", lambda x: x["base"])

    def of_kind(k):
        return F.size(F.filter(base, lambda x: x["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [of_kind(k) for k in range(len(KINDS))]
    return found.select(F.col("kept").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added"))


def redacted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents with every span replaced by its kind in capitals, overlapping ones by the first one's."""
    found = personal_spans(docs, model, packed(docs))
    text, kinds = F.col("kept.text"), F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def paint(state, x):
        fresh = x["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(fresh, F.concat(
            state["out"], F.array(text.substr(state["at"] + 1, x["start"] - state["at"]),
                                  F.element_at(kinds, x["rank"] + 1)))).otherwise(state["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("spans", start, paint, lambda s: F.concat(
        F.array_join(s["out"], ""), text.substr(s["at"] + 1, F.length(text))))
    fresh = F.when(F.size("spans") > 0, clean).otherwise(text)
    return found.select(*[fresh.alias(c) if c == "text" else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
