"""Ranked lexical search, hybrid of term at a time and document at a time.

Queries come in blocks that are bounded in terms (``QUERY_TERMS``), so a block's vocabulary can be sent to all tasks.
One pass over the texts keeps each document's length and the frequencies of the block's terms, from which the corpus
statistics follow. A second pass goes through the documents in blocks of ``BLOCK``. For each query, the block's short
posting lists are summed term at a time into accumulators; these then stand beside the long lists as one more list with
an upper bound. The lists are walked document at a time in chunks of ``CHUNK`` documents, those with the best bound
first: a chunk whose lists together can't reach the k-th best score is skipped, in the others the lists that can't lift
a document over that score by themselves are only added to documents that another list brought up.

The k-th best scores of a sample of documents are known to all tasks from the start; they only save work, as every
document is still met. Each task returns its k best of each query, which are ranked again.

Scores are 64-bit integers. Null and empty cases: a null text has no terms and is no document of the statistics; items
without terms, or without a document that scores above 0, have no rows; rows may repeat, documents as well as items, and
each counts for itself; equal scores go by doc_id, nulls last; an empty table gives an empty result. Other columns play
no part.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from corrobora.llm.tables import in_batches, whole_text
from corrobora.llm.words import ByteWords
from corrobora.session import cut_lineage

K = 20
QUERY_TERMS = 200_000  # terms, with repeats, of the queries of one block
BLOCK = 1 << 15        # documents whose postings are in memory at once
CHUNK = 1 << 10
SHORT = 1 << 8         # documents of a list that is summed term at a time
SAMPLE = 64            # one document in so many gives the first thresholds
NO_ID = (1 << 63) - 1

_BYTES = np.full(256, 32, dtype=np.uint8)
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    _BYTES[ord(_first):ord(_last) + 1] = np.arange(ord(_first), ord(_last) + 1)
_BYTES[ord("A"):ord("Z") + 1] += 32
_BYTES[128:] = np.arange(128, 256)


def item_terms(items: DataFrame) -> DataFrame:
    """(q, item_id, term, n): the terms of each item; ``q`` numbers the rows of the table."""
    lowered = F.translate(whole_text(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    numbered = cut_lineage(items.select("item_id", terms.alias("terms"))).withColumn("q", F.monotonically_increasing_id())
    return cut_lineage(numbered).select("q", "item_id", F.explode("terms").alias("term")).groupBy("q", "item_id", "term").agg(
        F.count(F.lit(1)).alias("n"))


def query_blocks(terms: DataFrame, most=QUERY_TERMS):
    """Pandas tables (q, item_id, term, n), one a block of items; only numbers of terms go to the driver at once."""
    sizes = terms.groupBy("q").count()
    running = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut_lineage(terms.join(sizes.select(
        "q", F.floor((F.sum("count").over(running) - F.col("count")) / most).alias("block")), "q"))
    for (block,) in sorted(placed.select("block").distinct().collect()):
        yield placed.filter(F.col("block") == block).drop("block").toPandas()


def forward_index(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with terms; ``terms`` are places in ``vocabulary``."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), whole_text().alias("text"))
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batch):
        told, most = ByteWords(batch.column("text"), _BYTES), len(sent.value)
        n = np.bincount(told.row, minlength=batch.num_rows)
        term = pc.fill_null(pc.index_in(told.distinct, sent.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)[told.code]
        known = term >= 0
        keys, tf = np.unique(told.row[known] * most + term[known], return_counts=True)
        offsets = np.searchsorted(keys, np.arange(batch.num_rows + 1) * most).astype(np.int32)
        arrays = [batch.column("doc_id"), pa.array(n.astype(np.int64))] + [
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (keys % max(1, most), tf)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))
    return cut_lineage(in_batches(rows, work, "doc_id long, n long, terms array<int>, tfs array<int>", texts="text"))


class Searcher:
    """The k best documents of each query over blocks of documents that come one after the other."""

    def __init__(self, queries, weights, n_docs, n_terms, k=K, floors=None, chunk=CHUNK, short=SHORT):
        self.queries, self.weights, self.k, self.chunk, self.short = queries, weights, k, chunk, short
        self.n_docs, self.n_terms = n_docs, n_terms
        self.floors = np.ones(len(queries), dtype=np.int64) if floors is None else floors
        self.best = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in queries]
        self.walked = self.skipped = 0

    def add(self, doc_ids, n, sizes, terms, tfs):
        """A block: ids and lengths of its documents, and how many of ``terms`` and ``tfs`` belong to each."""
        order = np.argsort(doc_ids, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.ids, n_chunks = doc_ids[order], -(-len(order) // self.chunk)
        doc = np.repeat(rank, sizes)
        m = 75 + (25 * n * self.n_docs) // self.n_terms
        tf = tfs.astype(np.int64)
        score = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes)))
        by_list = np.argsort(terms.astype(np.int64) * len(order) + doc, kind="stable")
        term, self.doc, self.score = terms[by_list], doc[by_list], score[by_list]
        self.start = np.searchsorted(term, np.arange(len(self.weights) + 1))
        # the best score of each list in each chunk
        cell = term.astype(np.int64) * n_chunks + self.doc // self.chunk
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, dtype=np.int64)
        self.cells, self.tops = cell[first], np.maximum.reduceat(self.score, first) if len(first) else first
        self.begins, self.n_chunks = np.append(first, len(cell)), n_chunks
        for q in range(len(self.queries)):
            self.search(q)

    def search(self, q):
        terms, times = self.queries[q]
        size = self.start[terms + 1] - self.start[terms]
        some = (size > 0) & (self.weights[terms] > 0)
        terms, times, size = terms[some], times[some], size[some]
        if not len(terms):
            return
        n, few = len(self.ids), size <= self.short
        summed = np.zeros(self.n_chunks * self.chunk, dtype=np.int64)
        if few.any():  # term at a time; sums of whole numbers stay exact in doubles below 2^53
            spans = [slice(self.start[t], self.start[t + 1]) for t in terms[few]]
            summed += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate(
                [self.score[s] * w for s, w in zip(spans, times[few])]), len(summed)).astype(np.int64)
        summed = summed.reshape(self.n_chunks, self.chunk)
        long_terms, long_times = terms[~few], times[~few]
        top = np.zeros((len(long_terms), self.n_chunks), dtype=np.int64)
        begin, end = np.zeros_like(top), np.zeros_like(top)
        for i, (t, w) in enumerate(zip(long_terms, long_times)):
            a, b = np.searchsorted(self.cells, (t * self.n_chunks, (t + 1) * self.n_chunks))
            at = self.cells[a:b] - t * self.n_chunks
            top[i, at], begin[i, at], end[i, at] = self.tops[a:b] * w, self.begins[a:b], self.begins[a + 1:b + 1]
        own = summed.max(axis=1)
        bound = own + top.sum(axis=0)
        ids, scores = self.best[q]
        least = max(self.floors[q], scores[-1] if len(scores) == self.k else 0)
        for c in np.argsort(-bound, kind="stable").tolist():
            if bound[c] < least:
                self.skipped += 1
                continue
            self.walked += 1
            lists = np.argsort(top[:, c], kind="stable")
            lists = lists[top[lists, c] > 0]
            reach = np.cumsum(top[lists, c])  # of the first lists together
            split = int(np.searchsorted(reach, least, side="left"))  # they can't reach the score without another list
            total = summed[c].copy()
            for i in lists[split:]:
                s = slice(begin[i, c], end[i, c])
                total[self.doc[s] - c * self.chunk] += self.score[s] * long_times[i]
            rest = int(reach[split - 1]) if split else 0
            alive = (total > 0) & (total + rest >= least)
            for i in lists[:split][::-1]:
                if not alive.any():
                    break
                s = slice(begin[i, c], end[i, c])
                total[self.doc[s] - c * self.chunk] += self.score[s] * long_times[i]
                rest -= int(top[i, c])
                alive &= total + rest >= least
            found = np.flatnonzero(alive & (total >= least))
            if len(found):
                ids = np.append(ids, self.ids[np.minimum(c * self.chunk + found, n - 1)])
                scores = np.append(scores, total[found])
                order = np.lexsort((ids, -scores))[:self.k]
                ids, scores = ids[order], scores[order]
                if len(scores) == self.k:
                    least = max(least, scores[-1])
        self.best[q] = ids, scores

    def rows(self) -> pa.RecordBatch:
        sizes = [len(ids) for ids, _ in self.best]
        parts = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in zip(*self.best)] or [[], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64()), pa.array(parts[0], pa.int64()),
             pa.array(parts[1], pa.int64())], ["place", "doc_id", "score"])


def searched(index: DataFrame, make, block=BLOCK) -> DataFrame:
    """(place, doc_id, score) of each task's best rows; ``make()`` gives a Searcher."""
    def run(batches):
        searcher, waiting, size = make(), [], 0

        def flush():
            whole = pa.Table.from_batches(waiting).combine_chunks()
            lists = [whole.column(c).combine_chunks() for c in ("terms", "tfs")]
            searcher.add(whole.column("doc_id").to_numpy(), whole.column("n").to_numpy(),
                         pc.list_value_length(lists[0]).to_numpy(), *[x.flatten().to_numpy() for x in lists])
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if size + part.num_rows > block:
                    flush()
                    waiting, size = [], 0
                waiting.append(part)
                size += part.num_rows
        if size:
            flush()
        yield searcher.rows()
    return index.mapInArrow(run, "place long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k=K, block=BLOCK, chunk=CHUNK, short=SHORT, sample=SAMPLE,
           query_terms=QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark, parts = docs.sparkSession, []
    for asked in query_blocks(item_terms(items), query_terms):
        vocabulary = sorted(set(asked["term"]))
        place = {t: i for i, t in enumerate(vocabulary)}
        index = forward_index(docs, pa.array(vocabulary, pa.string()))
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(vocabulary), dtype=np.int64)
        held = index.select(F.explode("terms").alias("t")).groupBy("t").count().toPandas()  # at most one row a term
        df[held["t"].to_numpy(dtype=np.int64)] = held["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        names, queries = [], []
        for (q, item), part in asked.groupby(["q", "item_id"], dropna=False, sort=True):
            names.append((len(names), None if pd.isna(item) else int(item), int(q)))
            queries.append((np.array([place[t] for t in part["term"]], dtype=np.int64), part["n"].to_numpy(dtype=np.int64)))
        plain = spark.sparkContext.broadcast((queries, weights))

        def first():
            return Searcher(*plain.value, n_docs, n_terms, k, None, chunk, short)
        # of a sample's rows the k-th best score is a bar that the k best of all documents reach
        best = Window.partitionBy("place").orderBy(F.desc("score"), "doc_id")
        few = index.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(sample)) == 0)
        bars = searched(few, first, block).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
        floors = np.ones(len(queries), dtype=np.int64)
        for r in bars.collect():  # at most one row a query
            floors[r.place] = r.score
        known = spark.sparkContext.broadcast(floors)

        def second(n_docs=n_docs, n_terms=n_terms, plain=plain, known=known):
            return Searcher(*plain.value, n_docs, n_terms, k, known.value, chunk, short)
        found = cut_lineage(searched(index, second, block))
        told = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        named = spark.createDataFrame(names, "place long, item_id long, q long")
        parts.append(told.join(named, "place").select(
            "item_id", F.col("rank").cast("int").alias("rank"),
            F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sql(k=K, docs="documents", items="benchmark") -> str:
    """The same by scoring every document for every item: for comparison."""
    terms = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
    return f"""
WITH lex_docs AS (SELECT row_number() OVER () AS d, doc_id, {terms} AS t FROM {docs}),
lex_terms AS (SELECT d, unnest(t) AS term FROM lex_docs),
lex_tf AS (SELECT d, term, count(*) AS tf FROM lex_terms GROUP BY ALL),
lex_all AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM lex_docs),
lex_weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM lex_tf, lex_all GROUP BY term, n_docs),
lex_items AS (
  SELECT i, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS i, item_id, unnest({terms}) AS term FROM {items}) GROUP BY ALL),
lex_scores AS (
  SELECT i, item_id, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(t) * n_docs) // n_terms))))::BIGINT AS score
  FROM lex_items JOIN lex_tf USING (term) JOIN lex_weights USING (term) JOIN lex_docs USING (d), lex_all
  GROUP BY i, item_id, d, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM lex_scores WHERE score > 0 QUALIFY rank <= {k}"""
