"""Collocations from count streams in prefix and in suffix order.

Counting goes up by length: a phrase can only be frequent if its words, and the pairs in it, are. So single words are
counted first, then pairs of frequent words, then triples of frequent pairs. What is frequent is passed on as a bitmap
of hashes with a fixed size (``BITS``); a collision lets a rare phrase be counted, nothing else. Texts are counted in
Arrow slices, summed per task, and summed again by phrase.

The frequent words, pairs and triples then form one stream of counts, kept in two orders. In suffix order a word stands
before the pairs that end with it, and a pair before the triples that end with it; one pass over the ordered stream
hands each phrase the counts of its endings. In prefix order the same pass gives the counts of its beginnings. Both are
range-partitioned sorts, so one very common word is spread over many tasks; the few rows of a task that stand before
its first word or pair take them from the last one of an earlier task, one row per task. A triple sees in passing
whether it has half of the occurrences of a pair inside it, and marks that pair.

Null and empty cases: a null text is empty; a null lang is ``und``; rows may repeat, and each counts; ties in the order
go by phrase, so ranks are unique; an empty table gives an empty result. Other columns play no part.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corrobora.llm.tables import in_batches, whole_text
from corrobora.llm.words import ByteWords
from corrobora.session import cut_lineage

LEAST = 10        # occurrences of a candidate
COVERED = 50      # per cent of a phrase's occurrences that a longer candidate must have to drop it
FIRST = 2000      # rows of a language
SLICE = 1 << 21   # bytes of texts that are counted at once
BITS = 1 << 26    # of a bitmap of hashes: 8 MB
WORDS = ("w1", "w2", "w3")

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[ord("A"):ord("Z") + 1] += 32
_BYTES[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 10
_BYTES[9] = 32
_NUMBERS = np.random.default_rng(20250302).integers(0, 2 ** 64, 64 * 256, dtype=np.uint64)


def hashed(words: pa.Array) -> np.ndarray:
    """64 bits of each string, which may not be empty."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    place = (np.arange(len(data)) - np.repeat(starts, np.diff(offsets))) % 64
    return np.bitwise_xor.reduceat(_NUMBERS[place * 256 + data], starts)


def places(*hashes: np.ndarray) -> np.ndarray:
    """The bit of a phrase from the hashes of its language and words."""
    mixed = np.zeros(len(hashes[0]), dtype=np.uint64)
    for h in hashes:
        mixed = (mixed ^ h) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(BITS)).astype(np.int64)


def bitmap_of(phrases: DataFrame, columns: list[str]) -> np.ndarray:
    """The bytes of the bitmap of ``phrases``, at most ``BITS`` / 8 of them."""
    def work(batch):
        some = [batch.column(c) for c in ("lang", *columns)]
        bits = places(*map(hashed, some)) if batch.num_rows else np.empty(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(bits)], ["bit"])
    bits = in_batches(phrases.select("lang", *columns), work, "bit long")
    rows = bits.groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits")).collect()
    out = np.zeros((BITS // 32768, 4096), dtype=np.uint8)
    for r in rows:
        out[r.bucket - 1] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.reshape(-1)


def is_set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Slice:
    """The words of some texts: code, language and piece of each, and the distinct words and languages."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column("lang").dictionary_encode()
        told = ByteWords(batch.column("text"), _BYTES)
        self.size, self.piece, self.code, rows = told.size, told.piece, told.code, told.row
        self.words, self.langs = told.distinct, langs.dictionary
        self.lang = langs.indices.to_numpy().astype(np.int64)[rows]
        if self.size:
            self.word_hash = hashed(self.words)[self.code]
            self.lang_hash = hashed(self.langs)[self.lang]

    def joined(self, n: int) -> np.ndarray:
        """Whether a phrase of n words begins at each word."""
        return self.piece[:self.size - n + 1] == self.piece[n - 1:]

    def frequent(self, bitmap: np.ndarray, n: int) -> np.ndarray:
        """Whether the phrase of n words at each word may be frequent, by the bitmap of such phrases."""
        size = self.size - n + 1
        return is_set(bitmap, places(self.lang_hash[:size], *[self.word_hash[k:k + size] for k in range(n)]))

    def counted(self, at: np.ndarray, n: int) -> pa.RecordBatch:
        """(lang, w1.., c): the phrases of n words that begin at ``at``, each once."""
        key = self.lang[at]
        firsts = [at]
        for k in range(n):  # codes of longer and longer phrases stay below the number of phrases
            key = key * len(self.words) + self.code[at + k]
            _, first, key = np.unique(key, return_index=True, return_inverse=True)
            firsts = first
        counts = np.bincount(key, minlength=len(firsts)) if len(at) else np.empty(0, dtype=np.int64)
        some = at[firsts] if len(at) else at
        arrays = [self.langs.take(pa.array(self.lang[some]))] + [
            self.words.take(pa.array(self.code[some + k])) for k in range(n)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(counts.astype(np.int64))], ["lang", *WORDS[:n], "c"])


def counts(rows: DataFrame, n: int, bitmap: np.ndarray | None, least: int) -> DataFrame:
    """(lang, w1.., f): phrases of n words that occur at least ``least`` times; ``bitmap`` has the frequent phrases of
    one word less. For n = 1 also (lang, null, f): all words of each language."""
    known = None if bitmap is None else rows.sparkSession.sparkContext.broadcast(bitmap)

    def work(batch):
        told = Slice(batch)
        if told.size < n:
            at = np.empty(0, dtype=np.int64)
        elif n == 1:
            at = np.arange(told.size)
        else:
            may = told.frequent(known.value, n - 1)
            at = np.flatnonzero(told.joined(n) & may[:-1] & may[1:])
        out = told.counted(at, n)
        if n > 1:
            return out
        totals = np.bincount(told.lang, minlength=len(told.langs)) if told.size else np.zeros(len(told.langs), dtype=int)
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([out.column(0), told.langs]), pa.concat_arrays([out.column(1), pa.nulls(len(told.langs), pa.string())]),
            pa.concat_arrays([out.column(2), pa.array(totals.astype(np.int64))])], ["lang", "w1", "c"])
    words = ", ".join(f"{w} string" for w in WORDS[:n])
    summed = in_batches(rows, work, f"lang string, {words}, c long", texts="text", most_bytes=SLICE).groupBy("lang", *WORDS[:n]).agg(
        F.sum("c").alias("f"))
    return cut_lineage(summed.filter((F.col("f") >= least) | F.col("w1").isNull()))


def with_heads(stream: DataFrame, order: tuple[str, str, str], one: str, two: str) -> DataFrame:
    """The phrases of ``stream`` (lang, w1, w2, w3, f, ..) with more than one word, and the counts of the word ``one``
    and the pair ``two`` that they begin with in this order of columns; ``two`` is for triples.

    The stream is sorted and gone through once, a batch at a time; what was seen last is kept.
    """
    keys = ["lang", *order]
    ordered = stream.repartitionByRange(*keys).sortWithinPartitions(*keys)
    columns = stream.columns

    def run(batches):
        part, seen = TaskContext.get().partitionId(), [-1, -1]
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch
            f = batch.column("f").to_numpy()
            second = batch.column(order[1]).is_valid().to_numpy(zero_copy_only=False)
            third = batch.column(order[2]).is_valid().to_numpy(zero_copy_only=False)
            heads = []
            for k, head in enumerate((~second, second & ~third)):
                at = np.maximum.accumulate(np.where(head, np.arange(len(f)), -1))
                heads.append(np.where(at >= 0, f[at], seen[k]))
                seen[k] = int(heads[k][-1])
            kept = pa.array(second)
            arrays = [batch.column(c).filter(kept) for c in columns] + [pa.array(h[second]) for h in heads]
            arrays.append(pa.array(np.full(int(second.sum()), part, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays(arrays, [*columns, one, two, "part"])
        if last is not None:  # one row for the tasks behind
            arrays = [pa.nulls(1, last.schema.field(c).type) for c in columns]
            arrays += [pa.array([v], pa.int64()) for v in seen] + [pa.array([part], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, one, two, "part"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    told = cut_lineage(ordered.mapInArrow(run, f"{schema}, {one} long, {two} long, part int"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.last(F.when(F.col(c) >= 0, F.col(c)), ignorenulls=True).over(earlier).alias(f"_{c}") for c in (one, two)]
    carried = cut_lineage(told.filter("lang is null").select("part", *seen))
    mended = [F.when(F.col(c) >= 0, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in (one, two)]
    return told.filter("lang is not null").join(carried, "part").select(*columns, *mended)


def collocations(docs: DataFrame, least=LEAST, covered=COVERED, first=FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language."""
    lang = F.when(F.length("lang") > 0, F.col("lang")).when(F.col("lang").isNull(), F.lit("und")).otherwise(F.lit("\0"))
    rows = docs.select(lang.alias("lang"), whole_text().alias("text"))
    ones = counts(rows, 1, None, least)
    totals, ones = ones.filter("w1 is null").select("lang", F.col("f").alias("n")), ones.filter("w1 is not null")
    twos = counts(rows, 2, bitmap_of(ones, ["w1"]), least)
    threes = counts(rows, 3, bitmap_of(twos, ["w1", "w2"]), least)
    none = F.lit(None).cast("string")
    ones = ones.select("lang", "w1", none.alias("w2"), none.alias("w3"), "f")
    phrases = twos.select("lang", "w1", "w2", none.alias("w3"), "f").unionByName(threes.select("lang", *WORDS, "f"))

    # suffix order: the last word, the one before it, the first of three
    turned = phrases.select(
        "lang", F.coalesce("w3", "w2").alias("w1"), F.when(F.col("w3").isNull(), F.col("w1")).otherwise(F.col("w2")).alias("w2"),
        F.when(F.col("w3").isNotNull(), F.col("w1")).alias("w3"), "f")
    ended = with_heads(ones.unionByName(turned), WORDS, "last_one", "last_two")
    straight = ended.select(
        "lang", F.coalesce("w3", "w2").alias("w1"), F.when(F.col("w3").isNull(), F.col("w1")).otherwise(F.col("w2")).alias("w2"),
        F.when(F.col("w3").isNotNull(), F.col("w1")).alias("w3"), "f", "last_one", "last_two")
    zero = F.lit(None).cast("long")
    both = cut_lineage(with_heads(
        ones.select("*", zero.alias("last_one"), zero.alias("last_two")).unionByName(straight), WORDS, "first_one", "first_two"))

    # a triple with its share of a pair's occurrences drops the pair, whether it is dropped itself or not
    triples = both.filter("w3 is not null")
    marks = triples.filter(100 * F.col("f") >= covered * F.col("first_two")).select("lang", "w1", "w2").unionByName(
        triples.filter(100 * F.col("f") >= covered * F.col("last_two")).select(
            "lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")))
    pairs = both.filter("w3 is null").join(marks.hint("merge"), ["lang", "w1", "w2"], "left_anti")
    cut = lambda a, l, r: F.expr(f"cast(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) "  # noqa: E731,E741
                                 f"div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0))) as bigint)")
    early, late = cut("f", "first_one", "last_two"), cut("f", "first_two", "last_one")
    two = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"),
                       F.col("first_one").alias("l"), F.col("last_one").alias("r"), cut("f", "first_one", "last_one").alias("score"))
    three = triples.select(
        "lang", F.concat_ws(" ", *WORDS).alias("phrase"), F.col("f").alias("a"),
        F.when(early <= late, F.col("first_one")).otherwise(F.col("first_two")).alias("l"),
        F.when(early <= late, F.col("last_two")).otherwise(F.col("last_one")).alias("r"), F.least(early, late).alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select(
        F.when(F.col("lang") == "\0", F.lit("")).otherwise(F.col("lang")).alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def sql(least=LEAST, covered=COVERED, first=FIRST, docs="documents") -> str:
    """The same in one statement, by hash tables of all phrases: for comparison."""
    return f"""
WITH col_pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM {docs}),
col_lists AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM col_pieces),
col_words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM col_lists),
col_runs AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3
  FROM col_words WINDOW p AS (PARTITION BY piece ORDER BY pos)),
col_phrases AS (
  SELECT lang, 1 AS k, w1, NULL AS w2, NULL AS w3, count(*) AS f FROM col_runs GROUP BY lang, w1
  UNION ALL SELECT lang, 2, w1, w2, NULL, count(*) FROM col_runs WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
  UNION ALL SELECT lang, 3, w1, w2, w3, count(*) FROM col_runs WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
col_n AS (SELECT lang, sum(f)::BIGINT AS n FROM col_phrases WHERE k = 1 GROUP BY lang),
col_cuts AS (
  SELECT p.*, 1 AS c, x.f AS l, y.f AS r FROM col_phrases p
  JOIN col_phrases x ON x.k = 1 AND x.lang = p.lang AND x.w1 = p.w1
  JOIN col_phrases y ON y.k = p.k - 1 AND y.lang = p.lang AND y.w1 = p.w2 AND y.w2 IS NOT DISTINCT FROM p.w3
  WHERE p.k > 1 AND p.f >= {least}
  UNION ALL
  SELECT p.*, 2, x.f, y.f FROM col_phrases p
  JOIN col_phrases x ON x.k = 2 AND x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2
  JOIN col_phrases y ON y.k = 1 AND y.lang = p.lang AND y.w1 = p.w3
  WHERE p.k = 3 AND p.f >= {least}),
col_lowest AS (
  SELECT *, ((1000000::HUGEINT * f * f) // (l::HUGEINT * r))::BIGINT AS score FROM col_cuts
  QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, c) = 1),
col_covers AS (
  SELECT lang, w1, w2, max(f) AS longer FROM (
    SELECT lang, w1, w2, f FROM col_lowest WHERE k = 3 UNION ALL SELECT lang, w2, w3, f FROM col_lowest WHERE k = 3)
  GROUP BY ALL),
col_kept AS (
  SELECT s.lang, concat_ws(' ', s.w1, s.w2, s.w3) AS phrase, s.f AS a, s.l, s.r, s.score
  FROM col_lowest s LEFT JOIN col_covers v ON s.k = 2 AND v.lang = s.lang AND v.w1 = s.w1 AND v.w2 = s.w2
  WHERE v.longer IS NULL OR 100 * v.longer < {covered} * s.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM col_kept JOIN col_n USING (lang) QUALIFY rank <= {first}"""
