"""Token ids of a corpus as ORC files.

The documents are dealt out by ranges of their id (ties by a hash of the text, so that no range has to be large), put
in order inside each range, encoded there and written. An ORC stripe keeps the ids with integer run-length encoding;
row indexes and a Bloom filter on the document id let a reader skip stripes. ``seq`` grows with the place in the file:
its upper part is the number of the range, its lower part the row in it.

Reading back gives per document the place of its first id in the whole sequence: sums per range, then a running sum
over the ranges, then one inside each range. No task sees more than one range or one number per range.

Null and empty cases: a null text is empty and has the end id only; a null doc_id sorts before all others; rows with
the same id stand in order of their text's hash; an empty table gives files without rows. Other columns are not read.
"""

import functools
import os
import re
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corrobora.llm.tables import in_batches, whole_text
from corrobora.llm.words import IdTable, Memo, rows_of_words, split_words
from corrobora.session import cut_lineage, shared_folder

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SEPARATOR, SEPARATOR_ID = "<|endoftext|>", 49407
MEMO = 600_000      # words that each of two generations of the memo holds; parts of words: an eighth of it
LONGEST_MEMO = 40   # characters of a part that is remembered
TOGETHER = 4000     # words that the library encodes in one call
#: A run of letters before an ASCII character that is none.
HEAD = re.compile(r"[^\W\d_]+(?=[\x00-\x40\x5B-\x60\x7B-\x7F])")


class WordMemo:
    """The library's encoder behind a memo of words.

    The tokenizer's own rules cut at white space whatever stands around it, so a text's ids are its words' ids in
    turn. They also cut behind a run of letters, so a word is a head of letters and a rest, each remembered by itself.
    The two stay together where composing or folding characters could move that border: the rest has to begin with an
    ASCII character that is no letter, and the head has to be letters still after NFC and lower-casing.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.parts = IdTable(memo), Memo(memo // 8)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that end a run of letters
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def cut(self, parts: list[str], between: str, ends) -> list[bytes]:
        """The ids of ``parts`` from one call; ``ends(ids)`` are the places behind each part's ids."""
        ids = self.ids(between.join(parts))
        stops = ends(ids)
        if len(stops) != len(parts):
            return [self.ids(x).tobytes() for x in parts]
        raw, starts = ids.tobytes(), [0, *(stops[:-1] + (between != " ")).tolist()]
        return [raw[4 * i:4 * j] for i, j in zip(starts, stops.tolist())]

    def learned(self, parts: list[str]) -> dict[str, bytes]:
        """Runs of letters are one word each to the library, so the tokens that end a word part them; special strings
        part the others."""
        runs = [x for x in parts if is_run(x)]
        odd = [x for x in parts if not is_run(x) and ("<|" in x or len(x) > 1000)]
        others = [x for x in parts if not is_run(x) and "<|" not in x and len(x) <= 1000]
        out = {x: self.ids(x).tobytes() for x in odd}
        for i in range(0, len(runs), TOGETHER):
            part = runs[i:i + TOGETHER]
            out.update(zip(part, self.cut(part, " ", lambda ids: np.flatnonzero(self.last[ids]) + 1)))
        for i in range(0, len(others), TOGETHER):
            part = others[i:i + TOGETHER]
            out.update(zip(part, self.cut(
                part, SEPARATOR, lambda ids: np.append(np.flatnonzero(ids == SEPARATOR_ID), len(ids)))))
        return out

    def ids_of(self, words: list[str]) -> list[bytes]:
        pairs = [head_and_rest(w) for w in words]
        known = {x: self.parts.get(x) for pair in pairs for x in pair}
        known[""] = b""
        fresh = self.learned([x for x, ids in known.items() if ids is None])
        known.update(fresh)
        for x, ids in fresh.items():
            if len(x) <= LONGEST_MEMO:
                self.parts.put(x, ids)
        return [known[head] + known[rest] for head, rest in pairs]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place of each row's first id and one more, all ids)."""
        offsets, codes, distinct = split_words(pc.replace_substring(texts, "\n", " "))
        return rows_of_words(codes, offsets, *self.words.ids_of(distinct, self.ids_of))


def is_run(part: str) -> bool:
    """Whether a word is a run of letters that stays one when it is composed and lower-cased."""
    return part.isalpha() and (part.isascii() or unicodedata.normalize("NFC", part).lower().isalpha())


def head_and_rest(word: str) -> tuple[str, str]:
    found = HEAD.match(word)
    if found is None:
        return word.lower() if word.isascii() and word.isalpha() else word, ""
    head = found[0]
    if head.isascii():
        return head.lower(), word[len(head):]
    return (head, word[len(head):]) if is_run(head) else (word, "")


@functools.lru_cache(maxsize=2)
def memo(path: str) -> WordMemo:
    """One per Python worker; the vocabulary file is installed on every machine."""
    return WordMemo(path)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id=END_ID) -> None:
    """ORC files (seq, doc_id, ids) under ``folder``, in ascending order of doc_id over all files."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = (
        rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select(F.monotonically_increasing_id().alias("seq"), "doc_id", "text")
    )
    def work(batch):
        offsets, ids = memo(path).encode_column(batch.column("text"))
        values = np.insert(ids.astype(np.int32), offsets[1:], end_id)
        offsets = (offsets + np.arange(len(offsets))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("seq"), batch.column("doc_id"),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["seq", "doc_id", "ids"])
    key = rows.schema["doc_id"].dataType.simpleString()
    (
        in_batches(ordered, work, f"seq long, doc_id {key}, ids array<int>", texts="text")
        .write.option("orc.compress", "zstd").option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "1000")
        .orc(folder)
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, doc_id, ids) as written; filters on doc_id skip stripes."""
    return spark.read.orc(folder)


def token_places(files: DataFrame) -> DataFrame:
    """One row per document from the files' rows: doc_id, start, n_tokens, ids_crc32."""
    def work(batch):
        ids = batch.column("ids")
        values = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False).tobytes())
        offsets = ids.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]  # a slice of a batch starts anywhere
        crc = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.RecordBatch.from_arrays(
            [batch.column("seq"), batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()),
             pa.array(crc, pa.int64())], ["seq", "doc_id", "n_tokens", "ids_crc32"])
    key = files.schema["doc_id"].dataType.simpleString()
    told = in_batches(files.select("seq", "doc_id", "ids"), work,
                      f"seq long, doc_id {key}, n_tokens long, ids_crc32 long")
    told = cut_lineage(told).withColumn("part", F.shiftright("seq", 33))
    sums = told.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        told.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(offsets, "part")
        .select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )


def new_folder(spark: SparkSession, name="token-ids") -> str:
    """A folder of its own where all executors can write and read."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
