"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to the Latin-1 characters of the same number, so an Aho-Corasick automaton over strings finds tokens
in bytes. A piece is encoded from left to right: the longest token that starts here is taken if it is compatible with
the token before it, else the next shorter one, else the step before is undone; a position found to lead nowhere is
never entered again, so the work is linear in the piece. Two adjacent tokens are compatible if no merge across their
border would come before the merges that made them; a sequence whose neighbours are all compatible is the one that the
merges produce. Compatibilities and the ids of words are memoised, both within bounds.

Texts are cut at single spaces between other characters, where the pattern always cuts too, and each distinct word of
a slice of texts is encoded once. The longest matches of a piece come in one pass of the automaton; the backtracking
starts where two of them don't fit.

Null and empty cases: a null text counts as empty and has no ids; rows may repeat; an empty table gives an empty
result; other columns play no part. A piece of many megabytes costs about 30 bytes of memory a byte. Unpaired
surrogates can't occur in a Spark string.
"""

import array
import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

import ahocorasick

from corrobora.llm.tables import in_batches, whole_text
from corrobora.llm.words import IdTable, Memo, gathered, rows_of_words, split_words

RANKS = "byte_bpe_multi_50k.tiktoken"
MEMO = 600_000     # words that each of two generations of the memo holds; compatibilities: a quarter of it
BORDER = "Ā"  # stands between pieces: no byte's character
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
DECODED = 1 << 18  # ids that are decoded at once


class ByteBpe:
    """Encoder and decoder for the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.ranks = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.words = IdTable(memo)
        self.pairs = Memo(memo // 4)
        most = max(self.bytes_of) + 1
        self.size = np.zeros(most, dtype=np.int64)
        self.parts: dict[int, tuple[int, int]] = {}  # the two tokens that merge into a longer one
        self.automaton = ahocorasick.Automaton()
        # only tokens that the merges can produce may stand in a sequence
        reached = []
        for token, i in ranks.items():
            self.size[i] = len(token)
            if len(token) > 1:
                parts = self.halves(token)
                if parts is None:
                    continue
                self.parts[i] = parts
            reached.append((token, i))
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.unreached = {token for token in ranks if len(token) > 1 and ranks[token] not in self.parts}
        # per token the longest shorter one that it begins with
        known = dict(reached)
        self.shorter = [-1] * most
        for token, i in reached:
            self.shorter[i] = next((known[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in known), -1)
        self.table = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(most)), dtype=np.uint8)
        self.begins = np.cumsum(self.size) - self.size
        self.sizes = self.size.tolist()

    def halves(self, token: bytes) -> tuple[int, int] | None:
        """The last two parts of a token's merges, lowest rank first; none if the merges don't end in the token."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the border of the two tokens alone.

        The later made of the two is taken apart again and again; what stood at the border before that must not have
        merged across it. Of two equal merges the left one comes first.
        """
        parts, ranks, bytes_of, before = self.parts, self.ranks, self.bytes_of, 1 << 60
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and across < before:
                return False
            made_left, made_right = parts.get(left), parts.get(right)
            if made_left is None and made_right is None:
                return True
            if made_right is None or (made_left is not None and left > right):
                before, left = left, made_left[1]
            else:
                before, right = right + 1, made_right[0]

    def fits(self, key: int) -> bool:
        """``compatible`` for the left token in the upper half of ``key`` and the right one in the lower half."""
        known = self.pairs.get(key)
        if known is None:
            known = self.compatible(key >> 32, key & 0xFFFFFFFF)
            self.pairs.put(key, known)
        return known

    def all_longest(self, piece: bytes) -> list[int]:
        """The longest token that starts at each place."""
        longest, size = [-1] * len(piece), self.sizes
        for last, token in self.automaton.iter(piece.decode("latin-1")):
            longest[last + 1 - size[token]] = token  # those found later are longer
        return longest

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.unreached:
            return [self.ranks[piece]]
        # first the longest matches, one behind the other; mostly they fit
        taken = [token for _, token in self.automaton.iter_long(piece.decode("latin-1"))]
        recall, fits = self.pairs.newer.get, self.fits
        wrong, before = 1, taken[0]
        for token in taken[1:]:
            key = before << 32 | token
            fit = recall(key)
            if not (fits(key) if fit is None else fit):
                break
            before = token
            wrong += 1
        else:
            return taken
        n, size, shorter = len(piece), self.sizes, self.shorter
        longest = self.all_longest(piece)
        token = shorter[taken[wrong]]
        del taken[wrong:]
        at = sum([size[t] for t in taken])
        dead = bytearray(n + 1)  # places after which no sequence goes through
        while at < n:
            while token >= 0:
                if not dead[at + size[token]]:
                    if not taken:
                        break
                    key = before << 32 | token
                    fit = recall(key)
                    if fits(key) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                before = token
                at += size[token]
                if at < n:
                    token = longest[at]
            else:
                # each prefix has one valid sequence, so a prefix that can't go on is no prefix of the answer
                dead[at] = 1
                token = taken.pop()
                at -= size[token]
                token = shorter[token]
                if taken:
                    before = taken[-1]
        return taken

    def learned(self, words: list[str]) -> list[bytes]:
        """The ids of each word, a text of its own, as little-endian uint32."""
        plain = [w.split() == [w.removeprefix(" ")] for w in words]  # no white space but one leading space
        found = iter(self.pattern.findall("\n".join([w for w, p in zip(words, plain) if p])))
        pieces, out = {}, []
        for w, p in zip(words, plain):
            own = iter(found.__next__, "\n") if p else self.pattern.findall(w)
            ids = b""
            try:
                for piece in own:
                    known = pieces.get(piece)
                    if known is None:
                        known = pieces[piece] = array.array("I", self.encode_piece(piece.encode())).tobytes()
                    ids += known
            except StopIteration:  # behind the last plain word
                pass
            out.append(ids)
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place of each row's first id and one more, all ids)."""
        offsets, codes, distinct = split_words(texts)
        # a row where spaces or other white space stand together, or at its ends, is cut by the pattern BETWEEN instead
        uneven = pc.or_(pc.equal(distinct, ""), pc.not_equal(pc.utf8_trim_whitespace(distinct), distinct))
        uneven = uneven.to_numpy(zero_copy_only=False)[codes]
        rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
        odd = np.unique(rows[uneven])
        heads = distinct.take(pa.array(codes[offsets[:-1]]))
        chunks = [BETWEEN.split(texts[row].as_py()) for row in odd.tolist()]
        chunks = [[head, *[" " + w for w in rest]] for head, *rest in chunks]
        words = pa.concat_arrays([
            pc.binary_join_element_wise(pa.scalar(" "), distinct, ""), heads,
            pa.array([w for part in chunks for w in part], pa.string())])
        # the first word of a row has no space before it; an odd row stands for its chunks
        used = ~np.isin(rows, odd)
        codes = codes.astype(np.int64)
        codes[offsets[:-1]] = len(distinct) + np.arange(len(heads))
        sizes = np.bincount(rows[used], minlength=len(texts))
        sizes[odd] = [len(part) for part in chunks]
        order = np.concatenate([rows[used], np.repeat(odd, sizes[odd])]).argsort(kind="stable")
        codes = np.concatenate([codes[used], len(distinct) + len(heads) + np.arange(sizes[odd].sum())])[order]
        wanted, codes = np.unique(codes, return_inverse=True)
        coded = words.take(pa.array(wanted)).dictionary_encode()
        codes = coded.indices.to_numpy()[codes]
        return rows_of_words(codes, np.concatenate([[0], np.cumsum(sizes)]),
                             *self.words.ids_of(coded.dictionary, self.learned))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_column(pa.array([text], pa.string()))[1].tobytes()

    def decode(self, ids: bytes) -> bytes:
        whole, out = np.frombuffer(ids, dtype="<u4"), []
        for i in range(0, len(whole), DECODED):
            part = whole[i:i + DECODED]
            out.append(gathered(self.table, self.begins[part], self.size[part]).tobytes())
        return b"".join(out)


def ranks_from(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBpe:
    """One per Python worker; the vocabulary file is installed on every machine."""
    with open(path, "rb") as file:
        return ByteBpe(ranks_from(file.read()), pattern)


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep=("doc_id",)) -> DataFrame:
    """``keep`` columns and n_tokens, ids (binary, little-endian uint32), decoded_sha256, round_trip (bytes equal)."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    rows = docs.select(*keep, whole_text().alias("_whole_text"))

    def work(batch):
        bpe, texts = encoder(path, pattern), batch.column("_whole_text")
        offsets, ids = bpe.encode_column(texts)
        back = memoryview(bpe.decode(ids.tobytes()))
        sizes = np.concatenate([[0], np.cumsum(bpe.size[ids])])[offsets].tolist()
        decoded, equal = [], []
        for a, b, text in zip(sizes, sizes[1:], texts):
            decoded.append(hashlib.sha256(back[a:b]).hexdigest())
            equal.append(text.as_buffer() == back[a:b])
        data = pa.Array.from_buffers(pa.binary(), len(texts), [
            None, pa.py_buffer((4 * offsets).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
        arrays = [batch.column(c) for c in keep] + [
            pa.array(np.diff(offsets), pa.int64()), data, pa.array(decoded, pa.string()), pa.array(equal, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, [*keep, "n_tokens", "ids", "decoded_sha256", "round_trip"])
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return in_batches(rows, work, f"{schema}, n_tokens long, ids binary, decoded_sha256 string, round_trip boolean",
                      texts="_whole_text")


def decoded_texts(rows: DataFrame, path: str | None = None, ids="ids", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns and the text of each id sequence; bytes that are no UTF-8 become replacement marks."""
    path = path or public_tokenizers.path(RANKS)

    def work(batch):
        bpe = encoder(path, public_tokenizers.PATTERN)
        texts = [None if x is None else bpe.decode(x).decode("utf-8", "replace")
                 for x in batch.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(c) for c in keep] + [pa.array(texts, pa.string())], [*keep, "text"])
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return in_batches(rows.select(*keep, ids), work, f"{schema}, text string")


def vocabulary_table(spark: SparkSession, path: str) -> DataFrame:
    """(rank, token) of a rank file, as a table."""
    lines = spark.read.text(path)
    return lines.selectExpr("cast(split(value, ' ')[1] as int) rank", "unbase64(split(value, ' ')[0]) token")
