"""Token counts from a tokenizer compiled to finite-state transducers.

Two deterministic transducers stand for a word-level BPE tokenizer (lower case, white space dropped, word ends):

* The *word machine* cuts text into words. It has seven states, so a chunk of text is a map from the state before it to
  the state behind it. All chunks are run side by side from all seven states, the maps are composed by a parallel
  prefix scan, and a second run from the states now known marks where words begin.
* The *merge machine* reads the bytes of a word. A state holds what the rest of the word can still depend on: for
  every position from which a token may still be open, the token that ends there and how many tokens lie before.
  A transition is annotated with the tokens it emits; it may take some back, as a longer token replaces shorter ones.
  The one token that ends a prefix is the one that fits the token before it, and two tokens fit if the merges of their
  symbols give back just these two. States and transitions are compiled when first met and kept in dense tables;
  beyond a bound the tables are dropped and grow anew, so memory is bounded and results don't change.

All words of a batch take their steps together as array operations. Special strings in a text count as one token each,
as the library does by default.

Null and empty cases: a null text has 0 bytes and 0 tokens; rows may repeat; an empty table gives an empty result; other
columns play no part.
"""

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from corrobora.llm.tables import in_batches, whole_text

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
MOST_STATES = 60_000   # of the merge machine, before its tables are dropped
SLICE = 1 << 20        # characters that are taken through the machines at once
CHUNK = 128            # characters per state map

# classes of characters that the word machine tells apart
SPACE_, NUMBER, OTHER, QUOTE, LETTER, SHORT, R, V, L, E = range(10)
# its states: nothing open; in letters; in other marks; after a leading ' ; after 'r, 'v, 'l
NONE, WORD, MARKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
HERE, BEFORE = 1, 2    # annotations: a word begins at this character, or began at the one before


def word_machine():
    """(next state, annotation) for each state and class."""
    def opened(c):
        if c == SPACE_:
            return NONE, 0
        if c == NUMBER:
            return NONE, HERE
        if c == OTHER:
            return MARKS, HERE
        return (QUOTED, HERE) if c == QUOTE else (WORD, HERE)

    def step(state, c):
        letter = c >= LETTER
        if state == WORD and letter:
            return WORD, 0
        if state in (MARKS, QUOTED) and c in (OTHER, QUOTE):
            return MARKS, 0
        if state == QUOTED:
            if c == SHORT:
                return NONE, 0
            if c in (R, V, L):
                return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
        if state in (QUOTED_R, QUOTED_V, QUOTED_L):
            if c == (L if state == QUOTED_L else E):
                return NONE, 0
            after, mark = step(WORD, c)
            return after, mark | BEFORE
        return opened(c)
    table = [[step(s, c) for c in range(10)] for s in range(7)]
    return (np.array([[x[0] for x in row] for row in table], dtype=np.uint8),
            np.array([[x[1] for x in row] for row in table], dtype=np.uint8))


@functools.lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            classes[code] = LETTER
        elif kind[0] == "N":
            classes[code] = NUMBER
        elif kind[0] == "Z":
            classes[code] = SPACE_
    classes[[9, 10, 11, 12, 13, 0x85]] = SPACE_
    classes[ord("'")] = QUOTE
    for letters, name in (("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        classes[[ord(x) for x in letters]] = name
    return classes


def word_starts(classes: np.ndarray, chunk=CHUNK) -> np.ndarray:
    """Whether a word begins at each character; the last character must be white space."""
    after, marks = word_machine()
    n = len(classes)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, SPACE_, dtype=np.uint8)
    padded[:n] = classes
    grid = np.ascontiguousarray(padded.reshape(rows, chunk).T)  # column k holds chunk k
    flat_after, flat_marks = after.reshape(-1), marks.reshape(-1)
    # the state maps of all chunks
    maps = np.repeat(np.arange(7, dtype=np.uint8)[:, None], rows, axis=1)
    for j in range(chunk):
        maps = flat_after[maps * np.uint8(10) + grid[j]]
    maps = maps.T
    # prefix scan: after it, row k maps the state before the first chunk to the state behind chunk k
    reach = 1
    while reach < rows:
        maps = np.concatenate([maps[:reach], np.take_along_axis(maps[reach:], maps[:-reach], axis=1)])
        reach *= 2
    state = np.concatenate([[NONE], maps[:-1, NONE]]).astype(np.uint8)
    told = np.empty((chunk, rows), dtype=np.uint8)
    for j in range(chunk):
        at = state * np.uint8(10) + grid[j]
        told[j] = flat_marks[at]
        state = flat_after[at]
    told = np.ascontiguousarray(told.T).reshape(-1)[:n]
    starts = (told & HERE).astype(bool)
    starts[:-1] |= (told[1:] & BEFORE).astype(bool)
    return starts


class MergeMachine:
    """Transducer over the bytes of a word."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary, most_states=MOST_STATES):
        self.most_states = most_states
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.last_of = [c + "</w>" for c in byte_letters()]
        self.letter = byte_letters()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.tokens, self.open = set(), set()
        for token in vocabulary:
            symbols = self.symbols(token)
            if not symbols or any(s[0] not in to_byte for s in symbols):
                continue
            if len(symbols) == 1 or self.merged(symbols) == [token]:
                self.tokens.add(token)
                for k in range(1, len(symbols)):
                    self.open.add("".join(symbols[:k]))
        self.reset()

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith("</w>") and len(token) > 4:
            plain = token[:-4]
            return [*plain[:-1], plain[-1] + "</w>"]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        parts = list(symbols)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get((parts[i], parts[i + 1]))
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str | None, right: str) -> bool:
        if left is None:
            return True
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merged(self.symbols(left) + self.symbols(right)) == [left, right]
        return known

    def reset(self):
        self.number = {("", ((0, None, 0),)): 0}
        self.states = [("", ((0, None, 0),))]
        self.next = np.full((1024, 256), -1, dtype=np.int32)
        self.emits = np.zeros((1024, 256), dtype=np.int8)
        self.ends = np.zeros((1024, 256), dtype=np.int8)  # 0: not compiled
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()

    def ending(self, state, symbol: str) -> tuple[str, int]:
        """The token that ends with ``symbol``, and the tokens before it, counted from the state's position."""
        suffix, places = self.states[state]
        for k, before, count in places:
            token = suffix[len(suffix) - k:] + symbol
            if token in self.tokens and self.fits(before, token):
                return token, count
        raise ValueError(f"no token ends with {symbol!r}")

    def compile_step(self, state: int, byte: int):
        letter = self.letter[byte]
        token, count = self.ending(state, letter)
        emitted = count + 1
        suffix, places = self.states[state]
        still = [(k + 1, before, c - emitted) for k, before, c in places
                 if suffix[len(suffix) - k:] + letter in self.open]
        kept = max([k for k, _, _ in still], default=0)
        new = ((suffix + letter)[len(suffix) + 1 - kept:], (*still, (0, token, 0)))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
            if number >= len(self.next):
                grow = 8192
                self.next = np.concatenate([self.next, np.full((grow, 256), -1, dtype=np.int32)])
                self.emits = np.concatenate([self.emits, np.zeros((grow, 256), dtype=np.int8)])
                self.ends = np.concatenate([self.ends, np.zeros((grow, 256), dtype=np.int8)])
        self.next[state, byte], self.emits[state, byte] = number, emitted

    def counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each word ``data[start:start + length]``; all lengths are positive."""
        if len(self.states) > self.most_states:
            self.reset()
        order = np.argsort(-length, kind="stable")
        at, size = start[order], length[order]
        going = np.searchsorted(-size, -np.arange(1, size[0] + 2 if len(size) else 1), side="right")
        state, total = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        for j in range(int(size[0]) if len(size) else 0):
            n, go_on = int(going[j]), int(going[j + 1])
            cell = state[:n] * 256 + data[at[:n] + j]
            last = cell[go_on:]
            emitted = self.ends.reshape(-1)[last]
            if (unknown := last[emitted == 0]).size:
                for c in np.unique(unknown).tolist():
                    self.ends[c >> 8, c & 255] = self.ending(c >> 8, self.last_of[c & 255])[1] + 1 + 64
                emitted = self.ends.reshape(-1)[last]
            total[go_on:n] += emitted.astype(np.int64) - 64
            more = cell[:go_on]
            after = self.next.reshape(-1)[more]
            if (unknown := more[after < 0]).size:
                for c in np.unique(unknown).tolist():
                    self.compile_step(c >> 8, c & 255)
                after = self.next.reshape(-1)[more]
            total[:go_on] += self.emits.reshape(-1)[more]
            state[:go_on] = after
        out = np.empty(len(order), dtype=np.int64)
        out[order] = total
        return out


@functools.lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable in Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class CountingTransducer:
    """A tokenizer file of this kind, compiled."""

    def __init__(self, content: str, most_states=MOST_STATES, slice_chars=SLICE):
        spec = json.loads(content)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.machine = MergeMachine(merges, model["vocab"], most_states)
        self.slice = slice_chars

    def prepared(self, text: str) -> tuple[str, int]:
        """Normalised text without special strings, and how many of them there were."""
        found = 0
        if self.special and "<" in text:
            text, found = self.special.subn(" ", text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower(), found

    def count(self, texts: list[str]) -> np.ndarray:
        out, waiting, size = np.zeros(len(texts), dtype=np.int64), [], 0
        for i, text in enumerate(texts):
            plain, out[i] = self.prepared(text)
            waiting.append((i, plain))
            size += len(plain)
            if size >= self.slice:
                self.run(waiting, out)
                waiting, size = [], 0
        if waiting:
            self.run(waiting, out)
        return out

    def run(self, waiting, out):
        joined = "".join(x + " " for _, x in waiting)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        classes = character_classes()[codes]
        starts = np.flatnonzero(word_starts(classes))
        if not len(starts):
            return
        # a word ends before the next one or before white space
        stops = np.flatnonzero(classes == SPACE_)
        ends = np.minimum(np.append(starts[1:], len(codes)), stops[np.searchsorted(stops, starts)])
        width = np.concatenate([[0], np.cumsum(
            1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), dtype=np.int64)])
        data = np.frombuffer(joined.encode(), dtype=np.uint8)
        counts = self.machine.counts(data, width[starts], width[ends] - width[starts])
        edges = np.cumsum([len(x) + 1 for _, x in waiting])
        rows = np.searchsorted(edges, starts, side="right")
        out[[i for i, _ in waiting]] += np.bincount(rows, weights=counts, minlength=len(waiting)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def transducer(path: str, most_states: int) -> CountingTransducer:
    """One per Python worker; the vocabulary file is installed on every machine."""
    with open(path, encoding="utf-8") as file:
        return CountingTransducer(file.read(), most_states)


def token_counts(docs: DataFrame, path: str | None = None, limit=LIMIT, most_states=MOST_STATES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select("doc_id", whole_text().alias("text"))

    def work(batch):
        texts = batch.column("text").to_pylist()
        n = transducer(path, most_states).count(texts)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()),
             pa.array(n > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    key = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(rows, work, f"doc_id {key}, n_bytes long, n_tokens long, over_limit boolean")
