"""Words of an Arrow column as codes of distinct words, and ids gathered by such codes."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Memo:
    """A dictionary of two generations: when the newer one is full it becomes the older one, which is dropped."""

    def __init__(self, most: int):
        self.most, self.newer, self.older = most, {}, {}

    def get(self, key):
        found = self.newer.get(key)
        if found is None:
            found = self.older.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.newer) >= self.most:
            self.older, self.newer = self.newer, {}
        self.newer[key] = value


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first word of each row and one more place, code of each word, distinct words); cut at single spaces.

    ``column`` holds strings and no nulls; a row has one word more than spaces.
    """
    lists = pc.split_pattern(column, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy(), coded.dictionary


class ByteWords:
    """The words of an Arrow column of strings without nulls: runs of bytes that ``table`` doesn't turn into a gap.

    ``table`` has a byte for each byte; gaps are 32 and, between pieces of a row, 10. No word crosses a row.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        low = table[data]
        inside = (low != 32) & (low != 10)
        fresh = np.ones(len(low) + 1, dtype=bool)  # where no word goes on from the byte before
        fresh[1:-1] = ~inside[:-1]
        fresh[offsets] = True
        starts = np.flatnonzero(inside & fresh[:-1])
        ends = np.flatnonzero(inside & np.append(~inside[1:] | fresh[1:-1], True)) + 1
        self.size = len(starts)
        self.row = np.searchsorted(offsets, starts, side="right") - 1
        self.piece = np.cumsum(low == 10, dtype=np.int32)[starts] + self.row if self.size else self.row
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), self.size, [
            None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(low[inside].tobytes())]).dictionary_encode()
        self.distinct, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[starts:starts + lengths]`` of each entry, one behind the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class IdTable:
    """The ids of many words in a few arrays: words of up to ``LONGEST`` bytes by a 128-bit hash of their bytes.

    The hash is the exclusive or of random numbers for each byte at each place, so two of n words share it with a
    probability of n^2 / 2^129. Of two generations of at most ``most`` words the older one is dropped when the newer
    one is full.
    """

    LONGEST = 48

    def __init__(self, most: int):
        rng = np.random.default_rng(20250301)
        self.numbers = rng.integers(0, 2 ** 64, (2, self.LONGEST * 256), dtype=np.uint64)
        self.most, self.newer, self.older = most, self.blank(), self.blank()

    @staticmethod
    def blank():
        """(first half of the hash in order, other half, start, length, ids)."""
        return (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64),
                np.empty(0, dtype=np.int64), np.empty(0, dtype="<u4"))

    def hashed(self, words: pa.Array):
        """(whether each word is short enough and not empty, first half, other half)."""
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        short = (size > 0) & (size <= self.LONGEST)
        if not short.any():
            return short, *self.blank()[:2]
        chosen = words.filter(pa.array(short))
        size = size[short]
        starts = np.cumsum(size) - size
        offsets = np.frombuffer(chosen.buffers()[1], dtype=np.int32)[chosen.offset:chosen.offset + len(chosen) + 1]
        data = np.frombuffer(chosen.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
        cell = (np.arange(len(data)) - np.repeat(starts, size)) * 256 + data
        return short, *(np.bitwise_xor.reduceat(half[cell], starts) for half in self.numbers)

    @staticmethod
    def found(table, first, other):
        """Place of each hash in a generation, -1 if it isn't there."""
        if not len(table[0]):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(table[0], first), len(table[0]) - 1)
        return np.where((table[0][at] == first) & (table[1][at] == other), at, -1)

    def put(self, first, other, ids: np.ndarray, lengths: np.ndarray):
        """New words, which are not there yet."""
        if len(self.newer[0]) + len(first) > self.most and len(self.newer[0]):
            self.older, self.newer = self.newer, self.blank()
        starts = np.cumsum(lengths) - lengths + len(self.newer[4])
        order = np.argsort(first)
        place = np.searchsorted(self.newer[0], first[order])
        self.newer = (*(np.insert(old, place, new[order]) for old, new in zip(
            self.newer, (first, other, starts, lengths))), np.concatenate([self.newer[4], ids]))

    def ids_of(self, words: pa.Array, learned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start and length of each word's ids); ``learned(list of words)`` gives those that are not known."""
        short, first, other = self.hashed(words)
        place, old = self.found(self.newer, first, other), self.found(self.older, first, other)
        old[place >= 0] = -1
        length = np.zeros(len(words), dtype=np.int64)
        start = np.zeros(len(words), dtype=np.int64)
        where, flat, base = np.flatnonzero(short), [], 0
        for table, at in ((self.newer, place), (self.older, old)):
            there = at >= 0
            own = table[3][at[there]]
            flat.append(gathered(table[4], table[2][at[there]], own))
            length[where[there]] = own
            start[where[there]] = base + np.cumsum(own) - own
            base += len(flat[-1])
        again = old >= 0
        moved = flat[1], length[where[again]], first[again], other[again]
        known = ~short & (pc.binary_length(words).to_numpy(zero_copy_only=False) == 0)
        known[where[(place >= 0) | again]] = True
        missing = np.flatnonzero(~known)
        if len(missing):
            ids = learned(words.take(pa.array(missing)).to_pylist())
            own = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            flat.append(np.frombuffer(b"".join(ids), dtype="<u4"))
            length[missing], start[missing] = own, base + np.cumsum(own) - own
            kept = short[missing]
            fresh = (place < 0) & (old < 0)
            self.put(first[fresh], other[fresh],
                     flat[-1] if kept.all() else gathered(flat[-1], (np.cumsum(own) - own)[kept], own[kept]), own[kept])
        if again.any():
            self.put(moved[2], moved[3], moved[0], moved[1])
        return np.concatenate(flat), start, length


def rows_of_words(codes, offsets, ids, start, length) -> tuple[np.ndarray, np.ndarray]:
    """(place of each row's first id and one more, all ids) of rows that are runs of coded words."""
    own = length[codes]
    ends = np.concatenate([[0], np.cumsum(own)])
    return ends[offsets], gathered(ids, start[codes], own)


def slices_of(batch: pa.RecordBatch, column: str, most_rows: int, most_bytes: int):
    """``batch`` in slices of at most so many rows and bytes of ``column``; a longer row is a slice of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        fits = int(np.searchsorted(ends, before + most_bytes, side="right")) - at
        n = max(1, min(most_rows, fits))
        yield batch.slice(at, n)
        at += n
