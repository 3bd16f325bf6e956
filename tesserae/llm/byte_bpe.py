"""Byte-level BPE: encoding with vectorised pre-tokenisation, and decoding.

Where a pre-token begins depends on a small automaton over character classes. Every character is a
function from the automaton's states to its states; composing functions is associative, so the state
before each character comes from a scan over numbered functions (columns of a reshaped array, then the
row totals the same way), without a regular expression. The slices between boundaries, zero-copy views
into the text, are merged by rank once each and remembered; the ids' byte offsets allow decoding any part.

The states encode the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.

Defined cases: null and empty texts have no tokens; repeated rows are encoded alike; an empty table
gives an empty result; further columns are ignored; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.blocks import flat, groups, ranges, text_blocks
from tesserae.llm.slices import Index, Slices

CONT, SP, WS, LETTER, NUMBER, OTHER, APOS, ONE, TWO = range(9)
START, SPACE_, IN_L, IN_N, IN_O, QUOTE, HALF, DONE = range(8)
#: Slices, and bytes of slices, that a worker remembers at most.
CACHE, CACHE_BYTES = 1 << 19, 1 << 24
#: Slices of more bytes are merged one by one.
LONG = 64
#: No pair has this rank.
NONE = np.int64(1 << 40)


@cache
def class_table() -> np.ndarray:
    """Class of every code point, as the library's own Unicode tables have it.

    An encoding with one token per byte and a class for its pattern returns the characters of that class.
    """
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WS, r"\s")):
        found = tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(found.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = kind
    table[0x20], table[0x27] = SP, APOS
    return table


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class of the character that begins at each byte; CONT inside a character."""
    table = class_table()
    out = table[:256][data]
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        out[high] = CONT
        lead = high[data[high] >= 0xC0]
        b = data[lead].astype(np.int32)
        more = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) & 0x3F
        two, three = ((b & 0x1F) << 6) | more(1), ((b & 0x0F) << 12) | (more(1) << 6) | more(2)
        four = ((b & 0x07) << 18) | (more(1) << 12) | (more(2) << 6) | more(3)
        out[lead] = table[np.where(b < 0xE0, two, np.where(b < 0xF0, three, np.minimum(four, 0x10FFFF)))]
    after = np.zeros(len(data), np.uint8)
    after[:-1] = data[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = 0
    single = np.zeros(256, bool)
    single[list(b"stmd")] = True
    out[single[data]] = ONE
    pair = ((data == 0x72) | (data == 0x76)) & (after == 0x65) | (data == 0x6C) & (after == 0x6C)
    out[pair] = TWO
    return out


def step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a pre-token begins at a character of this kind (white space is decided apart)."""
    if kind == CONT:
        return state, False
    if kind in (SP, WS):
        return (SPACE_ if kind == SP else START), False
    if kind in (LETTER, ONE, TWO):
        if state == QUOTE and kind != LETTER:
            return (DONE if kind == ONE else HALF), False
        return (DONE, False) if state == HALF else (IN_L, state not in (SPACE_, IN_L))
    if kind == NUMBER:
        return IN_N, state not in (SPACE_, IN_N)
    inside = state in (SPACE_, IN_O, QUOTE)
    return (QUOTE if kind == APOS and not inside else IN_O), not inside


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each class's function, the same after a row start, composition table, functions as rows)."""
    functions = [tuple(range(8))]
    index = {functions[0]: 0}

    def number(f: tuple[int, ...]) -> int:
        if f not in index:
            index[f] = len(functions)
            functions.append(f)
        return index[f]

    plain = np.array([number(tuple(step(s, k)[0] for s in range(8))) for k in range(9)], np.uint16)
    first = np.array([number((step(START, k)[0],) * 8) for k in range(9)], np.uint16)
    done = 0
    while done < len(functions):  # close the set under composition with the classes' functions
        f = functions[done]
        for g in {*plain.tolist(), *first.tolist()}:
            number(tuple(functions[g][x] for x in f))
        done += 1
    table = np.array(functions, np.uint8)
    compose = np.array([[number(tuple(g[x] for x in f)) for g in functions] for f in functions], np.uint16)
    return plain, first, compose, table


def scan(codes: np.ndarray, compose: np.ndarray, width: int = 64) -> np.ndarray:
    """For each element the composition of all functions before it."""
    n, size = len(codes), compose.shape[0]
    if n == 0:
        return codes
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint16)
    padded[:n] = codes
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    flat, before = compose.ravel().astype(np.uint16), np.empty_like(columns)
    acc = np.zeros(rows, np.intp)
    for j in range(width):
        before[j] = acc
        acc = flat[acc * size + columns[j]].astype(np.intp)
    if rows > 1:
        carried = scan(acc.astype(np.uint16), compose, width).astype(np.intp) * size
        for j in range(width):
            before[j] = flat[carried + before[j]]
    return before.T.ravel()[:n]


@cache
def begins_table() -> np.ndarray:
    return np.array([[step(s, k)[1] for k in range(9)] for s in range(8)])


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens begin, over all rows; an empty row has none."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = classes(data, offsets)
    plain, first, compose, table = automaton()
    codes = plain[kind]
    starts = offsets[:-1][np.diff(offsets) > 0]
    codes[starts] = first[kind[starts]]
    state = table[scan(codes, compose), START]
    begins = begins_table()[state, kind]
    blank = (kind == SP) | (kind == WS)
    if blank.any():
        at = np.flatnonzero(kind != CONT)  # characters
        k = blank[at]
        row_first = np.zeros(len(data) + 1, bool)
        row_first[offsets] = True
        previous = np.append(False, k[:-1]) & ~row_first[at]
        nxt = np.append(at[1:], len(data))
        follows = ~row_first[nxt] & ~np.append(k[1:], True)  # a character that is no blank follows in the row
        begins[at[k]] = (~previous | follows)[k]
    begins[starts] = True
    return np.flatnonzero(begins)


class Merger:
    """Merges the bytes of slices by rank: of all neighbours whose joint bytes are a token, those of least rank first, from the left."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every way to cut a token in two tokens is a pair that merges.
        pairs = {(ranks[t[:i]] << 20) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs, self.index = pairs, Index()
        self.index.put(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.index.get(((left << 20) | right).view(np.uint64))
        return np.where(found < 0, NONE, found)

    def one(self, text: bytes) -> list[int]:
        """A single slice, with a heap of pairs and links to the neighbours."""
        ids = self.of_byte[np.frombuffer(text, np.uint8)].tolist()
        n = len(ids)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (r := self.pairs.get((ids[i] << 20) | ids[after[i]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(before[i])
            push(i)
        return [x for x in ids if x >= 0]

    def many(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices one after the other, number of ids of each) for slices of a byte or more; one merge in each slice per round."""
        lengths = np.fromiter(map(len, slices), np.int64, len(slices))
        token = self.of_byte[np.frombuffer(b"".join(slices), np.uint8)]
        owner = np.repeat(np.arange(len(slices)), lengths)
        rank = np.full(len(token), NONE)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.pair_ranks(token[inner], token[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            starts, ends = groups(owner)
            least = np.minimum.reduceat(rank, starts)
            open_ = least < NONE
            if open_.sum() < 0.7 * len(starts):  # what is finished is put aside
                stay = np.repeat(open_, ends - starts)
                done.append((owner[~stay], token[~stay]))
                token, owner, rank = token[stay], owner[stay], rank[stay]
                continue
            hit = np.flatnonzero((rank == np.repeat(least, ends - starts)) & (rank < NONE))
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]  # the leftmost of each slice
            token[hit] = rank[hit]
            keep = np.ones(len(token), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged tokens stand once their right halves are gone
            token, owner, rank = token[keep], owner[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                inside = (i + 1 < len(token)) & (owner[i] == owner[np.minimum(i + 1, len(token) - 1)])
                rank[i] = NONE
                rank[i[inside]] = self.pair_ranks(token[i[inside]], token[i[inside] + 1])
        owner, token = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (owner, token)
        return token[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(slices))


class Codec:
    """Encoder and decoder for one rank file; slices once encoded are remembered."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merger = Merger(ranks)
        top = max(ranks.values()) + 1
        parts = [b""] * top
        for token, rank in ranks.items():
            parts[rank] = token
        self.size = np.fromiter(map(len, parts), np.int64, top)
        self.start, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(parts), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known = Slices()
        self.table, self.begin, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), 0

    def learn(self, new: list[bytes]) -> None:
        # A slice that is a token stays whole, long ones are merged one by one, all others together.
        whole = [self.merger.ranks.get(w) for w in new]
        rest = [k for k, (w, r) in enumerate(zip(new, whole, strict=True)) if r is None and len(w) <= LONG]
        ids, sizes = self.merger.many([new[k] for k in rest]) if rest else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        long = {k: self.merger.one(w) for k, (w, r) in enumerate(zip(new, whole, strict=True)) if r is None and len(w) > LONG}
        count = np.ones(len(new), np.int64)
        count[rest] = sizes
        count[list(long)] = [len(x) for x in long.values()]
        begin = self.used + np.cumsum(count) - count
        total = int(count.sum())
        while self.used + total > len(self.table):
            self.table = np.append(self.table, np.zeros(len(self.table), np.uint32))
        single = np.array([k for k, r in enumerate(whole) if r is not None], np.int64)
        self.table[begin[single]] = [r for r in whole if r is not None]
        if rest:
            self.table[ranges(begin[rest], sizes)] = ids
        for k, x in long.items():
            self.table[begin[k] : begin[k] + len(x)] = x
        self.begin = np.append(self.begin, begin + count)
        self.used += total

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows in them, byte at which each id begins) for UTF-8 rows."""
        starts = boundaries(data, offsets)
        at = np.append(starts, len(data)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        part, edges = flat(column.dictionary)
        code, h = self.known.find(part, edges[:-1], edges[1:])
        new = np.flatnonzero(code < 0)
        if self.known.count + len(new) > CACHE or self.known.used + int((edges[new + 1] - edges[new]).sum()) > CACHE_BYTES:
            self.forget()
            new = np.arange(len(code))
        if len(new):
            self.learn([x.as_py() for x in column.dictionary.take(pa.array(new))])
            code[new] = self.known.add(part, edges[new], edges[new + 1], h[new])
        code = code[column.indices.to_numpy()]
        sizes = self.begin[code + 1] - self.begin[code]
        ids = self.table[ranges(self.begin[code], sizes)]
        total = np.append(0, np.cumsum(sizes))
        width = self.size[ids]
        return ids, total[np.searchsorted(starts, offsets)], np.cumsum(width) - width

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``."""
        return self.bytes[ranges(self.start[ids], self.size[ids])]


@cache
def codec(path: str) -> Codec:
    """One codec per worker process and file, kept between tasks."""
    return Codec(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the ids of its whole text as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, data, offsets in text_blocks(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
                ids, at, _ = codec(path).encode(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text for rows of ``encoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            texts = [bytes(codec(path).decode(np.asarray(x.values, dtype=np.int64))).decode("utf-8", "replace") if x.is_valid else "" for x in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of tokens and digests of the ids and of the bytes decoded from them, without storing either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, data, offsets in text_blocks(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
                c = codec(path)
                ids, at, begin = c.encode(data, offsets)
                back, begin = memoryview(c.decode(ids)), np.append(begin, c.size[ids].sum())
                raw, ends = memoryview(ids.astype("<u4").tobytes()), begin[at]
                sha = lambda view, bounds, width: [hashlib.sha256(view[i * width : j * width]).hexdigest() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(sha(raw, at, 4)), pa.array(sha(back, ends, 1))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(doc_id, text).mapInArrow(run, SCHEMA)
