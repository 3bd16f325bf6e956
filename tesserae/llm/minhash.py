"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

Each document's set of word shingles gets ``CHUNKS * WIDTH`` b-bit MinHash symbols. Two sets whose
similarity reaches the threshold differ in few symbols: all but a vanishing part of such pairs
(``miss_probability``) stay under ``ERRORS`` differing symbols. By the pigeonhole principle a pair
with at most ``ERRORS`` = 2 * CHUNKS - 1 errors has a chunk with at most one, so each chunk is indexed
once for every symbol that may be wrong, which guarantees every pair under that distance. Candidates
are then confirmed on the full shingle sets.

Documents with equal sets are one class before any comparison; groups of copies are connected through
hubs (see ``graph.links``), so no group is spelt out pairwise and no link between components is lost.

Defined cases: null, empty and blank texts have an empty set and no links; a text with fewer words
than a shingle is one shingle; repeated rows are linked; an empty table gives an empty result;
further columns are ignored; texts of any length are shingled whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.blocks import LOWER, mix, prefix_sums, slice_hashes, text_blocks, words
from tesserae.llm.graph import components, links, pack, runs_of_keys
from tesserae.llm.session import bucket_count, cut, hashed_semi

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
CHUNKS, WIDTH = 24, 4
SYMBOLS, ERRORS = CHUNKS * WIDTH, 2 * CHUNKS - 1
_random = np.random.default_rng(20)
FLIP = _random.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
FACTOR = _random.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)


def miss_probability(similarity: float, errors: int = ERRORS, symbols: int = SYMBOLS) -> float:
    """Probability that a pair of this similarity differs in more than ``errors`` symbols."""
    q = 1 - similarity
    return sum(math.comb(symbols, k) * q**k * similarity ** (symbols - k) for k in range(errors + 1, symbols + 1))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows one after the other, offsets of the rows in them)."""
    lower = LOWER[data]
    starts, ends, first = words(lower, offsets)
    counts = np.diff(first)
    h = slice_hashes(lower, starts, ends, prefix_sums(lower))
    rows = len(counts)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    begin = np.repeat(first[:-1] - np.cumsum(made) + made, made) + np.arange(made.sum())
    row, acc = np.repeat(np.arange(rows), made), np.zeros(len(begin), np.uint64)
    size = np.minimum(counts, k)[row]
    padded = np.append(h, np.zeros(k, np.uint64))
    for j in range(k):
        acc = np.where(j < size, mix(acc * np.uint64(0x9E3779B97F4A7C15) + padded[begin + j]), acc)
    order = np.lexsort((acc, row))
    acc, row = acc[order], row[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (row[1:] != row[:-1])
    acc, row = acc[new], row[new]
    return acc, np.searchsorted(row, np.arange(rows + 1))


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """rows x SYMBOLS MinHash symbols of 32 bits; rows of empty sets are zero."""
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(at) - 1, SYMBOLS), np.uint32)
    if len(full):
        buffer = np.empty_like(sets)
        for i in range(SYMBOLS):
            np.bitwise_xor(sets, FLIP[i], out=buffer)
            np.multiply(buffer, FACTOR[i], out=buffer)
            out[full, i] = np.minimum.reduceat(buffer, at[full]) >> np.uint64(32)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """rows x (CHUNKS * WIDTH) keys: each chunk without each of its symbols in turn."""
    parts = signature.reshape(len(signature), CHUNKS, WIDTH).astype(np.uint64)
    keys = np.empty((len(signature), CHUNKS, WIDTH), np.uint64)
    for left_out in range(WIDTH):
        acc = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(left_out + 1), (len(signature), CHUNKS)).copy()
        for j in range(WIDTH):
            if j != left_out:
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
        keys[:, :, left_out] = acc
    return keys.reshape(len(signature), -1)


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) of every document; set_key identifies the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, data, offsets in text_blocks(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
                sets, at = shingle_sets(data, offsets)
                sums = np.zeros((2, len(sets) + 1), np.uint64)
                np.cumsum(sets, out=sums[0, 1:])
                np.cumsum(mix(sets + np.uint64(0x51)), out=sums[1, 1:])
                ends = (sums[:, at[1:]] - sums[:, at[:-1]]).T.astype("<u8")
                sizes = np.diff(at)
                keys = [e.tobytes() + n.tobytes() for e, n in zip(ends, sizes.astype("<u8"), strict=True)]
                signature = signatures(sets, at)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in signature], pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def keyed(classes: DataFrame, buckets: int, batch_rows: int = 2048) -> DataFrame:
    """(bucket, blob) of all chunk keys of the classes; the load of an entry is its set size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                signature = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, SYMBOLS)
                keys = chunk_keys(signature)
                n = keys.shape[1]
                yield pack(keys.ravel(), np.repeat(batch.column(0).to_numpy(), n), np.repeat(batch.column(1).to_numpy(), n), buckets)

    return classes.select("doc_id", "n_shingles", "signature").mapInArrow(run, "bucket int, blob binary")


def near_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold."""
    return DENOMINATOR * np.minimum(a, b) >= NUMERATOR * np.maximum(a, b)


def enough(size: np.ndarray, sizes: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that share this many elements reach the threshold."""
    return DENOMINATOR * shared >= NUMERATOR * (size + sizes - shared)


def coded(sets: DataFrame) -> DataFrame:
    """(id, codes): the last 16 bits of every shingle hash, a quarter of the bytes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.frombuffer(x.as_buffer(), "<u2")[::4].tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["id", "codes"])

    return sets.select("id", "shingles").mapInArrow(run, "id long, codes binary")


def full_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, signature, shingles) with the whole sorted shingle set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, data, offsets in text_blocks(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
                sets, at = shingle_sets(data, offsets)
                raw, cuts = sets.tobytes(), (at * 8).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["id", "shingles"])

    return docs.select(doc_id, text).mapInArrow(run, "id long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity threshold."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if near_sizes(len(s), len(t)):
                    merged = np.sort(np.concatenate([s, t]), kind="stable")
                    common = int((merged[1:] == merged[:-1]).sum())
                    good[i] = DENOMINATOR * common >= NUMERATOR * (len(s) + len(t) - common)
            yield batch.select([0, 1]).filter(pa.array(good))

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; ids are distinct."""
    every = cut(signed(docs, doc_id, text))
    filled = every.where("n_shingles > 0")
    classes = cut(filled.groupBy("set_key").agg(F.min_by(F.struct("doc_id", "n_shingles", "signature"), "doc_id").alias("r")).select("set_key", "r.*"))
    runs = cut(runs_of_keys(keyed(classes, bucket_count(classes.count(), 4096)), near_sizes))
    candidates = runs.select("id").distinct()
    some, _ = hashed_semi(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", candidates, "id")
    sets = cut(full_sets(some.join(candidates.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")))
    held = links(runs, lambda pairs: confirm(pairs, sets), near_sizes, sketches=coded(sets), enough=enough)
    found = components(held)
    grouped = classes.select("set_key", F.col("doc_id").alias("node")).join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = every.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(grouped, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept"))
