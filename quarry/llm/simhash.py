"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. A segment is decoded in the binary Golay code (23, 12, 7):
its keys are the 12-bit indices of all codewords within four bits (one codeword, or six). Two segments that differ in
at most two bits share a key, always. Four differing bits over three segments leave (pigeonhole) either a segment without
errors next to one with at most two, or no segment with more than two. So these keys lose no pair:

    exact bits of segment i and an index of segment j, for i != j        (33 bits, about 32 keys)
    an index of each segment                                             (36 bits, about 150 keys)

Fingerprints, not documents, get keys: copies are one fingerprint. One shuffle deals (key, node) by key; the workers compare the
members of a bucket with one another by their differing bits and give a forest of links, in which links that a task has
told already are left out; components come from the links. No row leaves a worker for a pair, nor for a member of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.buckets import bucket_pairs, components, with_roots
from quarry.llm.common import forget, map_rows, save

SEGMENTS = ((0, 22), (22, 21), (43, 21))
ERRORS = 4
# Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code.
GENERATOR = 0b101011100011
SHINGLE_WORDS = 4
SEED = 42


# -- fingerprints ---------------------------------------------------------------------------------------------


def shingles(text: str | None, k: int) -> list[bytes]:
    """All k-word shingles of the ASCII-lower-cased text, repeats included; with fewer words the whole sequence."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [joined[starts[i] : ends[i + k - 1]] for i in range(len(words) - k + 1)]


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the 64-bit hashes; 0 without any. Signed."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(features: list[bytes], seed: int = SEED) -> int:
    """The majority of the features' XXH64."""
    return majority(np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in features), np.uint64, len(features)))


# -- Golay keys -----------------------------------------------------------------------------------------------


def syndrome(v: int) -> int:
    for b in range(22, 10, -1):
        if v >> b & 1:
            v ^= GENERATOR << (b - 11)
    return v


class Golay:
    """Tables: the syndrome of 23 bits in two parts, and the error patterns of up to four bits with each syndrome."""

    def __init__(self):
        low = np.arange(1 << 11)
        unit = np.array([syndrome(1 << b) for b in range(23)])
        high = np.zeros(1 << 12, np.int64)
        for b in range(12):
            high ^= np.where(np.arange(1 << 12) >> b & 1, unit[11 + b], 0)
        self.low, self.high = low, high
        patterns: list[list[int]] = [[] for _ in range(1 << 11)]
        errors = [(0, 0, -1)]
        for pattern, syn, last in errors:  # grows while it is read
            patterns[syn].append(pattern)
            if pattern.bit_count() < 4:
                errors += [(pattern | 1 << b, syn ^ int(unit[b]), b) for b in range(last + 1, 23)]
        self.patterns = np.full((1 << 11, 6), -1, np.int64)
        for syn, own in enumerate(patterns):
            self.patterns[syn, : len(own)] = own

    def indices(self, v: np.ndarray) -> np.ndarray:
        """(n, 6) codeword indices within four bits of each value; -1 where there are fewer."""
        e = self.patterns[self.low[v & 0x7FF] ^ self.high[v >> 11]]
        return np.where(e < 0, -1, (v[:, None] ^ e) >> 11)


def keys_of(fps: np.ndarray, golay: Golay, triple: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of signed fingerprints; without ``triple`` those of a segment's exact bits with an index alone."""
    u = fps.astype(np.int64).view(np.uint64)
    parts = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    index = [golay.indices(p) for p in parts]
    rows, keys = [], []
    family = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                r, m = np.nonzero(index[j] >= 0)
                rows.append(r)
                keys.append(family << 40 | parts[i][r] << 12 | index[j][r, m])
                family += 1
    if triple:
        ok = (index[0][:, :, None, None] >= 0) & (index[1][:, None, :, None] >= 0) & (index[2][:, None, None, :] >= 0)
        r, a, b, c = np.nonzero(ok)
        rows.append(r)
        keys.append(6 << 40 | index[0][r, a] << 24 | index[1][r, b] << 12 | index[2][r, c])
    return np.concatenate(rows), np.concatenate(keys)


def golay_keys(nodes: DataFrame, fp: str = "node", *, triple: bool = True) -> DataFrame:
    """(key, node) of rows with a node and a fingerprint."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in batches:
            node, prints = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at in range(0, len(node), 2000):  # a few hundred keys a row
                r, k = keys_of(prints[at : at + 2000], golay, triple)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(node[at + r])], ["key", "node"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.select("node", F.col(fp).alias("fp")).repartition(parts).mapInArrow(emit, "key long, node long")


def close(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Whether fingerprints link."""
    return np.bitwise_count((x[0] ^ y[0]).view(np.uint64)) <= ERRORS


# -- the operator ---------------------------------------------------------------------------------------------


def simhash_components(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: fingerprints within four bits are linked.

    Null and wordless texts have fingerprint zero, linked like any other. component_id is the smallest id that links reach;
    null ids are no candidates for it (null if all are). Repeated rows are kept. An empty table gives an empty result.
    Other columns, whatever their names, are not read.
    """
    df = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))

    def prints():
        return lambda texts: [[fingerprint(shingles(t, shingle_words)) for t in texts]]

    rows = save(map_rows(df, [df["text"]], ["doc_id"], "fp long", prints), compact=True)
    nodes = save(rows.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("first")), compact=True)
    links = bucket_pairs(golay_keys(nodes), close, true=True)
    roots = components(links)
    of = with_roots(nodes, roots)
    smallest = of.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = save(of.join(smallest, "root").select("node", "component_id"), compact=True)
    forget(links, roots, nodes)
    return rows.join(ids, rows.fp == ids.node).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
