"""Windows of texts that may be keys, found by a filter of fixed size before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, as powers of two; the largest is 16 MB, which is all that the driver and a worker ever hold.
LEAST_BITS, MOST_BITS = 16, 27
#: Characters of texts that are hashed at a time.
PIECE = 1 << 20
PRIME = 0x9E3779B97F4A7C15


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n code points, from those of runs of powers of two."""
    h, size, done, out = codes.astype(np.uint64), 1, 0, None
    m = max(len(codes) - n + 1, 0)
    power = lambda k: np.uint64(pow(PRIME, k, 1 << 64))
    while True:
        if n & size:
            part = h[done : done + m]
            out = part if out is None else out + part * power(done)
            done += size
        if size * 2 > n:
            break
        h = h[:-size] + h[size:] * power(size) if len(h) > size else h[:0]
        size *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in a filter."""
    low = np.uint64((1 << bits) - 1)
    return h & low, (h >> np.uint64(64 - bits)) & low


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def key_filter(keys: DataFrame, column: str = "key") -> tuple[np.ndarray, int, list[int]]:
    """(words, bits, sizes): a filter of keys (no null or empty one) and the lengths they have.

    Two bits are set for each key, 16 places a key as long as they fit the largest filter; tasks send the words that they
    set, the words are merged by a group, and a word a row reaches the driver, however many keys there are."""
    own = keys.select(F.col(column).alias("key"))
    sizes = {r["size"]: r["n"] for r in own.groupBy(F.length("key").alias("size")).agg(F.count("*").alias("n")).collect()}
    bits = min(max(LEAST_BITS, (16 * sum(sizes.values())).bit_length()), MOST_BITS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            of_size: dict[int, list[str]] = {}
            for k in batch.column(0).to_pylist():
                of_size.setdefault(len(k), []).append(k)
            for n, ks in of_size.items():
                for at in places(hashes(codes_of("".join(ks)), n)[::n], bits):
                    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        for i in range(0, len(words), 1 << 16):
            used = np.flatnonzero(words[i : i + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array((used + i).astype(np.int32)), pa.array(words[used + i].view(np.int64))], ["word", "value"])

    got = own.mapInArrow(run, "word int, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got.column("word").to_numpy()] = got.column("value").to_numpy().view(np.uint64)
    return words, bits, sorted(sizes)


def key_windows(df: DataFrame, ident: str, text: str, found: tuple[np.ndarray, int, list[int]]) -> DataFrame:
    """(ident, key): the distinct windows of each text that pass the filter: all that are keys, and a few in a hundred of the
    others, so the equi join with the keys moves about as many rows as there are hits."""
    words, bits, sizes = found
    shared = df.sparkSession.sparkContext.broadcast(words)

    def pieces(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
        held, size = [], 0
        for row, x in enumerate(texts):
            for i in range(0, len(x or ""), PIECE):
                held.append((row, x[i : i + PIECE + max(sizes, default=1) - 1]))
                size += len(held[-1][1])
                if size >= PIECE:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        passes = lambda at: (own[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        for batch in batches:
            for held in pieces(batch.column(1).to_pylist()):
                ends = np.cumsum([len(x) for _, x in held])
                codes, hits = codes_of("".join(x for _, x in held)), set()
                for n in sizes:
                    h = hashes(codes, n)
                    at = np.flatnonzero(passes(places(h, bits)[0]))
                    at = at[passes(places(h[at], bits)[1])]
                    which = np.searchsorted(ends, at, "right")
                    whole = at + n <= ends[which]
                    for w, i in zip(which[whole].tolist(), at[whole].tolist()):
                        row, x = held[w]
                        i -= int(ends[w]) - len(x)
                        hits.add((row, x[i : i + n]))
                if hits:
                    rows, keys = zip(*hits)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(keys, pa.string())], [ident, "key"])

    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, key string")
