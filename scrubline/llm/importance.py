"""Importance resampling towards a target: hashed runs of words, gains of their buckets, Gumbel top-k.

A run's bucket is the CRC-32 of its bytes. A CRC is linear over bits: apart from a constant for the length it is the XOR
of one contribution for each byte, which depends on the byte and its distance from the end alone. So all runs of a
block of text are hashed at once: contributions are looked up in a table of byte by distance and folded span by span
with ``bitwise_xor.reduceat``. Runs longer than the table fold block by block, the register being carried over a
block of zero bytes by four lookups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.text import stage_sorted
from scrubline.session import stage_table

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
# bytes that the position table covers, and bytes of text hashed at once
SPAN = 64
BLOCK = 1 << 20

# ---- CRC-32 of many spans ---------------------------------------------------------


def _byte_table() -> np.ndarray:
    """CRC-32 register after one byte, for the reflected polynomial of zip and gzip."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (x & np.uint32(1)))
    return x


_BYTE = _byte_table()


def _zeros(state: np.ndarray, n: int) -> np.ndarray:
    """Registers after ``n`` zero bytes."""
    for _ in range(n):
        state = (state >> np.uint32(8)) ^ _BYTE[state & np.uint32(255)]
    return state


def _position_table() -> np.ndarray:
    """Contribution of a byte at each distance from the end, at distance * 256 + byte."""
    rows = [_BYTE]
    for _ in range(SPAN - 1):
        rows.append(_zeros(rows[-1], 1))
    return np.concatenate(rows)


_AT = _position_table()
# the register after n zero bytes from its start value: what the length alone contributes
_LENGTH = np.array([_zeros(np.array([0xFFFFFFFF], dtype=np.uint32), n)[0] for n in range(SPAN + 1)], dtype=np.uint32)
# a register's bytes, carried over a whole block of zero bytes
_CARRY = np.stack([_zeros(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), SPAN) for k in range(4)])


def _carried(state: np.ndarray) -> np.ndarray:
    out = _CARRY[0][state & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ _CARRY[k][(state >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _folded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR of the contributions of spans of 1 to ``SPAN`` bytes."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    place = np.arange(ends[-1]) if len(ends) else np.zeros(0, dtype=np.int64)
    byte = data[place + np.repeat(starts - begins, lengths)]
    away = np.repeat(ends - 1, lengths) - place
    return np.bitwise_xor.reduceat(_AT[away * 256 + byte], begins) if len(ends) else np.zeros(0, dtype=np.uint32)


def crc32_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans of a byte array; spans may overlap, and have a byte at least."""
    blocks = (lengths - 1) // SPAN
    head = lengths - blocks * SPAN
    state = _LENGTH[head] ^ _folded(data, starts, head)
    at = starts + head
    live = np.flatnonzero(blocks)
    done = 0
    while len(live):
        state[live] = _carried(state[live]) ^ _folded(data, at[live], np.full(len(live), SPAN))
        at[live] += SPAN
        done += 1
        live = live[blocks[live] > done]
    return ~state


# ---- runs of words ------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# ASCII digits and letters, and every byte of a character beyond ASCII
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


class Runs:
    """Buckets of all runs of 1 to ``n`` words of one block, and the text each belongs to."""

    def __init__(self, data: np.ndarray, borders: np.ndarray, since: int, n: int, buckets: int):
        """``borders`` are the ends of the block's texts; runs that end by ``since`` were counted before."""
        low = _LOWER[data]
        inside = _IN_WORD[low]
        # a word goes on where the byte before is in a word and no text begins between them
        joined = np.zeros(len(low), dtype=bool)
        joined[1:] = inside[1:] & inside[:-1]
        firsts = borders[borders < len(low)]
        joined[firsts] = False
        starts = np.flatnonzero(inside & ~joined)
        goes_on = np.zeros(len(low), dtype=bool)
        goes_on[:-1] = joined[1:]
        ends = np.flatnonzero(inside & ~goes_on) + 1
        text = np.searchsorted(borders, starts, side="right")
        fresh = ends > since
        self.words = text[fresh]
        found, owner = [crc32_spans(low, starts[fresh], (ends - starts)[fresh])], [self.words]
        if n > 1:
            # the words again with one blank between them
            sizes = ends - starts + 1
            stops = np.cumsum(sizes)
            at = stops - sizes
            packed = np.full(int(stops[-1]) if len(stops) else 0, 32, dtype=np.uint8)
            place = np.arange(int((sizes - 1).sum()))
            shift = np.repeat(starts - (np.cumsum(sizes - 1) - (sizes - 1)), sizes - 1)
            into = np.repeat(at - (np.cumsum(sizes - 1) - (sizes - 1)), sizes - 1)
            packed[place + into] = low[place + shift]
            for m in range(2, n + 1):
                first, last = np.arange(max(len(starts) - m + 1, 0)), np.arange(m - 1, max(len(starts), m - 1))
                same = (text[first] == text[last]) & fresh[last]
                first, last = first[same], last[same]
                found.append(crc32_spans(packed, at[first], stops[last] - 1 - at[first]))
                owner.append(text[first])
        self.bucket = (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)
        self.text = np.concatenate(owner)


def _blocks(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(from, to, since, first text, last text + 1): bytes of whole texts, or of one long text cut between words.

    Blocks of a cut text overlap by n - 1 words, so that no run is lost; ``since`` says where the new words begin.
    """
    i, texts = 0, len(offsets) - 1
    while i < texts:
        j = max(int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1, i + 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= BLOCK or j > i + 1:
            yield lo, hi, lo, i, j
        else:
            start = since = lo
            while since < hi:
                cut = min(since + BLOCK, hi)
                while cut < hi and _IN_WORD[_LOWER[data[cut]]]:
                    cut += 1
                yield start, cut, since, i, j
                start, since = _words_back(data, lo, cut, n - 1), cut
        i = j


def _words_back(data: np.ndarray, lo: int, at: int, n: int) -> int:
    """Where the ``n``-th last word before ``at`` begins."""
    for _ in range(n):
        while at > lo and not _IN_WORD[_LOWER[data[at - 1]]]:
            at -= 1
        while at > lo and _IN_WORD[_LOWER[data[at - 1]]]:
            at -= 1
    return at


def _runs(texts: pa.Array, n: int, buckets: int) -> Iterator[tuple[int, int, Runs]]:
    """(first text, last text + 1, runs) of the blocks of a batch; null texts are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    for lo, hi, since, i, j in _blocks(data, offsets, n):
        yield i, j, Runs(data[lo:hi], offsets[i + 1 : j + 1] - lo, since - lo, n, buckets)


# ---- corpus ----------------------------------------------------------------------------


def bucket_counts(df: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket in all texts: one histogram leaves each task, ``buckets`` sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, runs in _runs(batch.column(0), n, buckets):
                total += np.bincount(runs.bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    found = df.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    size, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((int(t) + 1) * (all_source + size) / ((int(s) + 1) * (all_target + size))))
            for s, t in zip(source, target, strict=True)
        ],
        dtype=np.int64,
    )


def weigh(docs: DataFrame, gain: np.ndarray, n: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            words, features, weight = (np.zeros(rows, dtype=np.int64) for _ in range(3))
            for i, j, runs in _runs(batch.column(1), n, len(gain)):
                words[i:j] += np.bincount(runs.words, minlength=j - i)
                features[i:j] += np.bincount(runs.text, minlength=j - i)
                np.add.at(weight, runs.text + i, gain[runs.bucket])
            arrays = [batch.column(0), *(pa.array(x) for x in (words, features, weight))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(weights, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; the rank is null for documents not drawn.

    ``docs`` has doc_id and text, ``target`` text; other columns are ignored. The draw is without replacement, in
    proportion to exp(weight / 1000): Gumbel noise from a hash of the id is added to the weight, and of the N documents
    of at least ``MIN_WORDS`` words the floor(percent * N / 100) highest scores are drawn, ties to the smaller id. Null
    and empty texts have no features and weight 0. A document without an id has no score, is never drawn and does not
    count in N. Rows that repeat an id are documents of their own with the same noise; equal rows get ranks in any
    order. Where the target is empty the gains are those of its smoothing alone. Texts of any length are hashed whole.
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10)
    noise = (noise.cast("long").cast("double") + 0.5) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(F.log(-F.log(noise)) * -1000)
    scored = stage_table(weigh(docs, gain, n).withColumn("score", score), "scores")
    able = (F.col("n_words") >= MIN_WORDS) & F.col("doc_id").isNotNull()
    drawn = scored.where(able).count() * percent // 100
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    ranked = stage_sorted(scored.where(able), order)
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    out = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, rank.alias("rank")).unionByName(rest)
