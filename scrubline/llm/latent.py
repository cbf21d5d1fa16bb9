"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``2 * BLOCK`` words, half overlapping, over every whole text. A passage is a
TF-IDF vector over hashed words; document frequencies count all documents. The latent space is the
leading right singular vectors of all passages and all items, by randomised
subspace iteration: tasks multiply their passages with a thin matrix, sums are grouped by word on
the cluster, and only matrices of ``FEATURES`` rows reach the driver. All passages are projected,
centred and compared with all items, in blocks of items; a longer item is searched for by windows of its
own, of the same length. A candidate by cosine is checked by
the longest common subsequence with the whole item around the passage, weighted by the words' information,
and by the same share over the item's answer (its last sentence), which catches paraphrases that
keep most of the telling words in order.

Null and empty texts and items without a word match nothing. Copies of an item match separately;
an id that occurs twice gives a row for each of its rows. Extra columns are unread; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.session import stage_table

FEATURES = 1 << 15
RANK = 64
EXTRA = 8
BLOCK = 32
# telling words weigh more than in plain TF-IDF: the information to this power
IDF_POWER = 1.5
# beside the items, all passages together weigh as much as this many at most
PASSAGES_WEIGHT = 12_000
ITEM_WEIGHT = 30.0
MIN_COSINE = 0.65
MIN_SHARE = 0.6
MIN_ANSWER = 0.5
ITEMS_AT_ONCE = 5_000
# words and texts handled at a time
CHUNK = 25_000
# in the products, so that the rows of the words stay in a core's cache
PRODUCT_CHUNK = 8_000
DOCS_AT_ONCE = 256
MATCH = "doc_id long, item_id long, cosine double, share double, answer double, start int, stop int"
NOT_WORD = "[^\\p{L}\\p{N}]+"


def word_ids(text: Column) -> Column:
    """32-bit hashes of the words (runs of letters and digits, lower case)."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")
    # the low 32 bits, as a signed number
    return F.transform(found, lambda w: F.shiftright(F.shiftleft(F.xxhash64(w), 32), 32).cast("int"))


def item_words(text: str) -> tuple[np.ndarray, int]:
    """The same hashes for an item, and where its answer starts."""
    words, answer = [], 0
    for sentence in re.split(r"(?<=[.!?])\s+", text.strip()):
        found = re.findall(r"[^\W_]+", sentence.lower())
        if found:
            answer = len(words)
            words += found
    ids = np.array([xxhash.xxh64_intdigest(w.encode(), seed=42) & 0xFFFFFFFF for w in words], dtype=np.uint32)
    return ids, answer


def features(ids: np.ndarray) -> np.ndarray:
    return (ids.view(np.uint32) & np.uint32(FEATURES - 1)).astype(np.int64)


def _rows(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat word hashes, first place of each row and the end)"""
    sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def _pieces(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces of each text, the text of each piece, the number of each piece in its text)"""
    pieces = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    return pieces, doc, np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)


def _chunks(batches: Iterator[pa.RecordBatch], words: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(flat word hashes, first place of each text and the end) of some texts at a time"""
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_AT_ONCE):
            flat, starts = _rows(batch.column(0).slice(at, DOCS_AT_ONCE))
            low = 0
            while low < len(starts) - 1:
                high = max(low + 1, int(np.searchsorted(starts, starts[low] + words, side="right")) - 1)
                part = starts[low : high + 1]
                yield flat[part[0] : part[-1]], part - part[0]
                low = high


def frequencies(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """By word: how many documents hold it, and how often it is in a passage; and the number of passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, inside = np.zeros(FEATURES, dtype=np.int64), np.zeros(FEATURES + 1, dtype=np.int64)
        for flat, starts in _chunks(batches):
            f, sizes = features(flat), np.diff(starts)
            row = np.repeat(np.arange(len(sizes)), sizes)
            key = np.unique(row * FEATURES + f)
            total += np.bincount(key % FEATURES, minlength=FEATURES)
            # every piece but the first and the last of a text is in two passages
            pieces = -(-sizes // BLOCK)
            number = (np.arange(len(f)) - starts[row]) // BLOCK
            double = f[(number > 0) & (number < pieces[row] - 1)]
            inside[:FEATURES] += np.bincount(f, minlength=FEATURES) + np.bincount(double, minlength=FEATURES)
            inside[FEATURES] += np.where(pieces > 1, pieces - 1, pieces).sum()
        some = np.flatnonzero(inside)
        columns = [pa.array(some), pa.array(np.append(total, 0)[some]), pa.array(inside[some])]
        yield pa.RecordBatch.from_arrays(columns, names=["f", "n", "inside"])

    sums = tokens.select("ids").mapInArrow(count, "f long, n long, inside long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    df, inside = np.zeros(FEATURES), np.zeros(FEATURES + 1)
    for r in sums.collect():
        inside[r["f"]] = r["inside"]
        if r["f"] < FEATURES:
            df[r["f"]] = r["n"]
    return df, inside[:FEATURES], int(inside[FEATURES])


def _project(batch: pa.RecordBatch, idf: np.ndarray, thin: np.ndarray) -> tuple[np.ndarray, ...]:
    """(features, rows, values) of the normalised TF-IDF rows of a batch, and the rows times ``thin``."""
    weight = batch.column(0).to_numpy()
    flat, starts = _rows(batch.column(1))
    f, row = features(flat), np.repeat(np.arange(len(weight)), np.diff(starts))
    x = idf[f]
    norm = np.sqrt(np.bincount(row, x * x, len(weight)))
    x = x * (weight / np.where(norm > 0, norm, 1))[row]
    y = np.zeros((len(weight), thin.shape[1]))
    keep = np.diff(starts) > 0
    if len(f):
        y[keep] = np.add.reduceat(thin[f] * x[:, None], starts[:-1][keep], axis=0)
    return f, row, x, y


def _add_by_word(out: np.ndarray, f: np.ndarray, rows: np.ndarray, at: np.ndarray, x: np.ndarray | None = None) -> None:
    """``out[f] += rows[at] * x`` with all repeats; ``x`` is 1 if left out"""
    if len(f):
        # small keys are sorted by radix
        order = np.argsort(f.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.diff(f[order], prepend=-1))
        summands = rows[at[order]]
        if x is not None:
            summands = summands * x[order, None]
        out[f[order][first]] += np.add.reduceat(summands, first, axis=0)


def _piece_sums(padded: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The sum of the rows of each piece's words."""
    out = padded[word[:, 0]]
    for k in range(1, word.shape[1]):
        out += padded[word[:, k]]
    return out


def _summed(df: DataFrame, multiply, width: int) -> DataFrame:
    """The matrices (f, c0, c1...) of the tasks, to be summed by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((FEATURES, width))
        multiply(batches, out)
        some = np.flatnonzero(np.abs(out).sum(axis=1))
        columns = [pa.array(some), *(pa.array(out[some, c].astype(np.float32)) for c in range(width))]
        yield pa.RecordBatch.from_arrays(columns, names=["f", *(f"c{c}" for c in range(width))])

    return df.mapInArrow(run, "f long, " + ", ".join(f"c{c} float" for c in range(width)))


def gram_times(tokens: DataFrame, items: DataFrame | None, idf: np.ndarray, thin: np.ndarray, weight: float) -> np.ndarray:
    """``A' (A thin)`` for the rows A of all passages, times ``weight``, and of ``items``; summed by word on the cluster.

    Each task sends a matrix of ``FEATURES`` rows, so there are as many tasks as cores, whatever the number of texts.
    """
    width, spark = thin.shape[1], tokens.sparkSession
    padded = np.vstack([thin * idf[:, None], np.zeros((1, width))]).astype(np.float32)
    gain = np.append(idf, 0.0)

    def passages(batches: Iterator[pa.RecordBatch], out: np.ndarray) -> None:
        for flat, starts in _chunks(batches, PRODUCT_CHUNK):
            pieces, doc, number = _pieces(np.diff(starts))
            if not len(doc):
                continue
            f = features(flat)
            at = starts[doc] + number * BLOCK
            n = np.minimum(starts[doc + 1] - at, BLOCK)
            word = np.where(np.arange(BLOCK) < n[:, None], f[np.minimum(at[:, None] + np.arange(BLOCK), len(f) - 1)], FEATURES)
            summed = _piece_sums(padded, word)
            square = (gain[word] ** 2).sum(axis=1)
            # a passage is a piece and the next one; a text of one piece is one passage
            first = np.flatnonzero((number + 1 < pieces[doc]) | (pieces[doc] == 1))
            two = np.flatnonzero(pieces[doc[first]] > 1)
            y, norm = summed[first], square[first]
            y[two] += summed[first[two] + 1]
            norm[two] += square[first[two] + 1]
            y *= (weight**2 / np.where(norm > 0, norm, 1))[:, None]
            back = np.zeros_like(summed)
            back[first] += y
            back[first[two] + 1] += y[two]
            _add_by_word(out, f, back, np.repeat(np.arange(len(at)), n))
        # a word's weight is the same wherever it is
        out *= idf[:, None]

    def own(batches: Iterator[pa.RecordBatch], out: np.ndarray) -> None:
        for batch in batches:
            f, row, x, y = _project(batch, idf, thin)
            _add_by_word(out, f, y, row, x)

    tasks = spark.sparkContext.defaultParallelism
    sums = _summed(tokens.select("ids").coalesce(tasks), passages, width)
    if items is not None:
        sums = sums.unionByName(_summed(items.coalesce(1), own, width))
    found = sums.groupBy("f").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(width)]).toArrow()
    out = np.zeros((FEATURES, width))
    if found.num_rows:
        out[found["f"].to_numpy()] = np.column_stack([found[f"c{c}"].to_numpy() for c in range(width)])
    return out


def latent_space(times, rank: int = RANK, rounds: int = 2, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors, (FEATURES, rank), by randomised subspace iteration.

    ``times`` multiplies a thin matrix q with the Gram matrix G. The vectors are those of the last product's
    approximation ``(G q) (q' G q)^-1 (G q)'``, which needs no more passes over the passages.
    """
    q = np.random.default_rng(seed).normal(size=(FEATURES, rank + EXTRA))
    for _ in range(rounds):
        q = np.linalg.qr(q)[0]
        product = times(q)
        core, last, q = q.T @ product, product, product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    some = values > max(values.max(), 0) * 1e-6
    half = last @ (vectors[:, some] / np.sqrt(values[some]))
    values, vectors = np.linalg.eigh(half.T @ half)
    best = np.argsort(values)[::-1][:rank]
    best = best[values[best] > 0]
    out = np.zeros((FEATURES, rank))
    out[:, : len(best)] = half @ (vectors[:, best] / np.sqrt(values[best]))
    return out


def common_subsequence(item: np.ndarray, text: np.ndarray, weight: np.ndarray, answer: int) -> tuple[float, float]:
    """The heaviest common subsequence's share of the item's weight, and the same for its answer alone."""

    def heaviest(words: np.ndarray, w: np.ndarray) -> float:
        best = np.zeros(len(text) + 1)
        for x, gain in zip(words, w, strict=True):
            step = best.copy()
            at = np.flatnonzero(text == x)
            step[at + 1] = np.maximum(step[at + 1], best[at] + gain)
            best = np.maximum.accumulate(step)
        return float(best[-1])

    total, own = float(weight.sum()), float(weight[answer:].sum())
    share = heaviest(item, weight) / total if total > 0 else 0.0
    return share, heaviest(item[answer:], weight[answer:]) / own if own > 0 else 0.0


def item_windows(n: int) -> list[int]:
    """Where the windows of an item of ``n`` words start; one of up to ``2 * BLOCK`` words is one window."""
    return [0] if n <= 2 * BLOCK else list(range(0, n - BLOCK, BLOCK))


def item_blocks(queries: list[tuple]) -> Iterator[list[tuple]]:
    """The items in blocks of about ``ITEMS_AT_ONCE`` windows."""
    block, n = [], 0
    for q in queries:
        more = len(item_windows(len(q[1])))
        if block and n + more > ITEMS_AT_ONCE:
            yield block
            block, n = [], 0
        block.append(q)
        n += more
    if block:
        yield block


def _search(space: np.ndarray, idf: np.ndarray, centre: np.ndarray, items: list[tuple], limits: tuple[float, float, float]):
    """Match every passage of a task with a block of items: (item id, part, word hashes, answer start)."""
    min_cosine, min_share, min_answer = limits
    windows = [(i, at) for i, (_, ids, _) in enumerate(items) for at in item_windows(len(ids))]
    parts = [items[i][1][at : at + 2 * BLOCK] if len(items[i][1]) > 2 * BLOCK else items[i][1] for i, at in windows]
    vectors = np.array([space[features(x)].sum(axis=0) - len(x) * centre for x in parts], dtype=np.float32)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    weights = [idf[features(ids)] for _, ids, _ in items]
    # the weight of each different word of an item
    own: list[dict[int, float]] = []
    for (_, ids, _), w in zip(items, weights, strict=True):
        sums: dict[int, float] = {}
        for word, gain in zip(ids.tolist(), w.tolist(), strict=True):
            sums[word] = sums.get(word, 0.0) + gain
        own.append(sums)
    needed = [min_share * sum(x.values()) for x in own]
    padded = np.vstack([space, np.zeros((1, space.shape[1]), dtype=np.float32)])

    def matches(doc_ids: list, flat: np.ndarray, starts: np.ndarray) -> list[tuple]:
        sizes = np.diff(starts)
        pieces, doc, number = _pieces(sizes)
        at = starts[doc] + number * BLOCK
        if not len(at):
            return []
        # pieces of equal length, the last of a text filled up with a word of no weight
        n = np.minimum(starts[doc + 1] - at, BLOCK)
        place = at[:, None] + np.arange(BLOCK)
        word = np.where(np.arange(BLOCK) < n[:, None], features(flat)[np.minimum(place, len(flat) - 1)], FEATURES)
        summed = _piece_sums(padded, word)
        summed -= n[:, None].astype(np.float32) * centre
        # a passage is a piece and the next one; a text of one piece is one passage
        first = np.flatnonzero((number + 1 < pieces[doc]) | (pieces[doc] == 1))
        passage = summed[first]
        two = pieces[doc[first]] > 1
        passage[two] += summed[first[two] + 1]
        norm = np.linalg.norm(passage, axis=1, keepdims=True)
        cosine = (passage / np.maximum(norm, 1e-9)) @ vectors.T
        best: dict[tuple, tuple] = {}
        last, text, present = None, flat, set()
        for p, v in np.argwhere(cosine >= min_cosine):
            d, (i, at_item) = doc[first[p]], windows[v]
            begin, length = int(number[first[p]]) * BLOCK, len(items[i][1])
            # room for the whole item, and for words inserted into a longer one
            room = BLOCK + max(0, length - 2 * BLOCK) // 4
            low = max(0, begin - at_item - room)
            high = min(int(sizes[d]), begin + max(2 * BLOCK, length - at_item) + room)
            if (d, low, high) != last:
                last, text = (d, low, high), flat[starts[d] + low : starts[d] + high]
                present = set(text.tolist())
            # no common subsequence outweighs the common words
            if sum(w for word, w in own[i].items() if word in present) < needed[i]:
                continue
            item_id, ids, answer = items[i]
            share, told = common_subsequence(ids, text, weights[i], answer)
            if share >= min_share and told >= min_answer:
                row = (share, told, float(cosine[p, v]), -low, low, high)
                best[d, i] = max(best.get((d, i), row), row)
        return [(doc_ids[d], items[i][0], c, s, t, a, b) for (d, i), (s, t, c, _, a, b) in best.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in MATCH.split(", ")]
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            flat, starts = _rows(batch.column(1))
            low = 0
            while low < len(doc_ids):
                high = max(low + 1, int(np.searchsorted(starts, starts[low] + CHUNK, side="right")) - 1)
                part = starts[low : high + 1]
                found = matches(doc_ids[low:high], flat[part[0] : part[-1]], part - part[0])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names=names)
                low = high

    return run


def leaked(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_cosine: float = MIN_COSINE, min_share: float = MIN_SHARE, min_answer: float = MIN_ANSWER,
) -> DataFrame:
    """One row per document and item it contains: cosine, share, answer, and the words [start, stop) around it."""
    spark = docs.sparkSession
    tokens = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_ids(F.col(text_col)).alias("ids"))
    tokens = stage_table(tokens, "words")
    # the query set, stated by the caller; it is searched for block by block
    queries = []
    for r in items.select(F.col(item_id).cast("long"), F.col(item_text)).where(F.col(item_text).isNotNull()).toLocalIterator():
        ids, answer = item_words(r[1])
        if len(ids):
            queries.append((r[0], ids, answer))
    if not queries:
        return spark.createDataFrame([], MATCH)
    n_docs = tokens.count()
    df, inside, n_passages = frequencies(tokens)
    idf = np.log((n_docs + 1) / (df + 1)) ** IDF_POWER
    rows = spark.createDataFrame([(ITEM_WEIGHT, ids.view(np.int32).tolist()) for _, ids, _ in queries], "weight double, ids array<int>")
    weight = float(np.sqrt(min(1.0, PASSAGES_WEIGHT / max(1, n_passages))))
    space = (latent_space(lambda thin: gram_times(tokens, rows, idf, thin, weight)) * idf[:, None]).astype(np.float32)
    # the mean word of all passages
    centre = (inside @ space / max(1.0, inside.sum())).astype(np.float32)
    found = None
    for block in item_blocks(queries):
        search = _search(space, idf, centre, block, (min_cosine, min_share, min_answer))
        part = tokens.mapInArrow(search, MATCH)
        found = part if found is None else found.union(part)
    return found
