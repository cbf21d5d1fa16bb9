"""SentencePiece encoding and decoding with a given piece table, as a relational lattice.

A text is cut into units that no piece crosses: a run of blanks with the characters after it, and line
ends. Units that recur are counted over all documents. For the ``COMMON`` commonest, every substring up to the
longest piece is a row, an equi-join with the piece table keeps the edges of the lattice, edges are grouped by
unit, and a higher-order ``aggregate`` folds them into the best path (Viterbi: the largest sum of piece
scores). These paths go to every task, where each document becomes the sequence of its units' paths; the
other units, most of them seen in one place only, take the same fold there, many units at a time and once while a
task remembers them.
So neither texts nor paths are shuffled, and the work grows with the text.

A character that is no piece costs ``UNKNOWN`` less than the worst piece and becomes its UTF-8
bytes, so decoding gives the text back. Ties between paths go to the later start of the last
piece, then to the larger id. A unit of over ``LONG`` characters (text without blanks, long runs of blanks) is
never exploded.

Null and empty texts have no pieces. U+2581 in a text counts as a blank. Repeated rows are encoded
separately; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm.text import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# characters of a unit beyond which its substrings are no rows
LONG = 128
UNKNOWN = 10.0
# characters of the documents that are counted or put together at a time
BLOCK_CHARS = 5_000_000
MAX_PIECES = 1_000_000
UNIT = re.compile(r" *[^ \n]+| +|\n")
# units whose paths go to every task, and how often one block must hold them to be counted
COMMON, OFTEN = 50_000, 8
# characters of the documents, and of the units, that a task encodes at a time
TEXT_AT_ONCE, UNITS_AT_ONCE = 1_000_000, 200_000
# units that a task remembers
REMEMBERED = 300_000
FACTOR, HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(48)
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
IDS = "doc_id long, ids array<int>"


@dataclass
class PieceTable:
    """What the encoder needs of a model: at most ``MAX_PIECES`` pieces, so it may go to every task."""

    pieces: list[tuple[str, int, float]]  # text with blanks, id, score
    byte_ids: list[int]  # of the 256 bytes
    raw: list[bytes]  # what each id stands for

    @cached_property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @cached_property
    def unknown(self) -> float:
        return min(s for _, _, s in self.pieces) - UNKNOWN


def load(path: str = MODEL) -> PieceTable:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, raw = [], [0] * 256, []
    if model.get_piece_size() > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(BYTE.fullmatch(text)[1], 16)
            byte_ids[value] = i
            raw.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            text = text.replace("▁", " ")
            if re.search("[^ ] |\n", text):
                raise ValueError(f"piece {i} crosses units")
            pieces.append((text, i, model.get_score(i)))
            raw.append(text.encode())
    return PieceTable(pieces, byte_ids, raw)


# ---- units ----------------------------------------------------------------------


def units(text: str | None) -> list[str]:
    return UNIT.findall(" " + text.replace("▁", " ")) if text else []


def _recurring(block_chars: int):
    """(unit, n) of the units that a block of texts holds often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, chars = Counter(), 0

        def often() -> pa.RecordBatch:
            found = [(u, n) for u, n in seen.items() if n >= OFTEN and len(u) <= LONG]
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["unit", "n"])

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                seen.update(units(text))
                chars += len(text or "")
                if chars >= block_chars:
                    yield often()
                    seen, chars = Counter(), 0
        yield often()

    return run


# ---- the lattice ----------------------------------------------------------------


def edges(distinct: DataFrame, table: PieceTable) -> DataFrame:
    """(unit, start, stop, id, score): substrings of ``unit`` that are pieces, and single characters that aren't (id -1)."""
    spark = distinct.sparkSession
    rows = pa.table({"piece": [p for p, _, _ in table.pieces], "id": pa.array([i for _, i, _ in table.pieces], pa.int32()), "score": [s for _, _, s in table.pieces]})
    pieces = F.broadcast(spark.createDataFrame(rows, "piece string, id int, score double"))
    n = F.length("unit")
    starts = distinct.select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(table.longest), n - F.col("start")))
    parts = starts.select("unit", "start", F.explode(lengths).alias("size"))
    parts = parts.withColumn("piece", F.expr("substring(unit, start + 1, size)"))
    found = parts.join(pieces, "piece", "left").where("id is not null or size = 1")
    return found.select(
        "unit", "start", (F.col("start") + F.col("size")).alias("stop"),
        F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(table.unknown)).alias("score"),
    )


def best_paths(lattice: DataFrame) -> DataFrame:
    """(unit, path): the ids of the best path, -1 - start for an unknown character."""
    grouped = lattice.groupBy("unit").agg(F.collect_list(F.struct("stop", "start", "id", "score")).alias("edges"))
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start"), F.lit(-1).alias("id")))

    def step(best, stop):
        into = F.filter("edges", lambda e: e["stop"] == stop)
        tried = F.transform(
            into,
            lambda e: F.struct(
                (F.get(best, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("start"),
                F.when(e["id"] < 0, -1 - e["start"]).otherwise(e["id"]).alias("id"),
            ),
        )
        return F.concat(best, F.array(F.array_max(tried)))

    places = F.sequence(F.lit(1), F.length("unit"))
    grouped = grouped.withColumn("best", F.aggregate(places, first, step))
    end = F.struct(F.length("unit").alias("at"), F.array().cast("array<int>").alias("path"))

    def back(state, _):
        node = F.get("best", state["at"])
        more = F.struct(node["start"].alias("at"), F.concat(F.array(node["id"]), state["path"]).alias("path"))
        return F.when(state["at"] > 0, more).otherwise(state)

    return grouped.select("unit", F.aggregate(places, end, back)["path"].alias("path"))


def _with_bytes(paths: DataFrame, table: PieceTable) -> DataFrame:
    """Paths with unknown characters as the ids of their bytes; few units have one."""
    ids = F.array(*[F.lit(i) for i in table.byte_ids])
    place = lambda c, k: F.conv(F.substring(c, 2 * k + 1, 2), 16, 10).cast("int")

    def of(unit, p):
        text = F.hex(F.encode(F.substring(unit, -p, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1), lambda k: F.get(ids, place(text, k)))

    some = F.exists("path", lambda p: p < 0)
    expanded = F.flatten(F.transform("path", lambda p: F.when(p < 0, of(F.col("unit"), p)).otherwise(F.array(p))))
    return paths.select("unit", F.when(some, expanded).otherwise(F.col("path")).alias("path"))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def long_path(unit: str, known: dict[str, tuple[int, float]], table: PieceTable) -> list[int]:
    """The ids of the best path of one unit, in time and memory linear in its length."""
    longest, unknown = table.longest, table.unknown
    best, since, piece = array("d", [0.0]), array("q", [-1]), array("q", [-1])
    for stop in range(1, len(unit) + 1):
        top, at, chosen = -math.inf, -1, -1
        # on equal sums the later start
        for start in range(max(0, stop - longest), stop):
            hit = known.get(unit[start:stop])
            if hit:
                total = best[start] + hit[1]
                if total >= top:
                    top, at, chosen = total, start, hit[0]
            elif stop - start == 1:
                total = best[start] + unknown
                if total >= top:
                    top, at, chosen = total, start, -1 - start
        best.append(top)
        since.append(at)
        piece.append(chosen)
    out, at = array("i"), len(unit)
    while at > 0:
        if piece[at] >= 0:
            out.append(piece[at])
        else:
            out.extend(table.byte_ids[b] for b in reversed(unit[since[at]].encode()))
        at = since[at]
    return out[::-1].tolist()


class Lattice:
    """The same fold over many units at once: pieces found by hashes and compared, sums by the end of the last piece."""

    def __init__(self, table: PieceTable):
        self.table = table
        # by size: the high bits of the hashes that occur, the hashes, and the pieces in their order
        self.sizes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in range(1, table.longest + 1):
            # of equal pieces the last, as in a dictionary
            some = {p: (i, s) for p, i, s in table.pieces if len(p) == size}
            chars = code_points("".join(some)).reshape(len(some), size)
            h = np.zeros(len(some), dtype=np.uint64)
            for k in range(size):
                h = h * FACTOR + chars[:, k]
            order = np.argsort(h)
            if (np.diff(h[order]) == 0).any():
                raise ValueError("two pieces of one hash")
            ids = np.array([i for i, _ in some.values()], dtype=np.int32)
            scores = np.array([x for _, x in some.values()], dtype=np.float64)
            seen = np.zeros(1 << 16, dtype=bool)
            seen[(h * FACTOR) >> HIGH] = True
            self.sizes.append((seen, h[order], chars[order], ids[order], scores[order]))

    def edges(self, chars: np.ndarray, left: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By size of the piece that starts at each character: its id and its score, -inf without one; ``left`` is the rest of the unit."""
        ids, scores, h = [], [], np.zeros(len(chars), dtype=np.uint64)
        for size, (seen, known, pieces, piece_ids, piece_scores) in enumerate(self.sizes, 1):
            # no unit is as long
            if size > left.max():
                break
            last = size - 1
            h[: len(chars) - last] = h[: len(chars) - last] * FACTOR + chars[last:]
            at = np.flatnonzero(seen[(h * FACTOR) >> HIGH] & (left >= size))
            found, score = np.full(len(chars), -1, dtype=np.int32), np.full(len(chars), -np.inf)
            if len(known):
                place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
                hit = known[place] == h[at]
                at, place = at[hit], place[hit]
                same = (chars[at[:, None] + np.arange(size)] == pieces[place]).all(axis=1)
                found[at[same]], score[at[same]] = piece_ids[place[same]], piece_scores[place[same]]
            if size == 1:
                score[found < 0] = self.table.unknown
            ids.append(found)
            scores.append(score)
        return ids, scores

    def paths(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all units one after the other, how many each unit has); ``units`` are not empty and longest first."""
        n = np.array([len(u) for u in units])
        chars = code_points("".join(units))
        first = np.cumsum(n) - n
        ids, scores = self.edges(chars, np.repeat(first + n, n) - np.arange(len(chars)))
        # one place more than characters in a unit; by place the best sum, the size and the id of the last piece
        zero = first + np.arange(len(n))
        best, last, piece = np.zeros(len(chars) + len(n)), np.zeros(len(chars) + len(n), dtype=np.int64), np.full(len(chars) + len(n), -1, dtype=np.int32)
        for stop in range(1, n[0] + 1):
            some = int(np.searchsorted(-n, -stop, side="right"))
            top, chosen, which = np.full(some, -np.inf), np.zeros(some, dtype=np.int64), np.full(some, -1, dtype=np.int32)
            # on equal sums the later start
            for size in range(min(stop, len(ids)), 0, -1):
                total = best[zero[:some] + (stop - size)] + scores[size - 1][first[:some] + (stop - size)]
                more = np.flatnonzero((total >= top) & (total > -np.inf))
                top[more], chosen[more], which[more] = total[more], size, ids[size - 1][first[more] + (stop - size)]
            at = zero[:some] + stop
            best[at], last[at], piece[at] = top, chosen, which
        ends, at = np.zeros(len(best), dtype=bool), zero + n
        while len(at):
            ends[at] = True
            at = at - last[at]
            at = at[last[at] > 0]
        unit = np.repeat(np.arange(len(n)), n + 1)
        at = np.flatnonzero(ends)
        # a character that is no piece is its bytes
        unknown = np.flatnonzero(piece[at] < 0)
        texts = [chr(int(chars[x])).encode() for x in at[unknown] - unit[at[unknown]] - 1]
        width = np.ones(len(at), dtype=np.int64)
        width[unknown] = [len(x) for x in texts]
        out, place = np.repeat(piece[at], width), np.cumsum(width) - width
        for x, text in zip(place[unknown], texts, strict=True):
            out[x : x + len(text)] = [self.table.byte_ids[b] for b in text]
        return out, np.bincount(unit[at], width, len(n)).astype(np.int64)


# ---- documents ------------------------------------------------------------------


def common_paths(texts: DataFrame, table: PieceTable, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(unit, path) of at most ``COMMON`` units, the commonest among those that recur."""
    counted = texts.mapInArrow(_recurring(block_chars), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    common = counted.orderBy(F.desc("n"), "unit").limit(COMMON).select("unit")
    common = common.repartition(texts.sparkSession.sparkContext.defaultParallelism, "unit")
    return _with_bytes(best_paths(edges(common, table)), table)


class _Lexicon(dict):
    """Unit to its number; the path of number n is ``flat[starts[n] : starts[n + 1]]``."""

    def __init__(self, common: pa.Table, lattice: Lattice):
        super().__init__()
        self.lattice, self.known = lattice, {p: (i, s) for p, i, s in lattice.table.pieces}
        self.flat, self.starts = array("i"), array("q", [0])
        for unit, path in zip(common["unit"].to_pylist(), common["path"].to_pylist(), strict=True):
            self.add(unit, path)

    def learn(self, found: set[str]) -> None:
        """The paths of those units that are new and not long."""
        new = sorted((u for u in found if u not in self and len(u) <= LONG), key=len, reverse=True)
        total = np.cumsum([len(u) for u in new])
        low = 0
        while low < len(new):
            high = int(np.searchsorted(total, (total[low - 1] if low else 0) + UNITS_AT_ONCE)) + 1
            ids, counts = self.lattice.paths(new[low:high])
            self.update(zip(new[low:high], range(len(self), len(self) + len(counts)), strict=True))
            self.starts.frombytes((len(self.flat) + np.cumsum(counts)).tobytes())
            self.flat.frombytes(ids.tobytes())
            low = high

    def add(self, unit: str, path: list[int]) -> int:
        self[unit] = n = len(self)
        self.flat.extend(path)
        self.starts.append(len(self.flat))
        return n

    def __missing__(self, unit: str) -> int:
        return self.add(unit, long_path(unit, self.known, self.lattice.table))


def _assemble(doc_ids: list, counts: list[int], sequence: np.ndarray, lexicon: _Lexicon) -> pa.RecordBatch:
    """Documents as the paths of their units, given by number."""
    flat, starts = np.array(lexicon.flat, dtype=np.int32), np.array(lexicon.starts)
    count = starts[sequence + 1] - starts[sequence]
    total = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(total[-1]) + np.repeat(starts[sequence] - total[:-1], count)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    ids = pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(flat[at]))
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), ids], names=["doc_id", "ids"])


def _encode(common: pa.Table, table: PieceTable, chars_at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(table)
        lexicon = _Lexicon(common, lattice)
        doc_ids, found, chars = [], [], 0

        def encoded() -> pa.RecordBatch:
            lexicon.learn(set().union(*found))
            counts = [len(x) for x in found]
            sequence = np.fromiter(map(lexicon.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=sum(counts))
            return _assemble(doc_ids, counts, sequence, lexicon)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                doc_ids.append(doc_id.as_py())
                found.append(units(text))
                chars += len(text or "")
                if chars >= chars_at_once:
                    yield encoded()
                    doc_ids, found, chars = [], [], 0
                    if len(lexicon) > REMEMBERED:
                        lexicon = _Lexicon(common, lattice)
        if doc_ids:
            yield encoded()

    return run


def encode(docs: DataFrame, table: PieceTable, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id and ids."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # bounded by COMMON
    common = common_paths(base.select("text"), table, block_chars).toArrow()
    return base.mapInArrow(_encode(common, table, min(block_chars, TEXT_AT_ONCE)), IDS)


def decode(df: DataFrame, table: PieceTable, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with the text of its ids; null ids give null, ids of no piece give nothing."""
    raw = table.raw

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for row in batch:
                if not row.is_valid:
                    out.append(None)
                    continue
                ids = row.values.drop_null().to_numpy()
                data = b"".join(map(raw.__getitem__, ids[(ids >= 0) & (ids < len(raw))].tolist()))
                text = data.decode("utf-8", errors="replace")
                out.append(text[1:] if text[:1] == " " else text)
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(text_col, F.arrow_udf(run, "string")(F.col(ids_col)))


def encode_table(spark: SparkSession, docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_pieces and the number of characters that they decode to."""
    table = load(model)
    out = decode(encode(docs, table), table)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.length("text").cast("long").alias("decoded_chars"))
