"""Character similarity, near-duplicate rows and near-duplicate categories.

The similarity of two texts is ``round(100 * 2 * LCS / (len1 + len2))``: insertions and
deletions only. Two texts at or above a threshold must share one of their rarest
q-grams (a prefix filter on gram multisets), so candidate pairs come from equi-joins on
grams. No pair is lost by the filter, and none is decided without its exact similarity.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.text import strip
from scrubline.operators.lookup import SALTS, ValueTable
from scrubline.operators.steps import Step, col
from scrubline.session import stage_table

# texts of the first batch of the greedy grouping; how many times the leaders of a batch the next one holds
FIRST_BATCH = 1024
GROWTH = 8
# texts, and their characters, that travel to every task to be compared with all others there
DIRECT_TEXTS = 4096
DIRECT_CHARS = 4_000_000
# comparisons that are made there even if no crowd would end them early
DIRECT_PAIRS = 20_000_000
# words of masks that the leaders step over; up to these, comparing them with all texts costs no more than filing the texts in blocks
DIRECT_WORDS = 8192
# leaders that absorb so many texts each, and at least 1/CROWD_SHARE of all later texts, stand in a crowd
CROWD_EACH = 8
CROWD_SHARE = 16
# texts of a crowd, and their characters, that one task settles; its work there, in about nanoseconds, at most and for a text
CROWD_TEXTS = 262_144
CROWD_CHARS = 8_000_000
CROWD_WORK = 10_000_000_000
CROWD_WORK_EACH = 50_000
# texts that are sorted, and characters that are compared, together in a task; texts of a bunch; bytes of masks kept
SORTED_TEXTS = 65_536
SORTED_CHARS = 2_000_000
BUNCH_TEXTS = 4096
MASK_BYTES = 64_000_000
# rows of a block that one task pairs up; tasks that the comparisons of one text are spread over
BLOCK_ROWS = 4096
PAIR_SALTS = 8
# graphs of up to this number of edges are settled in one pass over the sorted ids
DRIVER_EDGES = 200_000
# grams whose frequency is known to every task; the rest count as rare
KNOWN_GRAMS = 50_000


# ---- pairwise ratio -------------------------------------------------------------


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one big-integer step per character of ``b``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> int:
    total = len(a) + len(b)
    if total == 0:
        return 100
    if a == b:
        return 100
    return int(round(200.0 * lcs_length(a, b) / total))


@F.pandas_udf(T.IntegerType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)],
        dtype="Int32",
    )


def similarity(a: Column, b: Column) -> Column:
    """Similarity of two text columns, 0 to 100."""
    return F.when(a == b, F.lit(100)).otherwise(_ratio_udf(a, b))


def token_sorted(c: Column) -> Column:
    """Lower-case words in sorted order; every other character is a separator."""
    words = F.split(F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")), " +")
    return F.array_join(F.array_sort(words), " ")


def token_sort_similarity(a: Column, b: Column) -> Column:
    return similarity(token_sorted(a), token_sorted(b))


# ---- candidate blocks -----------------------------------------------------------


class Blocker:
    """Block keys such that any two texts at or above ``threshold`` share one.

    With t = threshold - 0.5 percent, LCS >= t/2 * (l1 + l2). Deleting one character of a
    text destroys at most q of its q-grams and inserting one between them at most q - 1,
    which bounds how many grams of a text can be missing from the other. One more gram
    than that, taken in a global order, must contain a shared gram.

    Lengths of similar texts differ by a bounded factor, so keys also carry a length
    class; a text is filed under its own class and the next.
    """

    def __init__(self, threshold: int, rank: dict[str, int]):
        self.t = (threshold - 0.5) / 100
        self.shrink = self.t / (2 - self.t)
        self.rank = rank
        # both depend on few different numbers
        self.destroyed = lru_cache(maxsize=100_000)(self.destroyed)
        self.gram_size = lru_cache(maxsize=10_000)(self.gram_size)

    def length_class(self, n: int) -> int:
        return math.floor(math.log(n) / -math.log(self.shrink) + 1e-9) if n else -1

    def destroyed(self, n: int, q: int) -> int:
        """Most grams of a text of length n that a similar text can lack."""
        worst = 0.0
        for other in (max(1, math.ceil(n * self.shrink - 1e-9)), math.floor(n / self.shrink + 1e-9)):
            lcs = max(1.0, self.t * (n + other) / 2 - 1e-9)
            worst = max(worst, q * (n - lcs) + (q - 1) * (other - lcs))
        return math.floor(worst + 1e-9)

    def gram_size(self, length_class: int) -> int:
        """Longest gram whose prefix always fits texts filed under this class."""
        shortest = max(1, math.floor((1 / self.shrink) ** (length_class - 1) - 1e-9))
        for q in (4, 3, 2):
            lengths = range(shortest, shortest + 64)
            if all(self.destroyed(n, q) + 1 <= n - q + 1 for n in lengths):
                return q
        return 1

    def keys(self, s: str) -> list[tuple[str, int, int]]:
        """(key, gram length, place of the gram in the global order) of every block of a text."""
        if not s:
            return []
        own = self.length_class(len(s))
        out = []
        for cls in (own, own + 1):
            q = self.gram_size(cls)
            seen: Counter[str] = Counter()
            grams = []
            for i in range(len(s) - q + 1):
                g = s[i : i + q]
                seen[g] += 1
                grams.append((self.rank.get(f"{q}{g}", 0), seen[g], g))
            # rare grams first; repeats of a gram are rarer than its first occurrence
            grams.sort(key=lambda x: (x[0] // x[1], x[2], x[1]))
            kept = grams[: self.destroyed(len(s), q) + 1]
            out += [(f"{cls}|{g}|{k}", q, place) for place, (_, k, g) in enumerate(kept)]
        return out


def _gram_counts(texts: DataFrame, threshold: int) -> dict[str, int]:
    """Frequency of the commonest grams (a bounded head; it only orders the grams)."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocker = Blocker(threshold, {})
        for pdf in batches:
            count: Counter[str] = Counter()
            for s in pdf["s"]:
                own = blocker.length_class(len(s))
                for q in {blocker.gram_size(own), blocker.gram_size(own + 1)}:
                    count.update({f"{q}{s[i : i + q]}" for i in range(len(s) - q + 1)})
            yield pd.DataFrame({"g": list(count), "n": list(count.values())})

    found = texts.select("s").mapInPandas(grams, "g string, n long")
    head = found.groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(KNOWN_GRAMS)
    return {r["g"]: r["n"] for r in head.collect()}


def _file_in_blocks(texts: DataFrame, threshold: int) -> DataFrame:
    """(key, id, len, q, place): every block a text belongs to, and where its gram stands there."""
    rank = texts.sparkSession.sparkContext.broadcast(_gram_counts(texts, threshold))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocker = Blocker(threshold, rank.value)
        for pdf in batches:
            found = [blocker.keys(s) for s in pdf["s"]]
            counts = [len(ks) for ks in found]
            yield pd.DataFrame(
                {
                    "key": [k for ks in found for k, _, _ in ks],
                    "id": np.repeat(pdf["id"].to_numpy(), counts),
                    "len": np.repeat([len(s) for s in pdf["s"]], counts),
                    "q": [q for ks in found for _, q, _ in ks],
                    "place": [place for ks in found for _, _, place in ks],
                }
            )

    hashed = texts.select("id", "s").mapInPandas(keys, "key string, id long, len int, q int, place int")
    # a hash collision merges two blocks, which adds candidates and loses none
    return hashed.withColumn("key", F.xxhash64("key"))


def _tasks(df: DataFrame) -> int:
    """Tasks for comparisons: few bytes may mean much work, so partitions are not merged by their size."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _may_be_similar(threshold: int) -> Column:
    """What a block says about a pair (x, y) of its texts, without the texts.

    Lengths must allow the least common subsequence. It also bounds the grams that both must share, and if the block's gram
    is the first that they share, only those after its place in both can follow. A similar pair passes
    in the block of its first shared gram.
    """
    t = (threshold - 0.5) / 100
    la, lb, q = F.col("x.len"), F.col("y.len"), F.col("x.q")
    lcs = F.ceil(F.lit(t / 2) * (la + lb) - 1e-9)
    lost = lambda own, other: q * (own - lcs) + (q - 1) * (other - lcs)
    shared = F.greatest(la - q + 1 - lost(la, lb), lb - q + 1 - lost(lb, la))
    left = F.least(la - q + 1 - F.col("x.place"), lb - q + 1 - F.col("y.place"))
    return (F.least(la, lb) >= lcs) & (left >= shared) & (F.col("x.q") == F.col("y.q"))


def _candidates(first: DataFrame, second: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b, once each: a text of ``first`` and one of ``second`` that share a block and pass its bounds.

    ``first`` has the column salts: its rows of hot blocks are repeated, those of ``second`` spread.
    """
    x = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    y = second.withColumn("salt", F.pmod(F.col("id"), F.col("salts")).cast("int"))
    n = _tasks(first)
    x, y = x.repartition(n, "key", "salt"), y.repartition(n, "key", "salt")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.id") < F.col("y.id"))
    pairs = x.alias("x").join(y.alias("y"), on & _may_be_similar(threshold))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _verified(pairs: DataFrame, firsts: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b, similarity) of the candidate pairs at or above the threshold; ``firsts`` has the texts of the a's.

    A text may be compared with a large share of all others, so the first ends are salted by the second.
    """
    left = firsts.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.explode(F.sequence(F.lit(0), F.lit(PAIR_SALTS - 1))).alias("salt"))
    right = texts.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    salted = pairs.withColumn("salt", F.pmod("b", F.lit(PAIR_SALTS)).cast("int")).repartition(_tasks(pairs), "a", "salt")
    joined = salted.join(left, ["a", "salt"]).join(right, "b")
    # substitutions make this distance no larger than the one of the ratio; it stops early
    t = (threshold - 0.5) / 100
    edits = f"cast(floor({1 - t} * (length(sa) + length(sb)) + 1e-9) as int)"
    close = joined.where(F.expr(f"levenshtein(sa, sb, {edits}) >= 0"))
    scored = close.select("a", "b", similarity(F.col("sa"), F.col("sb")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


def _blocks(texts: DataFrame, threshold: int) -> DataFrame:
    """The blocks of all texts, each row with the number of tasks that its block is spread over."""
    blocks = stage_table(_file_in_blocks(texts, threshold), "blocks")
    sizes = blocks.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK_ROWS)
    salts = F.least(F.lit(SALTS), 1 + F.floor(F.col("size") / BLOCK_ROWS)).cast("int")
    crowded = stage_table(sizes.select("key", salts.alias("salts")), "crowded")
    return blocks.join(crowded, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))


# ---- many texts against one at once ---------------------------------------------


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Bunch:
    """Texts alike enough to be compared with another one together.

    The rows of the common subsequence's table are bit masks over these texts, in words, a column for each text. What
    all of them begin and end with is not compared with a text that does so too.
    """

    def __init__(self, at: np.ndarray, codes: np.ndarray, sizes: np.ndarray, bins: np.ndarray):
        self.at, self.sizes, self.bins, self.most = at, sizes, bins, bins.max(axis=0)
        self.short, self.long = int(sizes.min()), int(sizes.max())
        ends = np.cumsum(sizes)
        starts = ends - sizes
        self.head = self.alike(codes, starts, 1, self.short)
        self.tail = self.alike(codes, ends - 1, -1, self.short - len(self.head))
        self.kind = np.uint16 if self.long <= 16 else np.uint32 if self.long <= 32 else np.uint64
        self.bits = np.iinfo(self.kind).bits
        self.words = -(-self.long // self.bits)
        column = np.repeat(np.arange(len(at), dtype=np.int32), sizes)
        place = (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.int32)
        order = np.argsort(codes, kind="stable")
        self.column, self.place = column[order], place[order]
        known, first = np.unique(codes[order], return_index=True)
        self.spans = dict(zip(known.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(codes)], strict=True), strict=True))
        self.masks: dict[int, np.ndarray] = {}
        self.limits: dict[int, np.ndarray] = {}
        self.buffers = [np.empty((self.words, len(at)), self.kind) for _ in range(3)]

    @staticmethod
    def alike(codes: np.ndarray, at: np.ndarray, step: int, most: int) -> list[int]:
        """The characters that follow in all texts from their places ``at``."""
        out = []
        while len(out) < most:
            here = codes[at + step * len(out)]
            if (here != here[0]).any():
                break
            out.append(int(here[0]))
        return out

    def mask(self, code: int) -> np.ndarray:
        """Where the texts have a character."""
        low, high = self.spans[code]
        place = self.place[low:high]
        out = np.zeros((self.words, len(self.at)), self.kind)
        np.bitwise_or.at(out, (place // self.bits, self.column[low:high]), self.kind(1) << (place % self.bits).astype(self.kind))
        return out

    def low_bits(self, counts: np.ndarray) -> np.ndarray:
        """Words with so many low bits set."""
        inside = np.clip(counts - self.bits * np.arange(self.words)[:, None], 0, self.bits)
        ones = ~self.kind(0) >> (self.bits - np.maximum(inside, 1)).astype(self.kind)
        return np.where(inside > 0, ones, self.kind(0))

    def common(self, codes: list[int], some: np.ndarray | None, masks_left: int) -> tuple[np.ndarray, int, int]:
        """Lengths of the longest common subsequences of another text and all or some texts; the steps taken; bytes of masks added."""
        most, head, tail, added = min(len(codes), self.short), 0, 0, 0
        while head < min(most, len(self.head)) and codes[head] == self.head[head]:
            head += 1
        while tail < min(most - head, len(self.tail)) and codes[-1 - tail] == self.tail[tail]:
            tail += 1
        state, hit, rest = self.buffers if some is None else [np.empty((self.words, len(some)), self.kind) for _ in range(3)]
        state[:] = ~self.low_bits(np.array([head]))
        between = codes[head : len(codes) - tail]
        for code in between:
            if code not in self.spans:
                continue
            mask = self.masks.get(code)
            if mask is None:
                mask = self.mask(code)
                if added + mask.nbytes <= masks_left:
                    self.masks[code] = mask
                    added += mask.nbytes
            np.bitwise_and(state, mask if some is None else mask[:, some], out=hit)
            np.bitwise_xor(state, hit, out=rest)
            np.add(state, hit, out=hit)
            if self.words > 1:
                carry = hit < state
                for w in range(1, self.words):
                    more = carry[w - 1].astype(self.kind)
                    hit[w] += more
                    carry[w] |= (hit[w] == 0) & (more == 1)
            np.bitwise_or(hit, rest, out=state)
        np.bitwise_not(state, out=state)
        if tail:
            if tail not in self.limits:
                self.limits[tail] = self.low_bits(self.sizes - tail)
            np.bitwise_and(state, self.limits[tail] if some is None else self.limits[tail][:, some], out=state)
        return np.bitwise_count(state).sum(axis=0, dtype=np.int64) + tail, len(between) * self.words, added


class Crowd:
    """Texts compared with one other at once, in bunches; those that are dropped take part no longer.

    Characters are counted in ``BINS`` classes first: what a text shares by class with the most that a text of the bunch has
    bounds the subsequence; long texts are bounded one by one. Bunches are cut from the sorted counts of texts of about a length,
    where neighbours are too different to be similar.
    """

    BINS = 64

    def __init__(self, texts: Sequence[str], threshold: int):
        self.texts = texts
        self.t = (threshold - 0.5) / 100
        self.threshold = threshold
        self.gone = np.zeros(len(texts), dtype=bool)
        self.work = 0
        self.file()

    def file(self) -> None:
        at = np.flatnonzero(~self.gone)
        self.left = self.filed = len(at)
        self.masks_left = MASK_BYTES
        self.bunches = [x for low in range(0, len(at), SORTED_TEXTS) for x in self.bunched(at[low : low + SORTED_TEXTS])]
        self.most = np.array([x.most for x in self.bunches], dtype=np.int64).reshape(-1, self.BINS)
        self.short = np.array([x.short for x in self.bunches], dtype=np.int64)
        self.long = np.array([x.long for x in self.bunches], dtype=np.int64)

    def bunched(self, at: np.ndarray) -> Iterator[Bunch]:
        texts = [self.texts[i] for i in at]
        codes = _points("".join(texts))
        sizes = np.array([len(s) for s in texts], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        bins = np.bincount(np.repeat(np.arange(len(at)) * self.BINS, sizes) + codes % self.BINS, minlength=len(at) * self.BINS)
        bins = bins.astype(np.int32).reshape(-1, self.BINS)
        by_counts = np.argsort(np.minimum(bins, 255).astype(np.uint8).view(f"S{self.BINS}").ravel(), kind="stable")
        # no column is more than twice as long as its text
        long = np.ceil(np.log2(np.maximum(sizes, 1)))
        order = by_counts[np.argsort(long[by_counts], kind="stable")]
        order = order[sizes[order] > 0]
        between = np.abs(np.diff(bins[order], axis=0)).sum(axis=1) / (sizes[order][1:] + sizes[order][:-1]) - (1 - self.t)
        widest = np.argsort(-between, kind="stable")[: 8 * len(order) // BUNCH_TEXTS]
        ends = np.union1d(widest[between[widest] > 0], np.flatnonzero(np.diff(long[order])))
        for part in np.split(order, ends + 1):
            for some in np.array_split(part, -(-len(part) // BUNCH_TEXTS)) if len(part) else []:
                place = np.arange(sizes[some].sum()) + np.repeat(starts[some] - (np.cumsum(sizes[some]) - sizes[some]), sizes[some])
                yield Bunch(at[some], codes[place], sizes[some], bins[some])

    def drop(self, at: np.ndarray) -> None:
        self.gone[at] = True
        self.left -= len(at)

    def similar(self, s: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the texts at or above the threshold, in the order of their places."""
        if 2 * self.left <= self.filed:
            self.file()
        codes = _points(s)
        own, n, codes = np.bincount(codes % self.BINS, minlength=self.BINS), len(codes), codes.tolist()
        shared = np.minimum(self.most, own).sum(axis=1)
        may = (shared >= self.t / 2 * (n + self.short) - 1e-9) & (self.long >= self.t / 2 * (n + self.long) - 1e-9)
        places, scores = [], []
        for k in np.flatnonzero(may).tolist():
            bunch, some = self.bunches[k], None
            at, sizes = bunch.at, bunch.sizes
            if n * bunch.words > 4 * self.BINS:
                # worth a look at each text: those that are gone or have other characters are left out
                shared = np.minimum(bunch.bins, own).sum(axis=1)
                some = np.flatnonzero((shared >= self.t / 2 * (n + sizes) - 1e-9) & ~self.gone[at])
                if not len(some):
                    continue
                at, sizes = at[some], sizes[some]
            lcs, steps, added = bunch.common(codes, some, self.masks_left)
            self.masks_left -= added
            self.work += 50_000 + steps * len(lcs)
            near = np.flatnonzero(lcs >= self.t / 2 * (n + sizes) - 1e-9)
            found = np.rint(200.0 * lcs[near] / (n + sizes[near])).astype(np.int64)
            kept = (found >= self.threshold) & ~self.gone[at[near]]
            places.append(at[near][kept])
            scores.append(found[kept])
        if not places:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at, found = np.concatenate(places), np.concatenate(scores)
        order = np.argsort(at)
        return at[order], found[order]


class Firsts:
    """A few texts in the order of their ids, compared with one other text at once."""

    def __init__(self, ids: Sequence[int], texts: Sequence[str], threshold: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.crowd = Crowd([texts[i] for i in order], threshold)

    def similar(self, id_: int, s: str, earliest: bool) -> list[tuple[int, int]]:
        """(id, similarity) of the texts with smaller ids at or above the threshold; only the first with ``earliest``."""
        at, found = self.crowd.similar(s)
        end = int(np.searchsorted(self.ids[at], id_, side="left"))
        out = list(zip(self.ids[at[:end]].tolist(), found[:end].tolist(), strict=True))
        return out[:1] if earliest else out


def settle(
    ids: Sequence[int], texts: Sequence[str], threshold: int, most: int = DIRECT_TEXTS, work: int = CROWD_WORK
) -> tuple[np.ndarray, np.ndarray]:
    """The leader and the similarity of each text after the greedy loop in the order of the ids.

    A leader leads itself. The loop ends early at so many leaders or so much work: the texts that no leader has absorbed
    by then have the similarity -1. Texts of one id share their fate.
    """
    order = np.argsort(np.asarray(ids, dtype=np.int64), kind="stable")
    ids = np.asarray(ids, dtype=np.int64)[order]
    repeated = bool((ids[1:] == ids[:-1]).any())
    texts = [texts[i] for i in order]
    crowd = Crowd(texts, threshold)
    leader, similarity = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), -1, dtype=np.int32)
    leaders = chars = 0
    for i in range(len(ids)):
        if crowd.gone[i]:
            continue
        own = np.arange(i, np.searchsorted(ids, ids[i], side="right"))
        chars += sum(len(texts[k]) for k in own)
        leaders += len(own)
        if i and (leaders > most or chars > DIRECT_CHARS or crowd.work > work):
            break
        leader[own], similarity[own] = ids[i], 100
        crowd.drop(own)
        for k in own:
            at, found = crowd.similar(texts[k])
            if repeated and len(at):
                fellows = np.flatnonzero(np.isin(ids, ids[at]) & ~crowd.gone)
                at, found = fellows, found[np.searchsorted(ids[at], ids[fellows])]
            leader[at], similarity[at] = ids[i], found
            crowd.drop(at)
    back = np.argsort(order, kind="stable")
    return leader[back], similarity[back]


def first_leaders(few: tuple[list[int], list[str]], texts: Sequence[str], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the first of the few texts, which are in order, at or above the threshold; the similarity is -1 if there is none."""
    leader, similarity = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), -1, dtype=np.int32)
    crowd = Crowd(texts, threshold)
    for id_, s in zip(*few, strict=True):
        if not crowd.left:
            break
        at, found = crowd.similar(s)
        leader[at], similarity[at] = id_, found
        crowd.drop(at)
    return leader, similarity


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in larger batches."""
    some, n, chars = [], 0, 0
    for pdf in batches:
        some.append(pdf)
        n, chars = n + len(pdf), chars + int(pdf["s"].str.len().sum())
        if n >= SORTED_TEXTS or chars >= SORTED_CHARS:
            yield pd.concat(some, ignore_index=True)
            some, n, chars = [], 0, 0
    if n:
        yield pd.concat(some, ignore_index=True)


LED = "id long, s string, leader long, similarity int"


def _led(pdf: pd.DataFrame, leader: np.ndarray, similarity: np.ndarray) -> pd.DataFrame:
    # the text of an absorbed row is not needed again
    kept = pdf["s"].where((similarity < 0) | (leader == pdf["id"].to_numpy()), None)
    return pd.DataFrame({"id": pdf["id"], "s": kept, "leader": leader, "similarity": similarity})


def _settled(texts: DataFrame, threshold: int, work: int) -> DataFrame:
    """(id, s, leader, similarity) of a few texts, settled by one task as far as ``settle`` goes."""
    limits = DIRECT_TEXTS, work

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(batches)
        if found:
            pdf = pd.concat(found, ignore_index=True)
            yield _led(pdf, *settle(pdf["id"].tolist(), pdf["s"].tolist(), threshold, *limits))

    return texts.select("id", "s").repartition(1).mapInPandas(run, LED)


def _few(firsts: DataFrame) -> tuple[list[int], list[str]] | None:
    """The ids and texts in order, if they are few and short enough for every task."""
    head = firsts.select("id", "s").limit(DIRECT_TEXTS + 1)
    n, chars = _extent(head)
    if n > DIRECT_TEXTS or chars > DIRECT_CHARS:
        return None
    rows = sorted(head.collect())
    return [r["id"] for r in rows], [r["s"] for r in rows]


def _extent(texts: DataFrame) -> tuple[int, int]:
    """How many texts, and how many characters they have."""
    return tuple(texts.agg(F.count("*"), F.coalesce(F.sum(F.length("s")), F.lit(0))).first())


def _among(few: tuple[list[int], list[str]], texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b, similarity), a < b, of the few texts and ``texts``, compared by many tasks."""
    sent = texts.sparkSession.sparkContext.broadcast(few)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts = Firsts(*sent.value, threshold)
        for pdf in batches:
            found = [(a, b, n) for b, s in zip(pdf["id"], pdf["s"], strict=True) for a, n in firsts.similar(b, s, False)]
            yield pd.DataFrame(found, columns=["a", "b", "similarity"]).astype("int64")

    spread = texts.select("id", "s").repartition(_tasks(texts))
    return spread.mapInPandas(compare, "a long, b long, similarity long").withColumn("similarity", F.col("similarity").cast("int"))


def _against(few: tuple[list[int], list[str]], texts: DataFrame, threshold: int) -> DataFrame:
    """(id, s, leader, similarity) of ``texts`` and the first of the few texts, all of them earlier, that is similar."""
    sent = texts.sparkSession.sparkContext.broadcast(few)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, strings = sent.value
        firsts = None
        for pdf in _gathered(batches):
            if len(pdf) >= len(ids):
                yield _led(pdf, *first_leaders((ids, strings), pdf["s"].tolist(), threshold))
                continue
            # the more numerous side is the one in bunches
            firsts = firsts or Firsts(ids, strings, threshold)
            found = [(firsts.similar(b, s, True) or [(0, -1)])[0] for b, s in zip(pdf["id"], pdf["s"], strict=True)]
            leader, similarity = np.array(found, dtype=np.int64).T
            yield _led(pdf, leader, similarity.astype(np.int32))

    return texts.select("id", "s").mapInPandas(compare, LED)


# ---- who stands -----------------------------------------------------------------


def fallen(edges: DataFrame) -> DataFrame:
    """(id) of the vertices of the graph (a, b), a before b, that an earlier standing neighbour knocks over.

    A vertex stands if none of its earlier neighbours stands: the lexicographically first maximal independent set. Few
    edges are settled in one pass in their order; more of them in rounds over the stored edges. In a round every
    vertex without an earlier neighbour stands, and its later neighbours fall with all their edges. The edges are read
    several times: give a stored table.
    """
    edges = edges.select("a", "b")
    spark, kind = edges.sparkSession, f"id {edges.schema['a'].dataType.simpleString()}"
    few = edges.limit(DRIVER_EDGES + 1).collect()
    if len(few) <= DRIVER_EDGES:
        before: dict = {}
        for a, b in few:
            before.setdefault(b, []).append(a)
        down: set = set()
        for b in sorted(before):
            if not down.issuperset(before[b]):
                down.add(b)
        return spark.createDataFrame([(x,) for x in sorted(down)], kind)
    out = None
    while not edges.isEmpty():
        later = edges.select(F.col("b").alias("a")).distinct()
        hit = edges.join(later, "a", "left_anti").select(F.col("b").alias("id")).distinct()
        hit = stage_table(hit, "fallen")
        out = hit if out is None else out.unionByName(hit)
        for end in "ab":
            edges = edges.join(hit.withColumnRenamed("id", end), end, "left_anti")
        edges = stage_table(edges.select("a", "b"), "edges")
    return out


# ---- near-duplicate rows --------------------------------------------------------


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """String columns (or ``columns``) joined by single blanks; NULL counts as empty."""
    from scrubline.functions.numbers import string_columns

    chosen = list(columns) if columns else string_columns(df)
    return F.concat_ws(" ", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in chosen])


def fuzzy_duplicate_groups(
    df: DataFrame, row_id: str, columns: Sequence[str] | None = None, threshold: int = 90
) -> DataFrame:
    """(leader_id, member_id, similarity) of the greedy first-leader grouping.

    In row order, a row not yet absorbed becomes a leader and absorbs every later row at
    or above the threshold. That equals: a row leads iff no earlier leader is similar to
    it, and its leader is the earliest similar leader. Whole texts are compared.
    """
    rows = df.select(col(row_id).cast("long").alias("row"), row_text(df, columns).alias("s"))
    rows = stage_table(rows, "texts")
    # copies of a text share its fate: compare one of each
    copies = rows.groupBy("s").agg(F.min("row").alias("id"), F.count("*").alias("n"))
    texts = stage_table(copies, "distinct-texts")
    absorbed = _absorb(texts, threshold)
    fate = texts.join(absorbed, "id", "left").select(
        "s", "id", "n", F.coalesce("leader", "id").alias("leader_id"), F.coalesce("similarity", F.lit(100)).alias("similarity")
    )
    # a text without copies is its row; only the others are looked for among the rows
    alone = fate.where("n = 1 and leader_id <> id").select("leader_id", F.col("id").alias("member_id"), "similarity")
    members = ValueTable(fate.where("n > 1").drop("id"), "s").attach(rows, "s").where("leader_id <> row")
    return alone.unionByName(members.select("leader_id", F.col("row").alias("member_id"), F.col("similarity").cast("int")))


def _absorb(texts: DataFrame, threshold: int) -> DataFrame:
    """(id, leader, similarity) of every text that an earlier leader absorbs.

    The undecided texts are taken in order, in batches. A batch says which of its texts lead, and the leaders are compared
    with everything later at once. Batches grow as long as most of their texts lead, and their similar pairs come from blocks.
    Where few lead, or they absorb many later texts each, the texts are crowded, and blocks would pair most of them many times
    over: one task runs the greedy loop over a large batch, whose leaders go to the tasks of the other texts, where a text
    stops at its first leader.
    """
    filed = []

    def blocks() -> DataFrame:
        # filed once they are wanted: a crowd is settled without them
        if not filed:
            filed.append(_blocks(texts, threshold))
        return filed[0]

    n_tasks = _tasks(texts)
    waiting = stage_table(texts.where("id is not null").select("id", "s").repartition(n_tasks, "id"), "undecided")
    # texts of one id share their fate
    repeated = not waiting.groupBy("id").count().where("count > 1").isEmpty()
    size, crowded, taken, facts, n_rest, n_leaders = FIRST_BATCH, False, [], None, 0, 0
    # shares of the undecided texts at which a batch may end
    shares = [2.0**-k for k in range(48)]
    while True:
        ends = F.percentile_approx("id", shares, 100_000).alias("at")
        facts = facts or waiting.agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"), ends).first()
        if not facts["n"]:
            break
        absorbed = n_rest - facts["n"]
        if not crowded and absorbed >= max(1, CROWD_EACH * n_leaders, n_rest / CROWD_SHARE):
            # texts of a crowd in any order: those of a small batch need not be similar to each other
            crowded, size = True, CROWD_TEXTS
        wanted = max(1, min(size, CROWD_CHARS * facts["n"] // max(1, facts["chars"]))) if crowded else size
        last = next((i for share, i in zip(shares, facts["at"], strict=True) if facts["n"] * share <= wanted), facts["at"][-1])
        firsts, rest = waiting.where(F.col("id") <= last), waiting.where(F.col("id") > last)
        n_batch, chars = _extent(firsts)
        # the ends are estimates: twice the wanted number is still a batch for one task
        most, longest = (2 * CROWD_TEXTS, 2 * CROWD_CHARS) if crowded else (DIRECT_TEXTS, DIRECT_CHARS)
        direct, n_open = n_batch <= most and chars <= longest, 0
        if crowded and not direct and wanted > FIRST_BATCH:
            size = wanted // 2
            continue
        # if all of them lead
        heavy = n_batch * chars / 2 * math.ceil(chars / n_batch / 64) > CROWD_WORK
        if direct and (crowded or not heavy):
            # the loop of a crowd is short; where it is not, the other tasks shall not wait for it
            work = min(CROWD_WORK, CROWD_WORK_EACH * max(n_batch, 8 * FIRST_BATCH)) if crowded else CROWD_WORK
            settled = stage_table(_settled(firsts, threshold, work), "settled")
            leaders = settled.where("similarity >= 0 and leader = id").select("id", "s")
            within = settled.where("similarity >= 0 and leader <> id").select("id", "leader", "similarity")
            undecided = settled.where("similarity < 0").select("id", "s")
            n_leaders, n_open = settled.agg(F.count_if(F.expr("similarity >= 0 and leader = id")), F.count_if(F.col("similarity") < 0)).first()
        else:
            if direct:
                edges = _among(tuple(zip(*firsts.select("id", "s").collect(), strict=True)), firsts, threshold)
            else:
                own = blocks().join(firsts.select("id").distinct(), "id")
                edges = _verified(_candidates(own, own, threshold), firsts, firsts, threshold)
            edges = stage_table(edges, "similar")
            leaders = stage_table(firsts.join(fallen(edges), "id", "left_anti"), "leaders")
            within = edges.join(leaders.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
            within = within.select(F.col("b").alias("id"), F.col("a").alias("leader"), "similarity")
            n_leaders = leaders.count()
        n_rest = facts["n"] - n_batch + n_open
        probe = direct and not crowded
        crowded = 2 * n_leaders <= n_batch - n_open
        # where few lead, the texts are crowded: a larger batch would compare many of them that one leader absorbs
        size = CROWD_TEXTS if crowded else max(FIRST_BATCH, GROWTH * n_leaders)
        if probe and crowded and n_rest:
            # a small batch has told that: its few leaders are found again in a large one
            continue
        if not n_rest:
            taken.append(within)
            break
        if n_open:
            rest = rest.unionByName(undecided).repartition(n_tasks, "id")
        words = n_leaders * math.ceil(facts["chars"] / facts["n"] / 64)
        # blocks that are filed already cost nothing more
        few = _few(leaders) if crowded or n_leaders * n_rest <= DIRECT_PAIRS or (not filed and words <= DIRECT_WORDS) else None
        if few:
            compared = stage_table(_against(few, rest, threshold), "undecided")
            across = compared.where("similarity >= 0").select("id", "leader", "similarity")
            waiting = compared.where("similarity < 0").select("id", "s")
            found = within.unionByName(across)
        else:
            pairs = _candidates(blocks().join(leaders.select("id").distinct(), "id"), blocks().join(rest.select("id").distinct(), "id"), threshold)
            across = _verified(pairs, leaders, texts, threshold).select(F.col("b").alias("id"), F.col("a").alias("leader"), "similarity")
            found = stage_table(_earliest(within.unionByName(across)), "absorbed")
        taken.append(found)
        facts = None
        if repeated or not few:
            waiting = stage_table((waiting if few else rest).join(found.select("id"), "id", "left_anti"), "undecided")
    out = texts.sparkSession.createDataFrame([], "id long, leader long, similarity int")
    for found in taken:
        out = out.unionByName(found)
    return _earliest(out)


def _earliest(found: DataFrame) -> DataFrame:
    """(id, leader, similarity) of the first leader of each text."""
    by = F.min_by("similarity", "leader").alias("similarity")
    return found.groupBy("id").agg(F.min("leader").alias("leader"), by)


def similar_pairs(texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs at or above the threshold."""
    blocks = _blocks(texts, threshold)
    return _verified(_candidates(blocks, blocks, threshold), texts, texts, threshold)


class RemoveFuzzyDuplicates(Step):
    """Drop rows absorbed by an earlier similar row."""

    def __init__(self, order_by: str, key_columns: Sequence[str] | None = None, threshold: int = 90):
        self.column = None
        self.order_by = order_by
        self.key_columns = key_columns
        self.threshold = threshold

    def apply(self, df, stats):
        groups = fuzzy_duplicate_groups(df, self.order_by, self.key_columns, self.threshold)
        gone = groups.select(F.col("member_id").alias("__gone"))
        return df.join(gone, col(self.order_by) == F.col("__gone"), "left_anti")


# ---- near-duplicate categories --------------------------------------------------


def category_mapping(df: DataFrame, column: str, threshold: int = 80) -> DataFrame:
    """(raw, canonical, similarity, n): variants and the value each is merged into.

    Values are visited by falling frequency (ties by value). A value is mapped to the most
    similar value of at least its frequency that is not itself mapped by then, if their
    token-sorted similarity reaches the threshold.
    """
    counts = (
        df.select(strip(col(column).cast("string")).alias("v"))
        .where("v is not null")
        .groupBy("v")
        .agg(F.count("*").alias("n"))
        .withColumn("s", token_sorted(F.col("v")))
        .where("s <> ''")
    )
    # values visited earlier come first in this order
    order = F.struct((-F.col("n")).alias("n"), F.col("v"))
    values = counts.groupBy("s").agg(F.sort_array(F.collect_list(order)).alias("variants"))
    texts = stage_table(values.withColumn("id", F.monotonically_increasing_id()), "texts")
    near = similar_pairs(texts.select("id", "s"), threshold)
    both_ways = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    ends = [texts.select(F.col("id").alias(x), F.col("variants").alias(f"v{x}")) for x in "ab"]
    far = both_ways.join(ends[0], "a").join(ends[1], "b").select("va", "vb", "similarity")
    # equal texts written in different ways
    same = texts.where(F.size("variants") > 1).select(F.col("variants").alias("va"), F.col("variants").alias("vb"), F.lit(100).alias("similarity"))
    pairs = far.unionByName(same).withColumn("v", F.explode("va")).withColumn("c", F.explode("vb"))
    # targets are at least as frequent: earlier ones, or later ones of equal frequency
    edges = stage_table(pairs.where("v <> c and c.n <= v.n").select("v", "c", "similarity"), "edges")
    # a value with a later target is mapped whatever the others do; any other is mapped if an earlier target is not
    doomed = edges.where("c > v").select("v").distinct()
    open_edges = edges.join(doomed, "v", "left_anti").join(doomed.withColumnRenamed("v", "c"), "c", "left_anti")
    open_edges = stage_table(open_edges, "open-edges")
    down = fallen(open_edges.select(F.col("c").alias("a"), F.col("v").alias("b"))).withColumnRenamed("id", "v")
    mapped = stage_table(doomed.unionByName(down), "mapped")
    free = edges.join(mapped.select(F.col("v").alias("c"), F.lit(True).alias("gone")), "c", "left").where("c > v or gone is null")
    closest = F.struct((-F.col("similarity")).alias("d"), "c")
    best = free.groupBy("v").agg(F.min(closest).alias("to"))
    return best.select(
        F.col("v.v").alias("raw"), F.col("to.c.v").alias("canonical"), (-F.col("to.d")).alias("similarity"), (-F.col("v.n")).alias("n")
    )


class AutoStandardize(Step):
    """Merge similar values of a column into the most frequent variant."""

    def __init__(self, column: str, threshold: int = 80):
        self.column = column
        self.threshold = threshold

    def learn(self, df, stats):
        return {"mapping": ValueTable(category_mapping(df, self.column, self.threshold), "raw")}

    def apply(self, df, stats):
        trimmed = df.withColumn(self.column, strip(col(self.column).cast("string")))
        joined = stats["mapping"].attach(trimmed, self.column)
        return joined.withColumn(self.column, F.coalesce("canonical", col(self.column))).select(
            *[col(c) for c in df.columns]
        )
