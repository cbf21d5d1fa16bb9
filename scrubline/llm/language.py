"""Language identification by compression with per-language zstandard dictionaries.

A raw-content dictionary per language is made of pieces of labelled texts. A text's letters, lower
case, are cut into blocks, every block is compressed with every dictionary, and the language with
the smallest sum wins. When the runner-up is nearly as small, the text is rejected.

Null texts and texts without a letter are ``und`` with score 0 and rejected. Without labelled rows
everything is ``und``. Ties go to the language with most labelled rows, and have margin 0. Repeated
rows and extra columns do not matter; the label column is read only while learning.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.text import small_batches

UNDETERMINED = "und"
LETTER = "\\p{L}"
# rows per language to learn from, characters of each, and bytes of a dictionary
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 400
DICTIONARY_BYTES = 256 << 10
MAX_LANGUAGES = 200
BLOCK = 4096
LEVEL = 6
# pieces of the winner's dictionary that a language with less text must beat
PIECES = 8
# a text is rejected if the runner-up is at most this much larger
MIN_MARGIN = 0.005


def letters(text: Column) -> Column:
    """The runs of letters, lower case, with one blank before, between and after them."""
    return F.lower(F.concat(F.lit(" "), F.btrim(F.regexp_replace(text, "\\P{L}+", " ")), F.lit(" ")))


def sample_texts(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """At most about ``SAMPLE_ROWS`` texts per language, ``SAMPLE_CHARS`` characters of each.

    Rows are picked by a hash of their id, so the sample doesn't depend on partitions; copies of a
    text count once. The piece is taken from a place in the text that the hash decides.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER))
    rows = rows.select(F.col(lang_col).alias("lang"), letters(F.col(text_col)).alias("text"), F.xxhash64(F.col(id_col), F.lit(7)).alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{len(counts)} languages, at most {MAX_LANGUAGES} are held at once")
    every = {lang: max(1, n // SAMPLE_ROWS) for lang, n in counts.items()}
    if not every:
        return {}
    step = F.create_map(*[F.lit(x) for pair in every.items() for x in pair])
    picked = rows.where(F.pmod("h", F.element_at(step, F.col("lang"))) == 0)
    room = F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))
    piece = F.substring("text", (F.pmod(F.shiftright("h", 20), room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    # twice the mean for each language is beyond any chance of the hash, and bounds what arrives
    pieces = picked.select("lang", "h", piece.alias("piece")).orderBy("lang", "h", "piece").limit(2 * SAMPLE_ROWS * len(every) + 1000)
    out: dict[str, list[str]] = {}
    for r in pieces.collect():
        out.setdefault(r["lang"], []).append(r["piece"])
    # the commonest language first: it wins ties
    return {lang: list(dict.fromkeys(out[lang])) for lang in sorted(out, key=lambda x: (-counts[x], x))}


def dictionaries(texts: dict[str, list[str]], size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw content per language, up to ``size`` bytes; a language with less text keeps what it has."""
    return {lang: "\n".join(x).encode()[:size] for lang, x in texts.items()}


class Compressors:
    """Compressed sizes of a text under every dictionary.

    Languages with at least half the text of the fullest one are compared at equal size, so that none wins by
    its size. A rarer language meets their winner at its own size, against several pieces of the winner's dictionary.
    """

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        self.contents, self.level, self.made = contents, level, {}
        most = max(map(len, contents.values()), default=0)
        self.languages = [lang for lang, data in contents.items() if 2 * len(data) >= most]
        self.rare = [lang for lang in contents if lang not in self.languages]
        self.equal = min((len(contents[lang]) for lang in self.languages), default=0)

    def size(self, blocks: list[bytes], lang: str, low: int, n: int) -> int:
        """Compressed size with the ``n`` bytes of the dictionary from ``low``."""
        if (lang, low, n) not in self.made:
            d = zstandard.ZstdCompressionDict(self.contents[lang][low : low + n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            e = zstandard.ZstdCompressor(dict_data=d, level=self.level, write_content_size=False, write_dict_id=False)
            self.made[lang, low, n] = e, len(e.compress(b""))
        e, overhead = self.made[lang, low, n]
        return sum(len(e.compress(b)) for b in blocks) - len(blocks) * overhead

    def gain(self, blocks: list[bytes], lang: str, winner: str) -> float:
        """How much smaller a rare language makes the text than any piece of the winner's dictionary, or 0.

        A gain within the range of those pieces is chance.
        """
        n = len(self.contents[lang])
        own = self.size(blocks, lang, 0, n)
        starts = [k * n for k in range(min(PIECES, len(self.contents[winner]) // n))]
        others = []
        for low in starts:
            others.append(self.size(blocks, winner, low, n))
            if own >= others[-1]:
                return 0.0
        least = min(others)
        return (least - own) / least if least - own > max(others) - least else 0.0

    def judge(self, text: str) -> tuple[str, float, float]:
        """(language, margin, score)"""
        data = text.encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]
        found = choose(self.languages, [self.size(blocks, lang, 0, self.equal) for lang in self.languages])
        gains = sorted(((self.gain(blocks, lang, found[0]), lang) for lang in self.rare), reverse=True)
        if not gains or gains[0][0] == 0:
            return found
        margin = gains[0][0] - (gains[1][0] if len(gains) > 1 else 0.0)
        return gains[0][1], margin, min(1.0, 0.5 + 5 * margin)


def choose(languages: list[str], sizes: list[int]) -> tuple[str, float, float]:
    """(language, margin, score): margin is how much larger the runner-up is, relative to it."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    best = sizes[order[0]]
    if len(order) == 1:
        return languages[order[0]], 1.0, 1.0
    second = sizes[order[1]]
    margin = (second - best) / second if second > 0 else 0.0
    return languages[order[0]], margin, min(1.0, 0.5 + 5 * margin)


def identify(df: DataFrame, contents: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``df`` with lang_pred, score, margin and rejected, in one pass over the texts."""
    small_batches(df.sparkSession)
    names = ("lang_pred", "score", "margin", "rejected")
    clash = [c for c in df.columns if c.lower() in names]
    if clash:
        df = df.drop(*clash)
    types = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = Compressors(contents)
        for batch in batches:
            out = []
            for text in batch:
                text = text.as_py()
                if text is None or not compressors.languages:
                    out.append((UNDETERMINED, 0.0, 0.0))
                else:
                    lang, margin, score = compressors.judge(text)
                    out.append((lang, score, margin))
            yield pa.array([dict(zip(names, x, strict=False)) for x in out], type=types)

    udf = F.arrow_udf(predict_signature(predict), "lang_pred string, score double, margin double")
    known = F.col(text_col).rlike(LETTER)
    df = df.withColumn("__p", udf(F.when(known, letters(F.col(text_col)))))
    out = df.select(*[c for c in df.columns if c != "__p"], "__p.*")
    return out.withColumn("rejected", (F.col("lang_pred") == UNDETERMINED) | (F.col("margin") <= min_margin))


def predict_signature(f):
    """Type hints that Spark needs, as real objects (this module's hints are strings)."""
    f.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return f


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries from the rows that aren't held out."""
    rows = docs.where(~held_out(id_col, 3, 1))
    return dictionaries(sample_texts(rows, id_col, text_col, lang_col))
