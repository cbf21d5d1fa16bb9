"""Quality rules by distribution divergence, as DataFrame expressions only.

A document's shares of character classes and of its language's commonest words are compared with
the language's mean shares by the Jensen-Shannon distance (base 2, so 0 to 1). The means are taken
over every document of the language that is long enough to be compared.

Each language has a reference of its own. The common words of those in ``COMMON_WORDS`` are given, those of any
other are its 20 most frequent words, counted over all its documents (ties: the smaller word).

Null or blank text has no words: all counts are 0 and ``base_failed`` is true. A document without a language, or
whose language has no words at all, takes the given language whose common words it uses most; if no document of
that language is long enough to compare, the method has no objection. Repeated rows are separate
rows with equal results; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.session import stage_table

# fixed values: very common words of each language
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it with as was on be by are this from or".split(),
    "es": "de la que el en y a los se del las un por con no una para su al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par pas au sur avec".split(),
}
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
WINDOW = 5
# common words of a language that has no given list
COUNTED_WORDS = 20
# references up to this many languages travel to every executor
SMALL_ROWS = 10_000


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def _small(staged: DataFrame) -> DataFrame:
    return F.broadcast(staged) if staged.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else staged


def counted_words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(name, counted): the commonest words of every language that ``COMMON_WORDS`` doesn't list.

    Counts combine before they are shuffled, and so does the choice of the first 20.
    """
    rows = docs.where(~F.col(lang_col).isin(*COMMON_WORDS)).select(F.col(lang_col).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select("name", F.explode(F.transform(_words(F.col("text")), F.lower)).alias("word"))
    found = found.groupBy("name", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "word"))
    best = found.withColumn("place", place).where(F.col("place") <= COUNTED_WORDS)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    return stage_table(best.groupBy("name").agg(listed.alias("counted")), "common-words")


def _nearest(words: Column) -> Column:
    """The given language with most common words in a text."""
    lower = F.transform(words, F.lower)
    hits = [
        F.struct(F.size(F.array_intersect(lower, F.array(*map(F.lit, listed)))).alias("n"), F.lit(name).alias("name"))
        for name, listed in sorted(COMMON_WORDS.items())
    ]
    return F.greatest(*hits)["name"]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and histograms of each document, one row per input row; only unlisted languages are counted before."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    df = df.select("doc_id", "lang", text.alias("text"))
    more = counted_words(docs, text_col, lang_col)
    if more.isEmpty():
        df = df.withColumn("counted", F.lit(None).cast("array<string>"))
    else:
        df = df.join(_small(more), F.col("lang") == F.col("name"), "left").drop("name")
    df = df.withColumn("words", _words(F.col("text")))
    df = df.withColumn("n_words", F.size("words"))
    # what is left without lower-case letters and blanks is short and cheap to search again
    df = df.withColumn("rest", F.regexp_replace("text", "[\\p{Ll}\\x20\\x09-\\x0D]+", ""))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumn("lines", lines)
    gram = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    grams = F.when(
        F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n_words") - WINDOW), gram)
    ).otherwise(F.array().cast("array<bigint>"))
    own = F.col("lang").isin(*COMMON_WORDS) | F.col("counted").isNotNull()
    df = df.withColumn("grams", grams).withColumn("ref", F.when(own, F.col("lang")).otherwise(_nearest(F.col("words"))))

    def count(pattern: str) -> Column:
        return F.length("rest") - F.length(F.regexp_replace("rest", pattern, ""))

    listed = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    df = df.withColumn("listed", F.coalesce("counted", F.try_element_at(listed, F.col("ref"))))
    places = F.transform("words", lambda w: F.array_position("listed", F.lower(w)))
    df = df.withColumn("hits", F.array_remove(places, 0))
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    df = df.select(
        "doc_id", "ref", F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"),
        F.length("text").alias("chars"), F.length("rest").alias("n_rest"), count("\\p{Lu}+").alias("upper"),
        count("\\p{Nd}+").alias("digit"), count("[.,;:!?'\"()\\-]+").alias("stop"), "hits", "listed",
    )
    h = lambda j: F.get("sorted", j)["h"]
    twice = F.filter("sorted", lambda x, j: (x["h"] == h(j - 1)) | (x["h"] == h(j + 1)))
    df = df.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # a window reaches to its end or to the next repeated window
    reach = F.transform("starts", lambda p, j: F.least(F.lit(WINDOW), F.get("starts", j + 1) - p))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    n_blank = F.col("chars") - F.col("word_chars")
    lower = F.col("chars") - F.col("n_rest") - n_blank
    other = F.col("n_rest") - F.col("upper") - F.col("digit") - F.col("n_symbols") - F.col("stop")
    classes = F.array(*[x.cast("double") for x in (lower, n_blank, F.col("upper"), F.col("digit"), F.col("n_symbols"), F.col("stop"), other)])
    bins = F.transform(F.sequence(F.lit(1), F.size("listed")), lambda k: (F.size("hits") - F.size(F.array_remove("hits", k))).cast("double"))
    rest = (F.col("n_words") - F.size("hits")).cast("double")
    share = lambda a, n: F.transform(a, lambda x: x / F.greatest(n.cast("double"), F.lit(1.0)))
    return df.select(
        "doc_id", "ref", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share(classes, F.col("chars")).alias("classes"), share(F.concat(bins, F.array(rest)), F.col("n_words")).alias("common"),
    )


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, 0 to 1."""

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        term = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(0.0)
        return (term(x) + term(y)) / 2

    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def references(measured: DataFrame, min_words: int) -> DataFrame:
    """Mean shares per language over all documents that are long enough: one row per language."""
    most = max(COUNTED_WORDS, *map(len, COMMON_WORDS.values())) + 1
    means = [F.avg(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(7)]
    means += [F.avg(F.get("common", F.lit(k))).alias(f"w{k}") for k in range(most)]
    by = measured.where(F.col("n_words") >= min_words).groupBy("ref").agg(F.max(F.size("common")).alias("size"), *means)
    common = F.slice(F.array(*[f"w{k}" for k in range(most)]), F.lit(1), F.col("size"))
    by = by.select(F.col("ref").alias("name"), F.array(*[f"c{k}" for k in range(7)]).alias("class_ref"), common.alias("common_ref"))
    return stage_table(by, "references")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    min_words: int = 30, class_limit: tuple = (0.15, 0.3), common_limit: tuple = (0.12, 1.5),
) -> DataFrame:
    """doc_id, the base counts, both distances, ``base_failed`` and ``kept``.

    Texts under ``min_words`` words have histograms too coarse to compare; only the base rules
    judge them. A limit is ``base + slope / sqrt(n_words)``: a small sample lies further from its
    language by chance alone. All documents are measured once and the measures staged, since the references
    need every document before the first can be compared.
    """
    measured = stage_table(measure(docs, id_col, text_col, lang_col), "quality")
    df = measured.join(_small(references(measured, min_words)), F.col("ref") == F.col("name"), "left")
    df = df.withColumn("class_distance", _distance(F.col("classes"), F.col("class_ref")))
    df = df.withColumn("common_distance", _distance(F.col("common"), F.col("common_ref")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    limit = lambda pair: F.lit(pair[0]) + F.lit(pair[1]) / F.sqrt("n_words")
    far = (F.col("class_distance") > limit(class_limit)) | (F.col("common_distance") > limit(common_limit))
    df = df.withColumn("base_failed", failed)
    verdict = (F.col("n_words") < min_words) | ~F.coalesce(far, F.lit(False))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & verdict).alias("kept"), "class_distance", "common_distance",
    )
