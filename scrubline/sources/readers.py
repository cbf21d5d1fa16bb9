"""Readers: every source becomes a flat table; text sources stay all-string."""

from __future__ import annotations

import codecs
import csv
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.text import CP1252_BYTES, CP1252_CHARS
from scrubline.operators.steps import col

# Candidate delimiters, ties go to the earlier one.
DELIMITERS = (",", ";", "\t", "|")
SNIFF_CHARS = 4096
FORMATS = {
    ".csv": "csv", ".tsv": "csv", ".txt": "csv", ".json": "json", ".jsonl": "jsonl",
    ".xml": "xml", ".parquet": "parquet",
}
RANGE_BYTES = 64 << 20
# bytes of an XML document after which a repeated element below the first level is taken for the record
TAG_BYTES = 16 << 20
EXTRA = "__extra_cell"
BEYOND = "__beyond"
LINE = "__line"


@dataclass
class Source:
    """A table read from files, what was noticed on the way, and the rows left out."""

    df: DataFrame
    format: str
    path: str
    notes: list[str] = field(default_factory=list)
    rejected: DataFrame | None = None

    @cached_property
    def warnings(self) -> list[str]:
        """The notes, and the number of rows left out, which are counted when this is first asked for."""
        n = self.rejected.count() if self.rejected is not None else 0
        return [*self.notes, *([f"{n} rows with more cells than the header"] if n else [])]


# ---- looking at files -----------------------------------------------------------


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) per file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length")


def _open(uri: str):
    from pyarrow import fs

    # object-store schemes as the cluster writes them
    system, inner = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return system.open_input_file(inner)


def _valid_utf8(data: bytes, at_start: bool) -> bool:
    """Whether a byte range of a file can belong to UTF-8 text."""
    if not at_start:
        cut = 0
        while cut < min(3, len(data)) and data[cut] & 0xC0 == 0x80:
            cut += 1
        data = data[cut:]
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data, final=False)
    except UnicodeDecodeError:
        return False
    return True


def _first_record(f, data: bytes) -> bytes:
    """The start of a file to the end of its first line with text, and ``SNIFF_CHARS * 4`` bytes at least."""
    while True:
        text = data.lstrip(b" \t\r\n\xef\xbb\xbf")
        ends = [x for x in (text.find(b"\n"), text.find(b"\r")) if x >= 0]
        if ends:
            return data[: max(len(data) - len(text) + min(ends) + 1, SNIFF_CHARS * 4)]
        more = f.read(1 << 20)
        if not more:
            return data
        data += more


def sniff_files(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(path, delimiter, encoding, header): one row per file.

    The delimiter is the most frequent candidate in the first 4096 characters. Text that
    is not UTF-8 counts as Windows-1252; ``whole=False`` decides that from the head of the
    file. Files are read in byte ranges, so a huge file is many tasks.
    """
    last = F.greatest(F.col("length") - 1, F.lit(0))
    starts = F.sequence(F.lit(0).cast("long"), last, F.lit(RANGE_BYTES).cast("long"))
    ranges = list_files(spark, path)
    ranges = ranges.select("path", F.explode(starts).alias("start")) if whole else ranges.select("path", F.lit(0).cast("long").alias("start"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for uri, start in zip(pdf["path"], pdf["start"], strict=True):
                with _open(uri) as f:
                    f.seek(start)
                    data = f.read(RANGE_BYTES if whole else SNIFF_CHARS * 4)
                    head = _first_record(f, data) if start == 0 else None
                rows.append((uri, _valid_utf8(data, start == 0), head))
            yield pd.DataFrame(rows, columns=["path", "utf8", "head"])

    seen = ranges.repartition("path", "start").mapInPandas(look, "path string, utf8 boolean, head binary")
    files = seen.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.max("head").alias("head"))
    text = F.when(F.col("utf8"), F.make_valid_utf8(F.col("head").cast("string")))
    text = text.otherwise(_as_cp1252(F.decode("head", "ISO-8859-1")))
    sample = F.substring(text, 1, SNIFF_CHARS)
    counts = [
        F.struct(_occurrences(sample, d).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d"))
        for i, d in enumerate(DELIMITERS)
    ]
    return files.select(
        "path",
        F.array_max(F.array(*counts))["d"].alias("delimiter"),
        F.when(F.col("utf8"), "UTF-8").otherwise("windows-1252").alias("encoding"),
        F.regexp_extract(F.ltrim(text), r"^\ufeff?([^\r\n]*)", 1).alias("header"),
    )


def _as_cp1252(c: Column) -> Column:
    """Text read as Latin-1, with the characters Windows-1252 has in their place."""
    return F.translate(c, CP1252_BYTES, CP1252_CHARS)


def _occurrences(c: Column, d: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(d), F.lit("")))


# ---- delimited text -------------------------------------------------------------


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    encoding: str | None = None,
    multiline: bool = False,
) -> Source:
    """Delimited text as an all-string table.

    Delimiter, encoding and header are found per file; files that agree are read
    together. A header name that was there before gets a number, an empty one its place.
    Rows with fewer cells than the header are padded, rows with more are left out, counted in
    ``warnings``, and can be looked at in ``rejected``, with the whole line in ``__line``.
    """
    layouts: dict[tuple[str, str, str], list[str]] = {}
    # one row per input file
    for row in sniff_files(spark, path, whole=encoding is None).collect():
        key = (delimiter or row["delimiter"], encoding or row["encoding"], row["header"])
        layouts.setdefault(key, []).append(row["path"])
    parts, rejected = [], []
    for (sep, enc, header), paths in sorted(layouts.items()):
        names = header_names(header, sep)
        if not names:
            continue
        read = _read_csv(spark, paths, names, sep, enc, multiline)
        parts.append(read.where(f"{EXTRA} is null").drop(EXTRA))
        # a line with many cells too many is told by the parser, one with a single one is put together again
        by_line = not multiline and enc.lower() in ("utf-8", "windows-1252")
        whole = _read_long_lines(spark, paths, names, sep, enc) if by_line else _read_csv(spark, paths, names, sep, enc, multiline, line=True)
        whole = whole.where(f"{EXTRA} is not null")
        cells = F.to_csv(F.struct(*[col(n) for n in names], F.col(EXTRA)), {"sep": sep})
        rejected.append(whole.withColumn(LINE, F.coalesce(LINE, cells)).drop(EXTRA))
    if not parts:
        raise ValueError(f"no delimited text in {path}")
    together = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    warnings = [] if len(layouts) == 1 else [f"{len(layouts)} layouts (delimiter, encoding, header)"]
    return Source(together(parts), "csv", _named(path), warnings, together(rejected))


def header_names(header: str, sep: str) -> list[str]:
    """Column names of a header line, each of them different and none empty."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([header], delimiter=sep), [])):
        base = name if name.strip() else f"column_{i + 1}"
        new, k = base, 0
        # Spark doesn't tell names apart by case
        while new.lower() in {x.lower() for x in out}:
            k += 1
            new = f"{base}.{k}"
        out.append(new)
    return out


def _csv_options(names: list[str], sep: str) -> dict[str, str]:
    return {
        "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE, "maxColumns": str(max(20_480, 2 * len(names))),
    }


def _read_csv(spark, paths, names, sep, enc, multiline=False, line=False) -> DataFrame:
    # a cell beyond the header lands in the extra column; as one more column is never wanted, the parser gives
    # just the wanted cells and fills up short rows itself, which otherwise fail once for every missing cell
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, EXTRA, LINE if line else BEYOND)])
    latin = enc.lower() == "windows-1252"
    read = (
        spark.read.schema(schema)
        .options(**_csv_options(names, sep))
        .option("header", True)
        .option("encoding", "ISO-8859-1" if latin else enc)
        .option("multiLine", multiline)
        .option("enforceSchema", True)
        .csv(paths)
        .drop(BEYOND)
    )
    return read.withColumns({c: _as_cp1252(col(c)) for c in names}) if latin else read


def _read_long_lines(spark, paths, names, sep, enc) -> DataFrame:
    """The lines that can hold more cells than the header, as ``_read_csv`` gives them; the header holds no more than itself."""
    latin = enc.lower() == "windows-1252"
    text = spark.read.text(paths)
    if latin:
        text = text.select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("value"))
    long = text.where(_occurrences(F.col("value"), sep) >= len(names) * len(sep))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, EXTRA, LINE)])
    # a generator parses a line once, where fields of a parsed column would each parse it
    read = long.select(F.inline(F.array(F.from_csv("value", schema.toDDL(), _csv_options(names, sep)))))
    return read.withColumns({c: _as_cp1252(col(c)) for c in names}) if latin else read


# ---- JSON -----------------------------------------------------------------------


def read_json_records(spark: SparkSession, path: str, records_path: str | None = None, lines: bool = False) -> Source:
    """JSON as a flat all-string table.

    A root array gives its elements. Otherwise the shallowest array of objects (ties by
    name) is the table, unless ``records_path`` names one; without any, the root is one row.
    """
    reader = spark.read.option("primitivesAsString", True)
    raw = reader.option("multiLine", not lines).json(path)
    found = records_path or (None if lines else _first_record_array(raw.schema))
    warnings = []
    if found:
        raw = raw.select(F.explode(F.col(_quoted(found))).alias("record")).select("record.*")
    elif not lines and any(isinstance(f.dataType, T.StructType) for f in raw.schema):
        warnings.append("no record array found; the root object is the record")
    return Source(flatten_struct(raw), "json", _named(path), warnings)


def _quoted(path: str) -> str:
    return ".".join(f"`{p}`" for p in path.split("."))


def _first_record_array(schema: T.StructType, max_depth: int = 5) -> str | None:
    level = [("", schema)]
    for _ in range(max_depth + 1):
        below = []
        for prefix, struct in level:
            for f in sorted(struct.fields, key=lambda x: x.name):
                name = f"{prefix}.{f.name}" if prefix else f.name
                if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                    return name
                if isinstance(f.dataType, T.StructType):
                    below.append((name, f.dataType))
        level = below
    return None


def flatten_struct(df: DataFrame, joiner: str | None = None) -> DataFrame:
    """Nested fields as dotted columns; arrays as JSON text (or joined by ``joiner``)."""
    out = []

    def walk(prefix: list[str], struct: T.StructType) -> None:
        for f in struct.fields:
            path = [*prefix, f.name]
            if isinstance(f.dataType, T.StructType):
                walk(path, f.dataType)
                continue
            c = F.col(".".join(f"`{p}`" for p in path))
            if isinstance(f.dataType, T.ArrayType):
                simple = isinstance(f.dataType.elementType, T.StringType)
                c = F.array_join(c, joiner) if joiner is not None and simple else F.to_json(c)
            elif isinstance(f.dataType, T.MapType):
                c = F.to_json(c)
            out.append(c.alias(".".join(path)))

    walk([], df.schema)
    return df.select(*out)


# ---- XML ------------------------------------------------------------------------


def read_xml_records(spark: SparkSession, path: str | list[str], row_tag: str | None = None) -> Source:
    """XML as a flat all-string table; attributes and text become plain columns.

    Without ``row_tag`` the record element is found in each file; files that agree are read together, and a record of one
    layout has no values in the columns of another.
    """
    layouts = {row_tag: path} if row_tag else record_tags(spark, path)
    parts = []
    for tag, paths in sorted(layouts.items()):
        flat = flatten_struct(_read_xml(spark, tag, paths), joiner="|")
        parts.append(flat.toDF(*[_xml_name(c) for c in flat.columns]))
    warnings = [] if len(layouts) == 1 else [f"{len(layouts)} layouts (record element): {', '.join(sorted(layouts))}"]
    return Source(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts), "xml", _named(path), warnings)


def _read_xml(spark: SparkSession, tag: str, paths: str | list[str]) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("inferSchema", False).load(paths)


def _xml_name(name: str) -> str:
    parts = []
    for p in name.split("."):
        parts.append("value" if p == "_VALUE" else p[1:] if p.startswith("_") else p)
    return ".".join(parts)


def record_tags(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Record element to files: the shallowest element that occurs twice under one parent, else the root.

    Tasks stream the start tags of their files; one row per file reaches the driver.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tags = []
            for uri in pdf["path"]:
                with _open(uri) as f:
                    tags.append(record_tag(iter(lambda f=f: f.read(1 << 20), b"")))
            yield pd.DataFrame({"path": pdf["path"], "tag": tags})

    found = list_files(spark, path).where("length > 0").repartition("path").mapInPandas(find, "path string, tag string").collect()
    layouts: dict[str, list[str]] = {}
    for r in sorted(found):
        if r["tag"]:
            layouts.setdefault(r["tag"], []).append(r["path"])
    if not layouts:
        raise ValueError(f"no XML element in {path}")
    return layouts


_MARKUP = re.compile(
    rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?!--|\[)[^>]*>|<(?P<end>/)?(?P<name>[A-Za-z_][\w:.-]*)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", re.S
)


def record_tag(chunks: Iterator[bytes], enough: int = TAG_BYTES) -> str | None:
    """The record element of one document, given in pieces; None if it has no element.

    An element that repeats below the root ends the search. A deeper one wins at the end of the document, or
    once ``enough`` bytes hold none above it.
    """
    counts: list[dict[bytes, int]] = [{}]
    best: tuple[int, bytes] | None = None
    root, rest, seen = None, b"", 0
    for chunk in chunks:
        seen += len(chunk)
        text, at = rest + chunk, 0
        for m in _MARKUP.finditer(text):
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            if m["end"]:
                if len(counts) > 1:
                    counts.pop()
                continue
            root = root or name
            depth = len(counts) - 1
            counts[-1][name] = counts[-1].get(name, 0) + 1
            if depth and counts[-1][name] == 2 and (best is None or depth < best[0]):
                best = (depth, name)
                if depth == 1:
                    return name.decode("utf-8", "replace")
            if not m[0].endswith(b"/>"):
                counts.append({})
        # markup may be cut by the end of the piece
        cut = text.rfind(b"<", at)
        rest = text[cut:] if cut >= 0 else b""
        if best and seen >= enough:
            break
    tag = best[1] if best else root
    return tag.decode("utf-8", "replace") if tag else None


# ---- dispatch -------------------------------------------------------------------


def supported_formats() -> list[str]:
    return sorted(FORMATS)


def read_any(spark: SparkSession, path: str, **options) -> Source:
    """Read by file extension; a folder's files are read by theirs, and the tables united by column name."""
    kind = FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if kind is not None:
        return _read_as(spark, kind, path, options)
    groups: dict[str, list[str]] = {}
    try:
        files = list_files(spark, path).where("length > 0").select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"no folder, and no supported file type: {path}") from e
    # one row per input file
    for r in files.collect():
        name = os.path.basename(r["path"])
        if not name.startswith(("_", ".")):
            groups.setdefault(FORMATS.get(os.path.splitext(name)[1].lower(), ""), []).append(r["path"])
    others = groups.pop("", [])
    if not groups:
        raise ValueError(f"unsupported file type: {path}")
    sources = [_read_as(spark, k, sorted(paths), options) for k, paths in sorted(groups.items())]
    warnings = [w for s in sources for w in s.notes]
    if others:
        warnings.append(f"{len(others)} files of other types")
    if len(sources) == 1:
        return Source(sources[0].df, sources[0].format, path, warnings, sources[0].rejected)
    texts = [s.df.select(*[col(c).cast("string").alias(c) for c in s.df.columns]) for s in sources]
    rejected = next((s.rejected for s in sources if s.rejected is not None), None)
    union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), texts)
    return Source(union, "+".join(s.format for s in sources), path, warnings, rejected)


def _named(path: str | list[str]) -> str:
    return path if isinstance(path, str) else ",".join(path)


def _read_as(spark: SparkSession, kind: str, path: str | list[str], options: dict) -> Source:
    if kind == "csv":
        return read_delimited(spark, path, **options)
    if kind in ("json", "jsonl"):
        return read_json_records(spark, path, lines=kind == "jsonl", **options)
    if kind == "xml":
        return read_xml_records(spark, path, **options)
    return Source(spark.read.parquet(*([path] if isinstance(path, str) else path)), "parquet", _named(path))


# ---- after reading --------------------------------------------------------------


def ingest_normalize(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Strip column names; drop columns, then rows, that hold nothing but blanks."""
    df = df.toDF(*[c.strip() for c in df.columns])
    filled = {c: F.nullif(F.trim(col(c).cast("string")), F.lit("")) for c in df.columns}
    used = df.agg(*[F.bool_or(v.isNotNull()).alias(f"u{i}") for i, v in enumerate(filled.values())]).first()
    kept = [c for i, c in enumerate(df.columns) if used[f"u{i}"]]
    out = df.select(*[col(c) for c in kept])
    if kept:
        out = out.where(F.coalesce(*[filled[c] for c in kept]).isNotNull())
    return with_row_id(out, row_id) if row_id else out


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Add a unique row number, not dense.

    Inside one file it follows the file. Between files the order is arbitrary but fixed
    as long as the files and the split size do not change.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def file_metadata(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(file_name, format, encoding, size_bytes, row_count, col_count, rejected_rows) per file."""
    if fmt == "csv":
        layouts: dict[tuple[str, str, str], list[str]] = {}
        for r in sniff_files(spark, path).collect():
            layouts.setdefault((r["delimiter"], r["encoding"], r["header"]), []).append(r["path"])
        parts = []
        for (sep, enc, header), paths in sorted(layouts.items()):
            names = header_names(header, sep)
            df = _read_csv(spark, paths, names, sep, enc)
            parts.append(_per_file(df, fmt, enc, len(names), F.col(EXTRA).isNotNull()))
        return reduce(DataFrame.unionByName, parts)
    if fmt in ("json", "jsonl"):
        # a document may be a whole file, a line is a record
        df = spark.read.option("primitivesAsString", True).option("multiLine", fmt == "json").json(path)
        return _per_file(df, fmt, "UTF-8", len(df.columns))
    if fmt == "xml":
        read = [_read_xml(spark, tag, paths) for tag, paths in sorted(record_tags(spark, path).items())]
        return reduce(DataFrame.unionByName, [_per_file(df, fmt, "UTF-8", len(df.columns)) for df in read])
    df = spark.read.parquet(path)
    return _per_file(df, fmt, None, len(df.columns))


def _per_file(df: DataFrame, fmt: str, encoding: str | None, columns: int, bad: Column | None = None) -> DataFrame:
    bad = F.lit(False) if bad is None else bad
    named = df.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("size_bytes"), bad.alias("bad"))
    counts = named.groupBy("file_name", "size_bytes").agg(F.count_if(~F.col("bad")).alias("row_count"), F.count_if("bad").alias("rejected_rows"))
    return counts.select(
        "file_name",
        F.lit(fmt).alias("format"),
        F.lit(encoding).cast("string").alias("encoding"),
        "size_bytes",
        "row_count",
        F.lit(columns).alias("col_count"),
        "rejected_rows",
    )


def content_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file; of a folder, that of its files' names and hashes in order of name."""
    files = sorted((r["file_name"], r["sha256"]) for r in file_hashes(spark, path).collect())
    if len(files) == 1:
        return files[0][1]
    return hashlib.sha256("\n".join(f"{sha} {name}" for name, sha in files).encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, sha256) per file; files are streamed through the tasks in chunks."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for uri in pdf["path"]:
                sha = hashlib.sha256()
                with _open(uri) as f:
                    while chunk := f.read(8 << 20):
                        sha.update(chunk)
                out.append(sha.hexdigest())
            yield pd.DataFrame({"path": pdf["path"], "sha256": out})

    hashed = list_files(spark, path).repartition("path").mapInPandas(digest, "path string, sha256 string")
    return hashed.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "sha256")
