"""Sources and sinks (SRC-1..13).

Parsing is expressed as column expressions (``regexp_extract`` / ``rlike``)
on ``spark.read.text`` / ``spark.read.csv`` output, so Catalyst prunes fields
a plan never uses and the work stays in the JVM.
"""

from __future__ import annotations

import csv
import io
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..rowid import ROW_ID

# The two line layouts (Python syntax) and the level keywords.
NGINX_LINE = (r'(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d{3})\s+(\S+)'
              r'(?:\s+"([^"]*)"\s+"([^"]*)")?')
NGINX_FIELDS = ["remote_addr", "event_time", "method", "path", "protocol", "status_code", "bytes_sent",
                "referer", "user_agent"]
GENERIC_LINE = (r"^(\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s+([A-Z]+)\s+"
                r"(?:([\w.\-]+)\s+)?(.*)$")
LEVEL_WORD = r"\b(INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL|CRITICAL)\b"

# Fixed value: text cells pandas' CSV reader treats as missing by default.
CSV_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                 "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _j(pattern: str) -> str:
    return "(?u)" + tx.py_regex_to_java(pattern)


# ------------------------------------------------------------------- headers

def clean_header(names: list[str]) -> list[str]:
    """SRC-7: strip, blank -> 'unnamed', whitespace runs -> '_', duplicates get _2, _3..."""
    cleaned = ["_".join(str(n).split()) or "unnamed" for n in names]
    return [c if k == 0 else f"{c}_{k + 1}" for c, k in zip(cleaned, (cleaned[:i].count(c) for i, c in enumerate(cleaned)))]


# ----------------------------------------------------------------------- CSV

def infer_column_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """One aggregate over the text columns: long if every value parses as an integer,
    double if every value parses as a number, else string."""
    aggs = []
    for c in columns:
        v = F.col(c)
        aggs.append(F.count_if(v.isNotNull() & v.try_cast("long").isNull()).alias(f"{c}\u0001l"))
        aggs.append(F.count_if(v.isNotNull() & v.try_cast("double").isNull()).alias(f"{c}\u0001d"))
        aggs.append(F.count_if(v.isNotNull() & ~F.lower(v).isin("true", "false")).alias(f"{c}\u0001b"))
        aggs.append(F.count(v).alias(f"{c}\u0001n"))
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    types = {}
    for c in columns:
        if row[f"{c}\u0001n"] == 0:
            types[c] = "string"
        elif row[f"{c}\u0001l"] == 0:
            types[c] = "long"
        elif row[f"{c}\u0001d"] == 0:
            types[c] = "double"
        elif row[f"{c}\u0001b"] == 0:
            types[c] = "boolean"
        else:
            types[c] = "string"
    return types


def pandas_header_names(raw: list[str | None]) -> list[str]:
    """Header names as pandas' CSV reader produces them: blank -> 'Unnamed: i', repeats -> 'name.k'."""
    names = [h if h not in (None, "") else f"Unnamed: {i}" for i, h in enumerate(raw)]
    counts: dict[str, int] = {}
    out = []
    for col in names:
        cur = counts.get(col, 0)
        while cur > 0:
            counts[col] = cur + 1
            col = f"{col}.{cur}"
            cur = counts.get(col, 0)
        out.append(col)
        counts[col] = cur + 1
    return out


CSV_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """SRC-1 (+SRC-7, trap 27): header row, pandas missing-value tokens, then type inference.

    Quoted cells may hold separators, doubled quotes and line breaks; files are read by all their splits at once
    (``csv_records``).  The header is that of the first file by name, every file's first record is its header; cells
    beyond the header are left out, missing ones are null.  UTF-8, records end with a line feed."""
    from .csv_records import csv_records, header_record
    records, first = csv_records(spark, path)
    header = header_record(spark, first) if first is not None else None
    if header is None:
        return spark.createDataFrame([], T.StructType([]))
    cells = next(csv.reader(io.StringIO(header, newline="")), [])
    count, names = len(cells), clean_header(pandas_header_names(cells))
    shape = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(count)])
    parsed = records.where("NOT head").select(F.from_csv("record", shape.simpleString()[7:-1].replace(":", " "), CSV_OPTIONS).alias("c"))
    cleaned = parsed.select(*[F.when(F.col(f"c.c{k}").isin(CSV_NA_TOKENS), F.lit(None)).otherwise(F.col(f"c.c{k}")).alias(n)
                              for k, n in enumerate(names)])
    if not infer:
        return cleaned
    types = infer_column_types(cleaned, names)
    return cleaned.select(*[F.col(c).cast(types[c]).alias(c) if types[c] != "string" else F.col(c)
                            for c in names])


# ------------------------------------------------------------------ text logs

def read_lines(spark: SparkSession, path: str, rid: str = ROW_ID) -> DataFrame:
    """SRC-2: lines in file order, stripped, blank lines dropped; (rid, line)."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__path"),
                                       F.col("_metadata.file_block_start").alias("__start"),
                                       F.monotonically_increasing_id().alias("__m"))
    # a block lies in one partition, where ids ascend; blocks are numbered by file name and position (one
    # row per block), so that ids follow the files whatever partitions the blocks were packed into
    order = F.row_number().over(Window.orderBy("__path", "__start"))
    blocks = raw.select("__path", "__start").distinct().select("__path", "__start", order.cast("long").alias("__block"))
    low = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return (raw.join(blocks, ["__path", "__start"])
            .select((F.shiftleft(F.col("__block"), 33) + low).alias(rid), tx.py_strip(F.col("value")).alias("line"))
            .where(F.length("line") > 0))


def normalize_scalar(c: Column) -> Column:
    """SRC-6: '-' or null -> null; digits -> integer."""
    s = c.cast("string")
    return F.when(s.rlike(r"^[0-9]+$"), s.try_cast("long"))


_SEP = "\u0001"


def parse_nginx(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """SRC-3: access-line fields; unmatched lines keep only raw_line with log_type generic_log.

    Two regex passes per line: one ``rlike`` for the match and one
    ``regexp_replace`` that rewrites a matching line into a delimited record of
    all groups (a tail marker group tells a missing referer/agent pair apart
    from empty quotes)."""
    line = F.col(line_col)
    head, tail = NGINX_LINE.split("(?:", 1)
    record_pattern = _j("^" + head + "(" + tail.rsplit(")?", 1)[0] + ")?") + "(?s:.*)$"
    # groups: 1..7 head fields, 8 tail wrapper, 9 referer, 10 user agent
    replacement = _SEP.join(["$1", "$2", "$3", "$4", "$5", "$6", "$7", "$9", "$10", "$8"])
    others = [c for c in lines.columns if c != line_col]
    # the record is its own projection: a value used inside several CASE branches is not
    # shared by subexpression elimination, so it would be recomputed per field
    staged = lines.select(*others, line.alias("__line"), line.rlike(_j("^" + NGINX_LINE)).alias("__m"),
                          # a line that holds the separator itself is taken apart group by group
                          F.when(line.contains(_SEP), F.array(*[F.regexp_extract(line, record_pattern, g)
                                                                for g in (1, 2, 3, 4, 5, 6, 7, 9, 10, 8)]))
                          .otherwise(F.split(F.regexp_replace(line, record_pattern, replacement), _SEP, -1)).alias("__rec"))
    rec, matched = F.col("__rec"), F.col("__m")
    has_tail = F.element_at(rec, 10) != ""
    fields = {}
    for i, name in enumerate(NGINX_FIELDS, start=1):
        v = F.element_at(rec, i)
        if name in ("referer", "user_agent"):
            v = F.when(has_tail, v)
        if name in ("status_code", "bytes_sent"):
            v = normalize_scalar(v)
        fields[name] = F.when(matched, v)
    return staged.select(*others, *[v.alias(k) for k, v in fields.items()],
                         F.when(matched, F.lit("nginx_access")).otherwise(F.lit("generic_log")).alias("log_type"),
                         F.col("__line").alias("raw_line"))


def parse_generic(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """SRC-4: time / level / source / message; fallback: first level keyword, message = line."""
    line = F.col(line_col)
    pat = _j(GENERIC_LINE)
    matched = line.rlike(pat)
    level_any = F.regexp_extract(line, _j(LEVEL_WORD), 1)
    others = [c for c in lines.columns if c != line_col]
    return lines.select(
        *others,
        F.when(matched, F.regexp_extract(line, pat, 1)).alias("event_time"),
        F.when(matched, F.regexp_extract(line, pat, 2)).otherwise(F.nullif(level_any, F.lit(""))).alias("level"),
        F.when(matched, F.nullif(F.regexp_extract(line, pat, 3), F.lit(""))).alias("source"),
        F.when(matched, F.regexp_extract(line, pat, 4)).otherwise(line).alias("message"),
        F.lit("generic_log").alias("log_type"),
        line.alias("raw_line"),
    )


def detect_format(lines: DataFrame, rid: str = ROW_ID, line_col: str = "line") -> DataFrame:
    """SRC-5: one row (sample_size, nginx_matches, profile) from the first 10 lines."""
    sample = lines.orderBy(rid).limit(10)
    agg = sample.agg(F.count(F.lit(1)).alias("sample_size"),
                     F.count_if(F.col(line_col).rlike(_j("^" + NGINX_LINE))).alias("nginx_matches"))
    return agg.select("sample_size", "nginx_matches",
                      F.when((F.col("sample_size") > 0) & (F.col("nginx_matches") >= F.greatest(
                          F.lit(2), F.floor(F.col("sample_size") / 2))), F.lit("nginx_access"))
                      .otherwise(F.lit("generic_log")).alias("profile"))


def read_text_log(spark: SparkSession, path: str, profile: str | None = None, rid: str = ROW_ID) -> DataFrame:
    """SRC-2..6: read a text log and parse it with the given or detected profile."""
    lines = read_lines(spark, path, rid)
    if profile is None:
        det = detect_format(lines, rid).first()
        if det is None or det["sample_size"] == 0:
            raise ValueError("The uploaded file is empty")
        profile = det["profile"]
    if profile == "nginx_access":
        return parse_nginx(lines)
    return parse_generic(lines)


# -------------------------------------------------------------- parquet & sinks

def read_parquet(spark: SparkSession, path: str, limit: int | None = None, order_by: str | None = None) -> DataFrame:
    """SRC-8/9: full scan, or a bounded preview (limit clamped to 1..50, total order first)."""
    df = spark.read.parquet(path)
    if limit is None:
        return df
    n = max(1, min(int(limit), 50))
    return (df.orderBy(order_by) if order_by else df).limit(n)


def new_artifact_path(base: str, prefix: str) -> str:
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def write_parquet(df: DataFrame, base: str, prefix: str = "dataset") -> str:
    """SRC-10: write to a fresh directory, never overwriting an earlier artifact."""
    path = new_artifact_path(base, prefix)
    df.write.mode("errorifexists").parquet(path)
    return path


def projected_copy(df: DataFrame, base: str, include=None, exclude=None, rename=None) -> str:
    """SRC-11: include / exclude / rename pushed into the scan, then copied to Parquet."""
    from ..operators.preprocess import apply_import_cleaning
    return write_parquet(apply_import_cleaning(df, include, exclude, rename), base, "staging")


def json_records(df: DataFrame) -> DataFrame:
    """SRC-13: one JSON object per row; timestamps as epoch milliseconds, NaN as null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_millis(c.cast("timestamp"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record"))
