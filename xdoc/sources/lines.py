"""Line-delimited documents. Blank lines are skipped but counted; a last line needs no end.

Modes: FAILFAST fails the query, DROPMALFORMED leaves bad lines out, PERMISSIVE
keeps them as rows with ``_error`` and ``_line`` and a null document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import binary, text
from ..functions.register import call
from ..text import ParseError, ParseOptions

MODES = ("FAILFAST", "DROPMALFORMED", "PERMISSIVE")
MAX_LINE = 1 << 20
_RESULT = "d binary, code string, message string, position int, line int, column int"


def attempt(options: ParseOptions = ParseOptions(), max_line: int = MAX_LINE):
    """Text to a struct of the canonical document or what is wrong."""
    def one(t: str | None):
        if t is None or not t.strip():
            return (None,) * 6
        if len(t) > max_line:
            return None, "line_length", f"line of {len(t)} characters, {max_line} at most", 0, 1, 1
        try:
            return binary.encode(text.parse(t, options)), None, None, None, None, None
        except ParseError as e:
            return None, e.code, str(e), e.position, e.line, e.column

    @F.pandas_udf(_RESULT)
    def run(column: pd.Series) -> pd.DataFrame:
        found = list(zip(*map(one, column), strict=True)) or [()] * 6
        return pd.DataFrame({n: pd.Series(x, dtype=k) for n, x, k in zip(("d", "code", "message", "position", "line", "column"), found, [object] * 3 + ["Int32"] * 3, strict=True)})

    return run


def parse_lines(lines: DataFrame, column: str = "value", mode: str = "PERMISSIVE", options: ParseOptions = ParseOptions(), max_line: int = MAX_LINE) -> DataFrame:
    """``lines`` with ``document`` in place of the text column, and in PERMISSIVE mode ``_error`` and ``_line``. Works on streams."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    rest = [c for c in lines.columns if c != column]
    got = lines.where(F.col(column).rlike(r"\S")).withColumn("__r", attempt(options, max_line)(F.col(column)))
    bad = F.col("__r.code").isNotNull()
    if mode == "DROPMALFORMED":
        return got.where(~bad).select(*rest, F.col("__r.d").alias("document"))
    if mode == "FAILFAST":
        where = F.concat(F.lit("Parse error on line"), F.coalesce(F.concat(F.lit(" "), F.col("_line_number").cast("string")), F.lit("")) if "_line_number" in rest else F.lit(""), F.lit(": "), F.col("__r.message"))
        return got.select(*rest, F.when(bad, F.raise_error(where).cast("binary")).otherwise(F.col("__r.d")).alias("document"))
    error = F.when(bad, F.struct("__r.code", "__r.message", "__r.position", "__r.line", "__r.column"))
    return got.select(*rest, F.col("__r.d").alias("document"), error.alias("_error"), F.when(bad, F.col(column)).alias("_line"))


def read(spark: SparkSession, path: str, mode: str = "PERMISSIVE", line_numbers: bool = False, **options) -> DataFrame:
    """Documents of text files, which are split, also with line numbers.

    A line's number is its place in its split after the lines of the file's splits before; these are
    counted by a first pass over the same splits. Bytes that are no UTF-8 become U+FFFD.
    """
    rows = spark.read.text(path, lineSep="\n")
    if not line_numbers:
        return parse_lines(rows, mode=mode, **options)
    split = ["__path", "__start"]
    rows = rows.select("value", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    name = F.regexp_replace("__path", r"\+", "%2B")  # a path as it is, from its URI
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = rows.groupBy(*split).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")).select(*split, "__first", "__n", before.alias("__before"), F.url_decode(name).alias("_file"))
    at = F.col("__at") - F.col("__first")
    known = F.coalesce((at >= 0) & (at < F.col("__n")), F.lit(False))
    number = F.when(known, at + F.col("__before") + 1).otherwise(F.raise_error(F.lit("files were split in another way than when their lines were counted: set spark.sql.files.minPartitionNum")).cast("long"))
    numbered = rows.join(F.broadcast(splits), split, "left").select("_file", number.alias("_line_number"), F.make_valid_utf8("value").alias("value"))
    return parse_lines(numbered, mode=mode, **options)


def read_whole(spark: SparkSession, path: str, mode: str = "FAILFAST", **options) -> DataFrame:
    """One document per file."""
    return parse_lines(spark.read.text(path, wholetext=True), mode=mode, **options)


def read_stream(spark: SparkSession, path: str, mode: str = "PERMISSIVE", **options) -> DataFrame:
    return parse_lines(spark.readStream.text(path, lineSep="\n"), mode=mode, **options)


def to_lines(df: DataFrame, document: str | Column = "document") -> DataFrame:
    """A text column ``value`` of canonical documents; null documents are left out."""
    d = F.col(document) if isinstance(document, str) else document
    return df.select(call("stringify", d).alias("value")).where("value IS NOT NULL")


def write(df: DataFrame, path: str, document: str = "document", delimiter: str = "\n") -> None:
    to_lines(df, document).write.mode("overwrite").text(path, lineSep=delimiter)


def write_stream(df: DataFrame, path: str, checkpoint: str, document: str = "document"):
    """A stream of documents as text files; the checkpoint makes each line stand once."""
    return to_lines(df, document).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad ones of a PERMISSIVE table."""
    return df.where("_error IS NULL").drop("_error", "_line"), df.where("_error IS NOT NULL").drop("document")
