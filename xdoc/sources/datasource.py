"""``spark.read.format("xdocl")`` and ``df.write.format("xdocl")``: local files with line numbers, as a Python data source.

A write's files are hidden until all tasks have ended, so tasks that fail or run
twice leave nothing; ``overwrite`` removes the older files then. A document that
can't be written ends the write, or is left out with the option ``skipInvalid``.

For stores that only Spark reads, use ``lines.read(..., line_numbers=True)``.
"""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import binary, text


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.skip = options["path"], str(options.get("skipinvalid", "false")).lower() == "true"
        self.longest = int(options.get("maxlinelength", 1 << 20))

    def partitions(self):
        files = sorted(p for p in glob.glob(os.path.join(self.path, "*")) if os.path.isfile(p) and not os.path.basename(p).startswith(("_", "."))) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in files]

    def read(self, partition):
        with open(partition.value, encoding="utf-8", newline="\n") as f:
            for number, line in enumerate(f, 1):
                line = line.rstrip("\n")
                if not line.strip():
                    continue
                try:
                    if len(line) > self.longest:
                        raise ValueError(f"line of {len(line)} characters, {self.longest} at most")
                    yield binary.encode(text.parse(line)), number, None, None
                except ValueError as e:
                    if not self.skip:
                        raise ValueError(f"Parse error on line {number}: {e}") from e
                    yield None, number, str(e), line


@dataclass
class _Part(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    def __init__(self, options, overwrite):
        self.path, self.delimiter, self.overwrite = options["path"], options.get("delimiter", "\n"), overwrite
        self.skip = str(options.get("skipinvalid", "false")).lower() == "true"

    def _hidden(self, name):
        return Path(self.path, f".{name}")

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        part = _Part(f"part-{uuid.uuid4().hex}.xdocl")
        try:
            with open(self._hidden(part.name), "w", encoding="utf-8", newline="") as f:
                for row in rows:
                    if row[0] is None:
                        continue
                    try:
                        line = text.stringify(binary.decode(bytes(row[0])))
                    except ValueError:
                        if not self.skip:
                            raise
                        continue
                    f.write(line + self.delimiter)
        except BaseException:
            self._hidden(part.name).unlink(missing_ok=True)
            raise
        return part

    def commit(self, messages):
        old = list(Path(self.path).glob("part-*.xdocl")) if self.overwrite else []
        for part in filter(None, messages):
            os.replace(self._hidden(part.name), Path(self.path, part.name))
        for file in old:
            file.unlink(missing_ok=True)

    def abort(self, messages):
        for part in filter(None, messages):
            self._hidden(part.name).unlink(missing_ok=True)


class LinesDataSource(DataSource):
    @classmethod
    def name(cls):
        return "xdocl"

    def schema(self):
        return "document binary, line_number long, error string, line string"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LinesDataSource)
