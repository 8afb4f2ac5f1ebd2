"""Readers: delimited and JSON text, JSON objects too large for one parse, archives, vectors."""

from __future__ import annotations

import hashlib
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievewright.session import BROADCAST_ROWS

#: Characters read at a time from a large JSON file.
CHUNK = 1 << 20


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; a byte-order mark before the first header name is dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns if c.startswith("\ufeff")})


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped, anything else fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"))
    wrong = F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))
    return parsed.select(F.when(F.trim("value").startswith("{"), F.col("row")).otherwise(wrong).alias("row")).select("row.*")


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | str, required: str = "contents") -> DataFrame:
    """A JSONL corpus; a document without its contents, or an empty corpus, is an error."""
    df = read_jsonl(spark, path, schema)
    if df.where(F.col(required).isNull() | (F.trim(F.col(required)) == "")).limit(1).count():
        raise ValueError(f"{path} has documents without {required}")
    if df.isEmpty():
        raise ValueError(f"{path} is empty")
    return df


def read_any(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet and JSON files by their suffix, concatenated by column name."""
    out = None
    for path in paths:
        if path.rstrip("/").endswith(".parquet"):
            df = spark.read.parquet(path)
        elif path.endswith((".json", ".jsonl")):
            df = spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)
        else:
            raise ValueError(f"{path} is neither Parquet nor JSON")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def read_preferences(spark: SparkSession, paths: Sequence[str], chosen: str = "chosen", rejected: str = "rejected", most: int | None = None, seed: int = 0) -> DataFrame:
    """Chosen and rejected texts; with `most`, a reproducible sample of that many pairs."""
    df = spark.read.parquet(*paths).select(chosen, rejected)
    return df.orderBy(F.xxhash64(F.lit(seed), chosen, rejected)).limit(most) if most is not None else df


_REST = re.compile(r"[0-9.eE+-]*")
_BRACKET, _QUOTE_END = re.compile(r'["\[\]{}]'), re.compile(r'\\.|"', re.S)


def json_members(stream: io.TextIOBase, wanted: set[str] | None = None) -> Iterator[tuple[str, Any]]:
    """(key, element) of a top-level object of arrays, (key, value) of other members, read in chunks.

    Elements of an array come one by one, so memory holds one element, not the file. Unwanted members are read over.
    """
    decoder, buffer, at, ended = json.JSONDecoder(), "", 0, False

    def more(size: int = CHUNK) -> bool:
        nonlocal buffer, at, ended
        piece = stream.read(size)
        ended = not piece
        buffer, at = buffer[at:] + piece, 0
        return not ended

    def peek() -> str:
        nonlocal at
        while True:
            while at < len(buffer) and buffer[at] in " \t\r\n\ufeff":
                at += 1
            if at < len(buffer):
                return buffer[at]
            if not more():
                raise ValueError("the JSON text ends early")

    def take(ch: str) -> None:
        nonlocal at
        if peek() != ch:
            raise ValueError(f"expected {ch!r}, found {buffer[at]!r}")
        at += 1

    def value() -> Any:
        nonlocal at
        peek()
        size = CHUNK
        while True:
            try:
                found, end = decoder.raw_decode(buffer, at)
            except ValueError:
                if not more(size):
                    raise
                size *= 2  # an element of many chunks is parsed a few times, not once a chunk
                continue
            if not ended and not isinstance(found, str | dict | list) and _REST.fullmatch(buffer, end) and more():
                continue  # a number may go on in the next chunk
            at = end
            return found

    def skip() -> None:
        """Reads over a value by its quotes and brackets only."""
        nonlocal at
        depth, quoted = 0, False
        first = peek()
        if first not in '"[{':
            value()
            return
        while True:
            m = (_QUOTE_END if quoted else _BRACKET).search(buffer, at)
            if m is None:
                # an escape may be cut in two at the end of the buffer; whole ones were found before
                at = len(buffer) - int(quoted and at < len(buffer) and buffer.endswith("\\"))
                if not more():
                    raise ValueError("the JSON text ends early")
                continue
            at = m.end()
            if quoted:
                quoted = m[0] != '"'
            elif m[0] == '"':
                quoted = True
            else:
                depth += 1 if m[0] in "[{" else -1
            if not quoted and depth == 0:
                return

    take("{")
    if peek() == "}":
        return
    while True:
        key = value()
        take(":")
        if wanted is not None and key not in wanted:
            skip()
        elif peek() == "[":
            take("[")
            while peek() != "]":
                yield key, value()
                if peek() == ",":
                    take(",")
            take("]")
        else:
            yield key, value()
        if peek() == "}":
            return
        take(",")


class _JsonReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.wanted = set(options["keys"].split(",")) if options.get("keys") else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        opener = open_json(partition.value)
        with opener as stream:
            numbers: dict[str, int] = {}
            for key, element in json_members(stream, self.wanted):
                numbers[key] = numbers.get(key, 0) + 1
                yield key, numbers[key], json.dumps(element, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class JsonObjectSource(DataSource):
    """spark.read.format("json_object"): (key, position, element) of files that are one JSON object of arrays or pages.

    Options: path (comma-separated, each file is a partition), keys (members to read; others are read over unparsed). Paths may be of any file system that Arrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "json_object"

    def schema(self) -> str:
        return "key string, position int, element string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _JsonReader(self.options)


def open_binary(path: str, seekable: bool = True):
    """A binary file of any file system that Arrow knows; a path without a scheme is local or on shared storage."""
    system, name = pafs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*:/", path) else (pafs.LocalFileSystem(), path)
    return system.open_input_file(name) if seekable else system.open_input_stream(name)


def open_json(path: str) -> io.TextIOBase:
    """A JSON file, plain or the only .json member of a ZIP archive."""
    stream = open_binary(path)
    if stream.read(4) != b"PK\x03\x04":
        stream.seek(0)
        return io.TextIOWrapper(stream, encoding="utf-8-sig")
    stream.seek(0)
    archive = zipfile.ZipFile(stream)
    members = [n for n in archive.namelist() if n.lower().endswith(".json")]
    if len(members) != 1:
        raise ValueError(f"{path} holds {len(members)} .json members, not one")
    return io.TextIOWrapper(archive.open(members[0]), encoding="utf-8-sig")


def read_tar_members(spark: SparkSession, path: str, wanted: DataFrame | None = None, name: str = "member") -> DataFrame:
    """(archive, member, size, content) of the regular files in TAR archives; unsafe names fail, `wanted` names restrict.

    An archive is read as a stream, one member in memory; the bytes of unwanted members are read over, where the wanted names
    are few enough to be sent to the readers, else they are joined.
    """
    from sievewright.functions.text import is_safe_member

    files = spark.read.format("binaryFile").load(path).select("path")  # contents aren't read
    names = None
    if wanted is not None:
        listed = [r[0] for r in wanted.select(name).distinct().limit(BROADCAST_ROWS + 1).collect()]
        names = frozenset(listed) if len(listed) <= BROADCAST_ROWS else None

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["path"]:
                with open_binary(archive, seekable=False) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
                    for m in tar:
                        if m.isfile():
                            content = tar.extractfile(m).read() if names is None or m.name in names else None
                            yield pd.DataFrame([(archive, m.name, m.size, content)], columns=["archive", "member", "size", "content"])

    df = files.repartition(F.col("path")).mapInPandas(members, "archive string, member string, size long, content binary")
    df = df.withColumn("member", F.when(is_safe_member("member"), F.col("member")).otherwise(F.raise_error(F.concat(F.lit("unsafe member "), F.col("member")))))
    if names is not None:
        return df.where("content is not null")
    return df.join(wanted.select(F.col(name).alias("member")), "member", "left_semi") if wanted is not None else df


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of every file below a path, digested where it is read, chunk by chunk."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name in frame["path"]:
                h = hashlib.sha256()
                with open_binary(name, seekable=False) as stream:
                    while piece := stream.read(1 << 20):
                        h.update(piece)
                out.append(h.hexdigest())
            yield frame.assign(sha256=out)

    return files.mapInPandas(digest, "path string, size long, sha256 string")


def folder_fingerprint(spark: SparkSession, path: str) -> str:
    """One digest of a folder: of its files' relative names, sizes and digests, in the order of their names."""
    rows = file_digests(spark, path).orderBy("path")
    common, h = None, hashlib.sha256()
    for r in rows.toLocalIterator():
        if common is None:
            mark = path.rstrip("/").rpartition("/")[2]
            common = r["path"].find(f"/{mark}/") + len(mark) + 2
        h.update(f"{r['path'][common:]}\0{r['size']}\0{r['sha256']}\n".encode())
    return h.hexdigest()


def is_image(content: str = "content"):
    """Whether binary content begins like a PNG, JPEG, GIF, BMP or WebP file."""
    head = F.hex(F.substring(content, 1, 12))
    return F.coalesce(head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF") | head.startswith("47494638") | head.startswith("424D") | head.rlike("^52494646.{8}57454250"), F.lit(False))


def read_vectors(spark: SparkSession, path: str, rows: int, dim: int, block: int = 8192) -> DataFrame:
    """(row_no, vector) of a raw float32 matrix on shared storage; its size must fit rows x dim."""
    with open_binary(path) as stream:
        if stream.size() != rows * dim * 4:
            raise ValueError(f"{path} isn't {rows} x {dim} float32 values")
    starts = spark.range(0, max(1, -(-rows // block)), 1, max(1, min(256, -(-rows // block)))).select((F.col("id") * block).alias("start"))

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open_binary(path) as stream:
            for frame in frames:
                for start in frame["start"]:
                    n = max(0, min(block, rows - int(start)))
                    stream.seek(int(start) * dim * 4)
                    part = np.frombuffer(stream.read(n * dim * 4), dtype="<f4").reshape(n, dim)
                    yield pd.DataFrame({"row_no": np.arange(start, start + n), "vector": list(part)})

    return starts.mapInPandas(load, "row_no long, vector array<float>")
