"""Packages whose bytes depend on the rows alone: ordered gzip shards, copies and ZIP archives.

A Python data source writes the shards: tasks write files of their own under a temporary
folder, and the driver's commit renames those of the tasks that succeeded, so that a failed
or repeated task leaves nothing. Files go through a file system by its URI, local or remote.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zipfile
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from corpuloom.session import ship
from corpuloom.sources.sinks import row_targets, with_shard

#: All members of archives bear this time.
ZIP_TIME = (1980, 1, 1, 0, 0, 0)
CHUNK = 1 << 20


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def shard_name(name: str, shard: int, shards: int) -> str:
    return f"{name}-{shard:05d}-of-{shards:05d}.jsonl.gz"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: shard, temporary path, rows, bytes and SHA-256."""

    files: list


class _Counted:
    """A stream that counts and digests what is written to it."""

    def __init__(self, out):
        self.out, self.bytes, self.digest = out, 0, hashlib.sha256()

    def write(self, data) -> int:
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


class GzipShardWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.name, self.shards = options["path"].rstrip("/"), options["name"], int(options["shards"])
        self.level, self.job = int(options.get("level", 9)), options["job"]

    def _temporary(self) -> str:
        return f"{self.path}/_temporary-{self.job}"

    def write(self, iterator) -> Written:
        files, current, target = [], None, None
        system, folder = filesystem(self._temporary())
        system.create_dir(folder, recursive=True)

        def close():
            if current is not None:
                target[1].close()
                target[2].close()
                files.append((current, target[0], target[3], target[4].bytes, target[4].digest.hexdigest()))

        for row in iterator:
            if row["shard"] != current:
                close()
                path = f"{folder}/{uuid.uuid4().hex}"
                raw = system.open_output_stream(path, compression=None)
                counted = _Counted(raw)
                # No name and no time in the header: equal lines give equal bytes.
                current, target = row["shard"], [path, gzip.GzipFile("", "wb", self.level, counted, 0), raw, 0, counted]
            target[1].write(row["line"].encode("utf-8", "surrogatepass") + b"\n")
            target[3] += 1
        close()
        return Written(files)

    def commit(self, messages) -> None:
        system, folder = filesystem(self.path)
        done = {f[0]: f for m in messages if m is not None for f in m.files}
        manifest = []
        for shard in range(self.shards):
            name = shard_name(self.name, shard, self.shards)
            if shard in done:
                _, path, rows, size, digest = done[shard]
                system.move(path, f"{folder}/{name}")
            else:
                with system.open_output_stream(f"{folder}/{name}", compression=None) as raw:
                    counted = _Counted(raw)
                    gzip.GzipFile("", "wb", self.level, counted, 0).close()
                rows, size, digest = 0, counted.bytes, counted.digest.hexdigest()
            manifest.append({"path": name, "rows": rows, "bytes": size, "sha256": digest})
        with system.open_output_stream(f"{folder}/manifest.json", compression=None) as out:
            out.write(json.dumps({"shards": manifest, "rows": sum(m["rows"] for m in manifest)}, indent=2, sort_keys=True).encode())
        self.abort(messages)

    def abort(self, messages) -> None:
        system, folder = filesystem(self._temporary())
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class GzipShards(DataSource):
    """Lines (shard, line), each shard whole and in order in one partition, as gzip files without name and time."""

    @classmethod
    def name(cls) -> str:
        return "gzip_shards"

    def schema(self) -> str:
        return "shard long, line string"

    def writer(self, schema, overwrite: bool) -> GzipShardWriter:
        return GzipShardWriter(dict(self.options))


def write_gzip_shards(df: DataFrame, order: list[str], shards: int, path: str, name: str, level: int = 9) -> None:
    """`shards` gzip files of df's column line, in the order of `order`, and manifest.json with their rows, bytes and SHA-256.

    Two runs over equal rows give equal bytes, whatever the partitions; `order` should tell all rows apart. Null lines are empty
    ones. Shards without rows are empty files. What is at the path must be a new folder.
    """
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(GzipShards)
    placed = with_shard(df, order, shards).select("shard", "row", F.coalesce("line", F.lit("")).alias("line"))
    dealt = placed.repartition(shards, "shard").sortWithinPartitions("shard", "row").select("shard", "line")
    dealt.write.format("gzip_shards").mode("append").option("path", path).option("name", name).option("shards", str(shards)).option("level", str(level)).option("job", uuid.uuid4().hex).save()


def read_package(spark: SparkSession, path: str) -> DataFrame:
    """shard, rows, first_line, last_line, content_sha256 (of the lines with their ends) of each shard file, one file a task."""
    files = spark.read.format("binaryFile").load(f"{path}/*.jsonl.gz").select("path", "content")

    def run(batches):
        import io

        import pandas as pd

        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows, first, last, digest = 0, None, None, hashlib.sha256()
                for line in gzip.open(io.BytesIO(content), "rb"):
                    digest.update(line)
                    text = line[:-1].decode("utf-8", "surrogatepass")
                    rows, first, last = rows + 1, text if first is None else first, text
                out.append((int(name.rsplit("-of-", 1)[0].rsplit("-", 1)[1]), rows, first, last, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["shard", "rows", "first_line", "last_line", "content_sha256"])

    return files.mapInPandas(run, "shard long, rows long, first_line string, last_line string, content_sha256 string").where("rows > 0")


def gzip_copy(source: str, target: str, level: int = 9) -> str:
    """A deterministic gzip copy of one file, chunk by chunk; returns its SHA-256."""
    (a, x), (b, y) = filesystem(source), filesystem(target)
    with a.open_input_stream(x, compression=None) as src, b.open_output_stream(y, compression=None) as raw:
        counted = _Counted(raw)
        with gzip.GzipFile("", "wb", level, counted, 0) as out:
            while chunk := src.read(CHUNK):
                out.write(chunk)
    return counted.digest.hexdigest()


def write_zip(folder: str, target: str) -> str:
    """All files of a folder as a ZIP archive with fixed order, times and rights, compressed ones as they are; returns its SHA-256.

    One archive is one stream, which the driver copies chunk by chunk.
    """
    (a, x), (b, y) = filesystem(folder), filesystem(target)
    files = sorted(i.path for i in a.get_file_info(fs.FileSelector(x, recursive=True)) if i.type == fs.FileType.File and not i.base_name.startswith("."))
    with b.open_output_stream(y, compression=None) as raw:
        counted = _Counted(raw)
        with zipfile.ZipFile(counted, "w", allowZip64=True) as archive:
            for path in files:
                info = zipfile.ZipInfo(f"{x.rstrip('/').rsplit('/', 1)[-1]}/{path[len(x.rstrip('/')) + 1 :]}", ZIP_TIME)
                info.create_system, info.external_attr = 3, 0o100644 << 16
                info.compress_type = zipfile.ZIP_STORED if path.endswith(".gz") else zipfile.ZIP_DEFLATED
                with a.open_input_stream(path, compression=None) as src, archive.open(info, "w") as out:
                    while chunk := src.read(CHUNK):
                        out.write(chunk)
    return counted.digest.hexdigest()


def verify_package(path: str) -> list[str]:
    """What is wrong with a package: files that are missing, unexpected or different, and rows that don't add up; empty for a sound one."""
    system, folder = filesystem(path)
    with system.open_input_stream(f"{folder}/manifest.json", compression=None) as f:
        manifest = json.loads(f.read())
    there = {i.base_name for i in system.get_file_info(fs.FileSelector(folder)) if not i.base_name.startswith(".")} - {"manifest.json"}
    wrong, total = [], 0
    for m in manifest["shards"]:
        if m["path"] not in there:
            wrong.append(f"missing {m['path']}")
            continue
        there.discard(m["path"])
        digest, rows = hashlib.sha256(), 0
        with system.open_input_stream(f"{folder}/{m['path']}", compression=None) as f:
            while chunk := f.read(CHUNK):
                digest.update(chunk)
        if digest.hexdigest() != m["sha256"]:
            wrong.append(f"different {m['path']}")
            continue
        with system.open_input_stream(f"{folder}/{m['path']}", compression=None) as f:
            rows = sum(1 for _ in gzip.GzipFile(fileobj=f))
        total += rows
        if rows != m["rows"]:
            wrong.append(f"rows of {m['path']}")
    if not wrong and row_targets(total, len(manifest["shards"])) != [m["rows"] for m in manifest["shards"]]:
        wrong.append("rows of shards")
    return wrong + [f"unexpected {p}" for p in sorted(there)]
