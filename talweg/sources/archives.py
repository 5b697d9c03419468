"""Archives of any size: members by byte range, and compressed TAR as one hashed stream.

ZIP and plain TAR are read in two passes.  ``member_index`` reads only directories and headers, by seeking,
one task an archive; ``member_contents`` deals the members by ranges of bytes, so one large archive is read
by many tasks and no archive is ever held.  A compressed TAR has no such index: ``TarStream`` reads its
parts in order, a chunk at a time, with running digests.

Archives are named by addresses that ``pyarrow.fs`` opens.  An archive that cannot be read gives one row
with a fault, never an exception, so that one bad file does not end the job.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from talweg.storage import stored

CHUNK = 1 << 20
BATCH_BYTES = 4 << 20
RANGE_BYTES = 64 << 20
MOST_BYTES = 1 << 30
INDEX = "archive string, kind string, number bigint, member string, at bigint, stored bigint, size bigint, method int, crc bigint, fault string"
_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    if address.startswith("file:/") and not address.startswith("file:///"):
        address = "file:///" + address[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(address)


def archives(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(archive, bytes) of the files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(F.col("path").alias("archive"), F.col("length").alias("bytes"))


# ---- index and contents ------------------------------------------------------------------------------


def _entries(address: str) -> Iterator[tuple]:
    """Rows of the index after ``archive``."""
    system, path = _opened(address)
    with system.open_input_file(path) as f:
        magic = f.read(2)
        f.seek(0)
        if magic == b"PK":
            with zipfile.ZipFile(f) as z:
                for i, m in enumerate(x for x in z.infolist() if not x.is_dir()):
                    fault = "encrypted" if m.flag_bits & 1 else None if m.compress_type in (0, 8) else "method"
                    yield "zip", i, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC, fault
        elif magic == b"\x1f\x8b":
            yield "tar.gz", None, None, None, None, None, None, None, "compressed: read it as a stream"
        else:
            with tarfile.open(fileobj=f, mode="r:") as t:
                i, m = 0, t.next()
                while m is not None:
                    if not m.isdir():
                        fault = None if m.isreg() and not m.issparse() else "not a file"
                        yield "tar", i, m.name, m.offset_data, m.size, m.size, 0, None, fault
                        i += 1
                    t.members = []
                    m = t.next()


def member_index(found: DataFrame) -> DataFrame:
    """One row a member of every archive (column ``archive``), with where its bytes lie; directories are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for address in b.column(0).to_pylist():
                rows: list[tuple] = []
                try:
                    for e in _entries(address):
                        rows.append((address, *e))
                        if len(rows) == 5_000:
                            yield _index_batch(rows)
                            rows = []
                except (OSError, tarfile.TarError, zipfile.BadZipFile, ValueError, EOFError) as x:
                    rows.append((address, None, None, None, None, None, None, None, None, f"unreadable: {type(x).__name__}"))
                if rows:
                    yield _index_batch(rows)

    return found.select("archive").repartition("archive").mapInArrow(run, INDEX)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    text, long = pa.string(), pa.int64()
    types = [text, text, long, text, long, long, long, pa.int32(), long, text]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)


def _bytes_of(f: pa.NativeFile, kind: str, at: int, stored_bytes: int, size: int, method: int, crc: int | None) -> tuple[bytes | None, str | None]:
    if kind == "zip":  # the local header's own lengths lead to the data
        head = f.read_at(30, at)
        if head[:4] != b"PK\x03\x04":
            return None, "no local header"
        at += 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    raw = f.read_at(stored_bytes, at)
    if method == 8:
        try:
            unpack = zlib.decompressobj(-15)
            raw = unpack.decompress(raw, size + 1)  # never more than was announced
        except zlib.error:
            return None, "damaged"
    if len(raw) != size:
        return None, "truncated"
    return (None, "checksum") if crc is not None and zlib.crc32(raw) != crc else (raw, None)


def member_contents(index: DataFrame, suffixes: Sequence[str] | None = None, most: int = MOST_BYTES, tasks: int | None = None) -> DataFrame:
    """(archive, member, size, content, fault) of the members whose names end in one of ``suffixes``.

    Size and checksum are verified; a member of more than ``most`` bytes is a fault, as a value must fit a
    row.  Members are dealt by ranges of 64 MB of their archive.
    """
    wanted = index.where("member IS NOT NULL")
    if suffixes:
        wanted = wanted.where(F.lower("member").rlike("(" + "|".join(s.lower().replace(".", r"\.") for s in suffixes) + ")$"))
    n = tasks or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = wanted.repartition(n, "archive", F.floor(F.col("at") / RANGE_BYTES)).sortWithinPartitions("archive", "at")
    dealt = dealt.select("archive", "kind", "member", "at", "stored", "size", "method", "crc", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            out: list[tuple] = []
            held = 0
            for address, kind, member, at, size_in, size, method, crc, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                content = None
                if fault is None and size > most:
                    fault = "too large"
                if fault is None:
                    try:
                        if address != name:
                            if f is not None:
                                f.close()
                            system, path = _opened(address)
                            name, f = address, system.open_input_file(path)
                        content, fault = _bytes_of(f, kind, at, size_in, size, method, crc)
                    except OSError as x:
                        name, fault = None, f"unreadable: {type(x).__name__}"
                out.append((address, member, size, content, fault))
                held += len(content or b"")
                if held > BATCH_BYTES:
                    yield _content_batch(out)
                    out, held = [], 0
            if out:
                yield _content_batch(out)
        if f is not None:
            f.close()

    return dealt.mapInArrow(run, "archive string, member string, size bigint, content binary, fault string")


def _content_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["archive", "member", "size", "content", "fault"])


# ---- membership --------------------------------------------------------------------------------------


def safe_member(name: Column) -> Column:
    """Relative, without backslashes, empty parts or steps upwards."""
    return ~(F.coalesce(name, F.lit("")) == "") & ~name.startswith("/") & ~name.contains("\\") & ~name.rlike(r"(^|/)\.\.(/|$)") & ~name.contains("//")


def membership_faults(index: DataFrame, allowed: str) -> DataFrame:
    """(archive, member, fault): archives that cannot be read, unsafe, repeated, empty and unexpected names.

    ``allowed`` is a pattern that whole names must match.
    """
    n = index.groupBy("archive", "member").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max("fault").alias("broken"))
    tests = [
        (F.col("broken").isNotNull(), F.col("broken")),
        (~safe_member(F.col("member")), F.lit("unsafe name")),
        (~F.col("member").rlike(f"^(?:{allowed})$"), F.lit("not allowed")),
        (F.col("n") > 1, F.lit("repeated")),
        (F.col("size") == 0, F.lit("empty")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), v) for c, v in tests]), lambda x: x.isNotNull())
    return n.select("archive", "member", F.explode(found).alias("fault"))


def paired_members(members: DataFrame, left: str = ".json", right: str = ".wav") -> DataFrame:
    """(archive, stem, complete): members by stem; complete with exactly one of either kind."""
    stem, kind = F.regexp_replace("member", r"\.[^./]+$", ""), F.concat(F.lit("."), F.lower(F.substring_index("member", ".", -1)))
    rows = members.select("archive", stem.alias("stem"), kind.alias("kind")).where(F.col("kind").isin(left, right))
    n = rows.groupBy("archive", "stem").agg(F.count_if(F.col("kind") == left).alias("l"), F.count_if(F.col("kind") == right).alias("r"))
    return n.select("archive", "stem", ((F.col("l") == 1) & (F.col("r") == 1)).alias("complete"))


def collection_faults(found: DataFrame, catalog: DataFrame, name: Column | None = None) -> DataFrame:
    """(name, fault): archives against a catalog of name and bytes: missing, unlisted, repeated, of another size."""
    name = F.substring_index("archive", "/", -1) if name is None else name
    have = found.select(name.alias("name"), F.col("bytes").alias("_bytes")).groupBy("name").agg(F.count("*").alias("_n"), F.max("_bytes").alias("_bytes"))
    listed = catalog.groupBy("name").agg(F.count("*").alias("_listed"), F.max("bytes").alias("bytes"))
    both = have.join(listed, "name", "full")
    fault = (
        F.when(F.col("_n").isNull(), "missing").when(F.col("_listed").isNull(), "unlisted").when(F.col("_n") > 1, "repeated").when(F.col("_listed") > 1, "listed twice").when(F.col("_bytes") != F.col("bytes"), "size differs")
    )
    return both.select("name", fault.alias("fault")).where("fault IS NOT NULL")


def submission_prompts(contents: DataFrame, original: str = "etc/PROMPTS") -> DataFrame:
    """(archive, submission, utterance, text, fault) of submissions ``<root>/<submission>/etc/PROMPTS`` and ``.../wav/<utterance>.wav``.

    A prompt line is a path, white space and a text.  Every utterance needs exactly one prompt and one
    recording: otherwise its fault says ``no recording``, ``no prompt``, ``repeated`` or ``malformed``.
    """
    parts = F.split("member", "/")
    at = contents.select("archive", F.get(parts, F.size(parts) - 3).alias("submission"), F.concat_ws("/", F.slice(parts, -2, 2)).alias("rest"), "content").where(F.size(parts) >= 3)
    line = F.explode(F.split(F.decode("content", "utf-8"), "\r\n|\n|\r"))
    lines = at.where(F.col("rest") == original).select("archive", "submission", line.alias("line")).where(F.trim("line") != "")
    shape = r"^\s*(\S+)\s+(\S.*?)\s*$"
    path = F.regexp_extract("line", shape, 1)
    said = lines.select("archive", "submission", F.substring_index(path, "/", -1).alias("utterance"), F.regexp_extract("line", shape, 2).alias("text"))
    prompts = said.groupBy("archive", "submission", "utterance").agg(F.count("*").alias("_p"), F.min("text").alias("text"))
    wavs = at.where(F.lower("rest").rlike(r"^wav/[^/]+\.wav$")).select("archive", "submission", F.regexp_extract("rest", r"^wav/(.*)\.[^.]+$", 1).alias("utterance"))
    wavs = wavs.groupBy("archive", "submission", "utterance").agg(F.count("*").alias("_w"))
    both = prompts.join(wavs, ["archive", "submission", "utterance"], "full")
    fault = F.when(F.col("utterance") == "", "malformed").when(F.col("_w").isNull(), "no recording").when(F.col("_p").isNull(), "no prompt").when((F.col("_p") > 1) | (F.col("_w") > 1), "repeated")
    return both.select("archive", "submission", "utterance", "text", fault.alias("fault"))


# ---- compressed TAR as a stream ----------------------------------------------------------------------


class multipart(io.RawIOBase):
    """Parts of one archive as one stream, a chunk at a time, with the digest of what has been read."""

    def __init__(self, parts: Iterable[bytes]):
        self.parts, self.now, self.hash, self.bytes = iter(parts), memoryview(b""), hashlib.sha256(), 0

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.now:
            part = next(self.parts, None)
            if part is None:
                return 0
            self.now = memoryview(part)
        n = min(len(buffer), len(self.now))
        buffer[:n], self.now = self.now[:n], self.now[n:]
        self.hash.update(buffer[:n])
        self.bytes += n
        return n

    @property
    def digest(self) -> str:
        return self.hash.hexdigest()


class _Archive(InputPartition):
    def __init__(self, parts: list[str]):
        self.parts = parts


class _TarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = options.get("parts")
        self.archives = json.loads(given) if given else [[options["path"]]]
        self.keep = tuple(s for s in options.get("content", "").split(",") if s)
        self.most = int(options.get("most", MOST_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [_Archive([p] if isinstance(p, str) else list(p)) for p in self.archives]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        parts, receipts = partition.parts, []
        archive = parts[0]

        def chunks() -> Iterator[bytes]:
            for p in parts:
                system, path = _opened(p)
                own, n = hashlib.sha256(), 0
                with system.open_input_stream(path) as f:
                    while block := f.read(CHUNK):
                        own.update(block)
                        n += len(block)
                        yield block
                receipts.append((p, n, own.hexdigest()))

        stream, number = multipart(chunks()), 0
        try:
            plain = gzip.GzipFile(fileobj=io.BufferedReader(stream, CHUNK))
            with tarfile.open(fileobj=plain, mode="r|") as t:
                for m in t:
                    t.members = []
                    if m.isdir():
                        continue
                    if not m.isreg():
                        yield archive, "member", number, m.name, m.size, None, None, stream.bytes, "not a file"
                        number += 1
                        continue
                    own, held, f = hashlib.sha256(), [], t.extractfile(m)
                    keep = bool(self.keep) and m.name.endswith(self.keep) and m.size <= self.most
                    while block := f.read(CHUNK):
                        own.update(block)
                        if keep:
                            held.append(block)
                    yield archive, "member", number, m.name, m.size, own.hexdigest(), b"".join(held) if keep else None, stream.bytes, None
                    number += 1
            while plain.read(CHUNK):  # to the end, where the checksum of the whole stands
                pass
            while stream.read(CHUNK):
                pass
        except (OSError, EOFError, tarfile.TarError, zlib.error) as x:
            yield archive, "archive", number, None, stream.bytes, None, None, stream.bytes, f"unreadable: {type(x).__name__}"
            return
        for p, n, digest in receipts:
            yield archive, "part", None, p, n, digest, None, stream.bytes, None
        yield archive, "archive", number, None, stream.bytes, stream.digest, None, stream.bytes, None


class TarStream(DataSource):
    """``spark.read.format("tar_stream")``: members of compressed TARs, one task an archive, in order.

    Options: ``path``, or ``parts`` (JSON list of archives, each an address or a list of the addresses of its
    parts); ``content`` (comma-separated suffixes of members whose bytes are wanted).  Rows are members
    (number, name, size, digest), then one row a part and one for the archive with its digest; ``read_bytes``
    is how far into the archive the stream was.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_stream"

    def schema(self) -> str:
        return "archive string, kind string, number bigint, name string, size bigint, sha256 string, content binary, read_bytes bigint, fault string"

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(self.options)


def read_tar_stream(spark: SparkSession, parts: Sequence[str | Sequence[str]], content: Sequence[str] = ()) -> DataFrame:
    spark.dataSource.register(TarStream)
    return spark.read.format("tar_stream").option("parts", json.dumps([p if isinstance(p, str) else list(p) for p in parts])).option("content", ",".join(content)).load()


# ---- writing -----------------------------------------------------------------------------------------


class _Parts(io.RawIOBase):
    """A stream written to numbered files of at most ``most`` bytes each."""

    def __init__(self, folder: str, name: str, most: int | None):
        self.folder, self.name_of, self.most, self.addresses, self.out, self.n = folder, name, most, [], None, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        view, done = memoryview(data).cast("B"), 0
        while done < len(view):
            if self.out is None:
                system, path = _opened(self.folder)
                system.create_dir(path, recursive=True)
                own = f"{self.name_of}.{len(self.addresses):03d}" if self.most else self.name_of
                self.out, self.n = system.open_output_stream(f"{path}/{own}"), 0
                self.addresses.append(f"{self.folder}/{own}")
            step = len(view) - done if self.most is None else min(len(view) - done, self.most - self.n)
            self.out.write(view[done : done + step])
            done, self.n = done + step, self.n + step
            if self.n == self.most:
                self.close_part()
        return done

    def close_part(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_tars(members: DataFrame, folder: str, compressed: bool = False, part_bytes: int | None = None) -> DataFrame:
    """(parts, n_members): TARs of ``members`` (member, content), one for each partition of the frame, streamed.

    Every attempt of a task writes under a name of its own; only the files of the returned, stored rows count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, plain, n = _Parts(folder, f"{uuid.uuid4().hex}.tar{'.gz' if compressed else ''}", part_bytes), None, 0
        for b in batches:
            for member, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if plain is None:
                    plain = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) if compressed else out
                data = content.as_buffer() if content.is_valid else pa.py_buffer(b"")
                head = tarfile.TarInfo(member)
                head.size = data.size
                plain.write(head.tobuf(tarfile.GNU_FORMAT))
                plain.write(data)
                plain.write(b"\0" * (-data.size % 512))
                n += 1
        if plain is not None:
            plain.write(b"\0" * 1024)
            if compressed:
                plain.close()
            out.close_part()
            yield pa.RecordBatch.from_arrays([pa.array([out.addresses], pa.list_(pa.string())), pa.array([n], pa.int64())], names=["parts", "n_members"])

    return stored(members.select(F.col("member"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "parts array<string>, n_members bigint"), "tars")
