"""EPUB archives: what is wrong with their members, their contents as rows, and packing."""

from __future__ import annotations

import io
import posixpath
import stat
import unicodedata
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    members: int = 10_000
    member_bytes: int = 128 << 20
    total_bytes: int = 1 << 30
    ratio: float = 200.0


class UnsafeArchive(ValueError):
    pass


def _folded(name: str) -> str:
    return unicodedata.normalize("NFC", name).casefold()


def safe_name(name: str) -> str:
    """The path of a member, or an error if it leads out of the archive."""
    clean = name.replace("\\", "/")
    if not clean or "\0" in clean or clean.startswith("/") or clean[1:2] == ":" or ".." in clean.split("/") or posixpath.normpath(clean) in (".", ".."):
        raise UnsafeArchive(f"archive path rejected: {name!r}")
    return clean


def checked_members(archive: zipfile.ZipFile, limits: Limits) -> list[tuple[zipfile.ZipInfo, str, bool]]:
    """(info, name, is_directory) of all members; an error names the first thing that is wrong."""
    infos = archive.infolist()
    if len(infos) > limits.members:
        raise UnsafeArchive(f"archive member count {len(infos)} exceeds {limits.members}")
    out, total = [], 0
    seen: set[str] = set()
    for info in infos:
        name = safe_name(info.filename)
        kind = stat.S_IFMT(info.external_attr >> 16)
        is_directory = info.is_dir() or kind == stat.S_IFDIR
        total += info.file_size
        wrong = (
            "duplicate" if _folded(name.rstrip("/")) in seen else "encrypted" if info.flag_bits & 1 else "link or special" if not is_directory and kind not in (0, stat.S_IFREG)
            else "too large" if info.file_size > limits.member_bytes else "past the total size" if total > limits.total_bytes
            else "too compressed" if info.file_size > limits.ratio * max(info.compress_size, 1) else ""
        )
        if wrong:
            raise UnsafeArchive(f"{wrong} archive member rejected: {name!r}")
        seen.add(_folded(name.rstrip("/")))
        out.append((info, name, is_directory))
    files = {_folded(name) for _, name, is_directory in out if not is_directory}
    for _, name, _ in out:
        parent = posixpath.dirname(name.rstrip("/"))
        while parent:
            if _folded(parent) in files:
                raise UnsafeArchive(f"archive member below a file rejected: {name!r}")
            parent = posixpath.dirname(parent)
    return out


def read(data: bytes, limits: Limits) -> list[tuple[str, bytes]]:
    """Files of an archive; a member that isn't as long as it says is an error."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            out = []
            for info, name, is_directory in checked_members(z, limits):
                if is_directory:
                    continue
                with z.open(info) as f:
                    body = f.read(info.file_size + 1)
                if len(body) != info.file_size:
                    raise UnsafeArchive(f"archive member size is wrong: {name!r}")
                out.append((name, body))
            return out
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
        raise UnsafeArchive(str(e)) from e


def packed(members: list[tuple[str, bytes]]) -> bytes:
    """An EPUB: the mimetype first and stored, the rest in order of name."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ordered = sorted(members, key=lambda m: (m[0] != "mimetype", m[0]))
        for name, body in ordered:
            info = zipfile.ZipInfo(safe_name(name))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, body)
    return out.getvalue()


def members(spark: SparkSession, path: str, limits: Limits | None = None) -> DataFrame:
    """(path, member, content, error) of the archives under a path; an archive that is rejected has one row, with the error."""
    bounds = limits or Limits()
    schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows = [(where, name, body, None) for name, body in read(data, bounds)]
                except UnsafeArchive as e:
                    rows = [(where, None, None, str(e))]
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, content binary, error string")


def with_language(opf: Column, language: str = "zh") -> Column:
    """A package document whose dc:language names that language."""
    return F.regexp_replace(opf, r"(?is)(<dc:language\b[^>]*>)[^<]*(</dc:language>)", f"$1{language}$2")
