"""Byte ranges of files, and the gzip members that begin inside one.

Files are listed by Spark and cut into ranges of rows; a task opens its file by pyarrow's file systems, whatever its name ends
with. It scans its range for the gzip magic, takes a candidate whose header decodes to what a member should begin with, owns it, and
reads on behind the range's end until the member ends. Behind a member it goes on where that ended, so what a member holds is not scanned.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

from pyarrow import ArrowException, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
RANGE = 64 << 20
_BLOCK = 1 << 20


def _uri(path: str) -> str:
    """Spark writes file:/x, which is file:///x."""
    return re.sub(r"^file:/+", "file:///", path)


def opens(path: str) -> bool:
    """Whether pyarrow has a file system for the path's scheme."""
    try:
        fs.FileSystem.from_uri(_uri(path))
    except (ArrowException, OSError, ValueError):
        return False
    return True


def cut(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """file, start and stop of every range of every file under ``path``, a range a task. No content is read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    each = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("start"))
    each = each.select("file", "start", F.least(F.col("start") + size, "length").alias("stop"))
    # by number, so that rows of a few bytes are not put together into one task
    return each.repartition(max(1, min(each.count(), 100_000)), "file", "start")


class Opened:
    """A file that is read at any place, by blocks of which the last two are held."""

    def __init__(self, path: str) -> None:
        system, name = fs.FileSystem.from_uri(_uri(path))
        self.file = system.open_input_file(name)
        self.blocks: dict[int, bytes] = {}

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            while len(self.blocks) > 1:
                self.blocks.pop(next(iter(self.blocks)))
            self.file.seek(k * _BLOCK)
            self.blocks[k] = self.file.read(_BLOCK)
        return self.blocks[k]

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes from a place on, fewer at the file's end alone."""
        parts, left = [], n
        while left > 0:
            own = self._block(at // _BLOCK)[at % _BLOCK : at % _BLOCK + left]
            if not own:
                break
            parts.append(own)
            at, left = at + len(own), left - len(own)
        return b"".join(parts)

    def close(self) -> None:
        self.file.close()


class Member(io.RawIOBase):
    """What a gzip member holds, inflated as it is read, and the members behind it up to one that begins with ``begin``.

    A member that breaks raises zlib.error, one that ends early EOFError.
    """

    def __init__(self, opened: Opened, at: int, begin: bytes) -> None:
        self.opened, self.begin, self.fed = opened, begin, at
        self.broken: Exception | None = None
        self.inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        if self.broken is not None:
            raise self.broken
        try:
            return self._inflated(into)
        except (EOFError, zlib.error) as e:
            self.broken = e
            raise

    def _inflated(self, into) -> int:
        while not self.inflate.eof or self._goes_on():
            data = self.inflate.unconsumed_tail
            if not data:
                data = self.opened.read(self.fed, 65_536)
                self.fed += len(data)
                if not data:
                    raise EOFError("the member ends early")
            out = self.inflate.decompress(data, len(into))
            if out:
                into[: len(out)] = out
                return len(out)
        return 0

    def _goes_on(self) -> bool:
        if self.opened.read(self.end, len(MAGIC)) != MAGIC or _begins(self.opened, self.end, self.begin):
            return False
        self.fed = self.end
        self.inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)
        return True

    @property
    def end(self) -> int:
        """Where the next member may begin, once all of this one was read."""
        return self.fed - len(self.inflate.unused_data)


def _candidate(opened: Opened, at: int, stop: int) -> int | None:
    """The place of the next magic that begins before ``stop``."""
    while at < stop:
        block = opened.read(at, _BLOCK)
        k = block.find(MAGIC)
        if 0 <= k < stop - at:
            return at + k
        if len(block) < len(MAGIC):
            return None
        at += len(block) - len(MAGIC) + 1
    return None


def _begins(opened: Opened, at: int, begin: bytes) -> bool:
    """Whether a candidate's header decodes and what it holds begins so; an empty member does too."""
    head = opened.read(at, 4096)
    if len(head) < 18 or head[3] & 0xE0:
        return False
    try:
        inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)
        said = inflate.decompress(head, len(begin))
        return said == begin or (said == b"" and inflate.eof)
    except zlib.error:
        return False


def members(opened: Opened, start: int, stop: int, begin: bytes) -> Iterator[tuple[int, io.BufferedReader]]:
    """(place, content) of the members that begin in a range and whose content begins with ``begin``, or is empty.

    The content is to be read before the next is asked for. One that breaks raises while it is read; the scan then goes on behind its magic.
    """
    at = start
    while (at := _candidate(opened, at, stop)) is not None:
        if not _begins(opened, at, begin):
            at += 1
            continue
        member = Member(opened, at, begin)
        content = io.BufferedReader(member, 65_536)
        yield at, content
        try:
            while content.read(65_536):
                pass
            at = member.end
        except (EOFError, zlib.error):
            at += 1
