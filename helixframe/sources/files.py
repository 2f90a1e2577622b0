"""Files that Python reads for itself: opened by URI, plain or compressed, in byte ranges where that is possible."""

from __future__ import annotations

import gzip
import io

from pyspark.sql import SparkSession

RANGE = 32 << 20


def opened(uri: str) -> io.BufferedIOBase:
    """A seekable binary file of any store that pyarrow knows; ``file:`` and bare paths are local. A missing file raises an error."""
    if uri.startswith("file:") or "://" not in uri:
        path = uri.removeprefix("file:")
        return open("/" + path.lstrip("/") if path.startswith("//") else path, "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def uncompressed(uri: str) -> io.BufferedIOBase:
    file = opened(uri)
    return gzip.GzipFile(fileobj=file) if uri.endswith((".gz", ".bgz")) else file


def listed(path: str) -> list[tuple[str, int]]:
    """The files at a path (a file, folder or pattern) and their lengths, through Hadoop where a session runs."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        import glob
        import os

        found = sorted(p for f in glob.glob(path.removeprefix("file://").removeprefix("file:")) for p in ([os.path.join(f, x) for x in os.listdir(f)] if os.path.isdir(f) else [f]))
        return [(p, os.path.getsize(p)) for p in found if not os.path.basename(p).startswith(("_", "."))]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(hadoop) or []
    out = []
    for status in found:
        inner = [status] if status.isFile() else list(system.listStatus(status.getPath()))
        out += [(s.getPath().toString(), s.getLen()) for s in inner if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def ranges(path: str, size: int = RANGE) -> list[tuple[str, int, int]]:
    """Byte ranges of plain files; a compressed file is one range."""
    return [(uri, a, min(a + size, n)) for uri, n in listed(path) for a in (range(0, max(n, 1), size) if not uri.endswith((".gz", ".bgz")) else (0,))] if size else [(uri, 0, n) for uri, n in listed(path)]
