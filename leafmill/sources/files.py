"""Files for the data sources: byte ranges, writing and listing, on local disks, object stores and HDFS, and ranges behind HTTP.

A path without a scheme, or with ``file:``, is local; ``http`` and ``https`` are
read by ranges; any other scheme goes through ``pyarrow.fs``, which tasks can
use without the JVM (``hdfs``, ``s3`` or ``s3a``, ``gs``, ``abfs``).
"""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from contextlib import AbstractContextManager
from urllib.parse import unquote, urlsplit

TAIL = 1 << 16


def is_url(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def is_local(path: str) -> bool:
    return path.startswith("file:") or "://" not in path


def local(path: str) -> str:
    return unquote(urlsplit(path).path) if path.startswith("file:") else path


def filesystem(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    if is_local(path):
        return fs.LocalFileSystem(), os.path.abspath(local(path))
    return fs.FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a:") else path)


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def folder_of(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0]


def exists(path: str) -> bool:
    if is_local(path):
        return os.path.exists(local(path))
    from pyarrow import fs

    system, at = filesystem(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def is_folder(path: str) -> bool:
    if is_local(path):
        return os.path.isdir(local(path))
    from pyarrow import fs

    system, at = filesystem(path)
    return system.get_file_info(at).type == fs.FileType.Directory


def open_input(path: str):
    return open(local(path), "rb") if is_local(path) else (lambda s, at: s.open_input_file(at))(*filesystem(path))  # noqa: SIM115


def open_output(path: str):
    """A new file; its folder is made where it isn't there."""
    if is_local(path):
        os.makedirs(os.path.dirname(os.path.abspath(local(path))), exist_ok=True)
        return open(local(path), "wb")
    system, at = filesystem(path)
    system.create_dir(folder_of(at), recursive=True)
    return system.open_output_stream(at)


def read_all(path: str) -> bytes:
    if is_url(path):
        with urllib.request.urlopen(path, timeout=30) as r:
            return r.read()
    with open_input(path) as f:
        return f.read()


def replace(path: str, data: bytes) -> None:
    """Writes a file aside and moves it into its place."""
    with open_output(path + ".new") as f:
        f.write(data)
    move(path + ".new", path)


def move(source: str, target: str) -> None:
    if is_local(source):
        os.replace(local(source), local(target))
        return
    system, at = filesystem(source)
    system.move(at, filesystem(target)[1])


def remove(path: str) -> None:
    system, at = filesystem(path)
    system.delete_file(at)


def drop_folder(path: str) -> None:
    system, at = filesystem(path)
    system.delete_dir(at)


def names(folder: str) -> list[str]:
    """Names of the files right in a folder; none where there is no folder."""
    from pyarrow import fs

    system, at = filesystem(folder)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == fs.FileType.File)


class Ranges(AbstractContextManager):
    """Reads ranges; over HTTP with ``attempts`` tries and pauses that double."""

    def __init__(self, path: str, timeout: float = 30, attempts: int = 4, pause: float = 1.0):
        self.path, self.timeout, self.attempts, self.pause = path, timeout, attempts, pause
        self._tail: tuple[int, bytes] | None = None
        self.file = None if is_url(path) else open_input(path)

    def _fetch(self, spec: str) -> tuple[bytes, str]:
        request = urllib.request.Request(self.path, headers={"Range": f"bytes={spec}"})
        for k in range(self.attempts):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    if r.status != 206:
                        raise OSError(f"{self.path}: the server ignores ranges (status {r.status})")
                    return r.read(), r.headers.get("Content-Range", "")
            except OSError:
                if k + 1 == self.attempts:
                    raise
                time.sleep(self.pause * 2**k)
        raise AssertionError

    def size(self) -> int:
        if self.file:
            return self.file.seek(0, 2)
        if self._tail is None:
            data, said = self._fetch(f"-{TAIL}")
            self._tail = int(said.rpartition("/")[2]), data
        return self._tail[0]

    def read(self, start: int, length: int) -> bytes:
        if length <= 0:
            return b""
        if self.file:
            self.file.seek(start)
            data = self.file.read(length)
        else:
            if self._tail and start >= self._tail[0] - len(self._tail[1]):
                at = start - (self._tail[0] - len(self._tail[1]))
                data = self._tail[1][at : at + length]
            else:
                data, _ = self._fetch(f"{start}-{start + length - 1}")
        if len(data) != length:
            raise OSError(f"{self.path}: {length} bytes at {start} asked for, {len(data)} there")
        return data

    def close(self) -> None:
        if self.file:
            self.file.close()

    def __exit__(self, *error) -> None:
        self.close()


def listed(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """Files below a folder in path order, or the file or address itself."""
    if is_url(path) or not is_folder(path):
        return [path]
    found = []
    if not is_local(path):
        from pyarrow import fs

        system, at = filesystem(path)
        scheme = path[: path.index("://") + 3]
        host = urlsplit(path).netloc + "/" if at.startswith("/") and urlsplit(path).netloc else ""
        for f in system.get_file_info(fs.FileSelector(at, recursive=True)):
            inner = f.path[len(at) :].strip("/").split("/")
            if f.type == fs.FileType.File and f.base_name.endswith(suffixes) and not any(part[0] in "._" for part in inner):
                found.append(scheme + host.rstrip("/") + f.path)
        return sorted(found)
    for folder, dirs, inside in os.walk(local(path)):
        dirs[:] = sorted(d for d in dirs if d[0] not in "._")
        found += [os.path.join(folder, n) for n in inside if n.endswith(suffixes) and n[0] not in "._"]
    return sorted(found)
