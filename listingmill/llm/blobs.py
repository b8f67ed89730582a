"""Binary files in the shared folder, written and read by tasks.

A file is written under a name of its own and renamed when whole, so a repeated task replaces it by the same
bytes and a reader never sees half of one.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def make_folder(uri: str) -> None:
    files, path = _at(uri)
    files.create_dir(path, recursive=True)


def write(uri: str, parts: list[bytes]) -> None:
    files, path = _at(uri)
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    files.move(own, path)


def read(uri: str, start: int = 0, length: int | None = None) -> bytes:
    files, path = _at(uri)
    with files.open_input_file(path) as source:
        source.seek(start)
        return source.read(length) if length is not None else source.read()
