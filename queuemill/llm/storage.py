"""Files that tasks write themselves, on any store that pyarrow knows by its address."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri[len("file:") :])


def write_file(folder: str, name: str, content: bytes) -> None:
    """Write a whole file under its final name or not at all, so that a task may run twice."""
    fs, root = place(folder)
    fs.create_dir(root, recursive=True)
    draft = f"{root}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(content)
    fs.move(draft, f"{root}/{name}")
