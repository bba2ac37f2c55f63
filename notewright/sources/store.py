"""Small files that are replaced as a whole, in a folder that driver and executors share.

Everything here goes through pyarrow's file systems, so a folder may be a path or a URI."""

from __future__ import annotations

import json
import posixpath
import uuid
from typing import Any

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as a path or a URI, and the folder's path there."""
    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def swap_json(folder: str, name: str, value: Any) -> None:
    """Puts value in place of what the name held: it is written beside and moved, so that a reader
    finds the old or the new one, whole."""
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    part = posixpath.join(root, f"_{name}.{uuid.uuid4().hex}.part")
    with store.open_output_stream(part) as out:
        out.write(json.dumps(value).encode())
    store.move(part, posixpath.join(root, name))


def read_json(folder: str, name: str, default: Any) -> Any:
    store, root = opened(folder)
    if store.get_file_info(posixpath.join(root, name)).type != fs.FileType.File:
        return default
    with store.open_input_stream(posixpath.join(root, name)) as file:
        return json.loads(file.read())


def folders(folder: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    store, root = opened(folder)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(posixpath.basename(f.path) for f in found if f.type == fs.FileType.Directory)


def drop_folder(folder: str) -> None:
    store, root = opened(folder)
    if store.get_file_info(root).type == fs.FileType.Directory:
        store.delete_dir(root)
