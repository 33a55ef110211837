"""Raw files in the shared folder, written and read by tasks through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a folder in the shared store; it is created."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path


def own_name(stem: str, ending: str) -> str:
    """A name that no other attempt of the same task uses; only named files are ever read."""
    return f"{stem}-{uuid.uuid4().hex[:12]}{ending}"
