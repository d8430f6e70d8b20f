"""Files by URI, on the driver and in the workers: whatever scheme the Arrow file systems know (file, hdfs, s3, gs, abfs)."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyarrow import fs


def open_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it; an error for a scheme that it can't serve."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), str(PurePosixPath(uri)) if uri.startswith("/") else uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def exists(uri: str) -> bool:
    system, path = open_system(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def listed(uri: str, suffix: str) -> list[str]:
    """The files below a folder with that suffix, or the file itself, as paths of its system; hidden ones are left out."""
    system, path = open_system(uri)
    kind = system.get_file_info(path).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if kind == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith((".", "_")))


def write(uri: str, data: bytes) -> None:
    system, path = open_system(uri)
    system.create_dir(str(PurePosixPath(path).parent), recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def move(uri_from: str, uri_to: str) -> None:
    system, path = open_system(uri_from)
    system.move(path, open_system(uri_to)[1])


def delete(uri: str) -> None:
    system, path = open_system(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        system.delete_file(path)
