"""Plain files in the shared folder, written by tasks that may run twice or be lost."""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs) and the path within it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@contextlib.contextmanager
def whole(path: str):
    """A stream to a new file that appears under its name only once it is complete.

    The attempt writes under a name of its own and renames at the end, so attempts of one task never mix and a
    file of equal content may be replaced at any time.
    """
    system, at = open_fs(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    own = f"{at}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(own) as out:
            yield out
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(own)
        raise
    system.move(own, at)


def content(path: str, start: int = 0, length: int | None = None) -> bytes:
    system, at = open_fs(path)
    with system.open_input_file(at) as f:
        left = max(0, f.size() - start)
        f.seek(min(start, f.size()))
        return f.read(left if length is None else min(length, left))
