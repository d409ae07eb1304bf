"""What a path may be on disk: inside of the root, through no symbolic link, of the expected type.

These run on the driver, on the few paths that a file operation names, or in a task for the one file
that it opens. The lexical half is functions.paths.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from notelattice.errors import InvalidPath


def safe_path(path: str) -> str:
    """A vault-relative path in canonical form, or InvalidPath."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if not parts or path.startswith(("/", "\\")) or "\0" in path or len(path.encode()) > 1024 or (path[:1].isalpha() and path[1:2] == ":"):
        raise InvalidPath(f"bad path {path!r}")
    if any(p == ".." or p.startswith(".") for p in parts):
        raise InvalidPath(f"bad path {path!r}")
    return "/".join(parts)


def check_contained(root: str, path: str) -> os.stat_result | None:
    """The lstat of root/path, None where nothing is there. A link at any level, or a file where a
    folder must be, is an InvalidPath."""
    at, last = root, None
    parts = safe_path(path).split("/")
    for i, part in enumerate(parts):
        at = os.path.join(at, part)
        try:
            last = os.lstat(at)
        except FileNotFoundError:
            return None
        if stat.S_ISLNK(last.st_mode):
            raise InvalidPath(f"{path} goes through a symbolic link")
        if i + 1 < len(parts) and not stat.S_ISDIR(last.st_mode):
            raise InvalidPath(f"{path} goes through what is no folder")
    return last


def safe_join(root: str, path: str) -> Path:
    """root/path after check_contained(); never the root itself."""
    check_contained(root, path)
    return Path(root) / safe_path(path)


def check_source(info: os.stat_result, path: str) -> str:
    """'file' or 'folder'; other types are not moved or copied."""
    if stat.S_ISREG(info.st_mode):
        return "file"
    if stat.S_ISDIR(info.st_mode):
        return "folder"
    raise InvalidPath(f"{path} is neither file nor folder")


@contextmanager
def parents(root: str, path: str) -> Iterator[Path]:
    """root/path with its parent folders made; those made here go again if the body fails. A parent
    that someone removes meanwhile is made once more."""
    made: list[Path] = []
    at = safe_join(root, path)
    for attempt in (0, 1):
        try:
            missing = [p for p in at.relative_to(root).parents if p != Path(".") and not (Path(root) / p).exists()]
            for p in reversed(missing):
                (Path(root) / p).mkdir()
                made.append(Path(root) / p)
            break
        except (FileNotFoundError, FileExistsError):
            if attempt:
                raise
    try:
        check_contained(root, path)
        yield at
    except BaseException:
        for p in reversed(made):
            try:
                p.rmdir()
            except OSError:  # in use by now
                break
        raise


class Gone(Exception):
    """A path holds no regular file (any more)."""


def read_regular(root: str, path: str, limit: int | None = None) -> tuple[os.stat_result, bytes | None]:
    """(stat, content) of a regular file, opened without following a link and checked to be the one
    that was looked at; content is None above `limit`. A file that is written meanwhile is read again.
    Only what isn't there raises Gone; other failures go to the caller."""
    at = os.path.join(root, path)
    for _ in range(3):
        try:
            seen = os.lstat(at)
            if not stat.S_ISREG(seen.st_mode):
                raise Gone(path)
            fd = os.open(at, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
        except (FileNotFoundError, NotADirectoryError) as e:
            raise Gone(path) from e
        with os.fdopen(fd, "rb") as f:
            info = os.fstat(fd)
            if (info.st_dev, info.st_ino) != (seen.st_dev, seen.st_ino):
                continue  # replaced between the look and the opening
            if limit is not None and info.st_size > limit:
                return info, None
            data = f.read()
            after = os.fstat(fd)
        if (after.st_size, after.st_mtime_ns) == (info.st_size, info.st_mtime_ns):
            break
    else:
        after, data = info, data  # a file under steady change: what was read last
    return after, data
