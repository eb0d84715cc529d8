"""Files in the shared folder, written and read by tasks through any filesystem Arrow knows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import NativeFile, fs
from pyspark import TaskContext


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path; Hadoop writes local ones as ``file:/``."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


@contextmanager
def whole_file(folder: str, name: str) -> Iterator[NativeFile]:
    """A file that gets its name only when it is whole. A repeated task writes the same bytes under
    the same name, so a lost or doubled attempt leaves no other trace than an unused draft."""
    files, base = opened(folder)
    draft = f"{base}/_{name}.{TaskContext.get().taskAttemptId()}"
    with files.open_output_stream(draft) as out:
        yield out
    files.move(draft, f"{base}/{name}")


def made_folder(uri: str) -> str:
    """The folder, there even if nothing will be written to it."""
    files, base = opened(uri)
    files.create_dir(base)
    return uri
