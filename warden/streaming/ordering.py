"""Rows of one key and micro-batch in order, however many there are (ST1, ST2, ST4, ST5, ST7)."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from heapq import merge
from itertools import islice
from typing import Any, IO

#: Rows that a run on disk gives back at a time, and runs that become one longer run.
READ = 1_000
WAYS = 32


def _written(rows: Iterable) -> IO[bytes]:
    """Rows in a nameless file on a disk that Spark uses for shuffles; it goes with the worker at the latest."""
    disk = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    file, rows = tempfile.TemporaryFile(dir=disk if os.path.isdir(disk) else None), iter(rows)
    while part := list(islice(rows, READ)):
        pickle.dump(part, file, pickle.HIGHEST_PROTOCOL)
    file.seek(0)
    return file


def _read(file: IO[bytes]) -> Iterator:
    with file:
        while True:
            try:
                part = pickle.load(file)
            except EOFError:
                return
            yield from part


def in_order(runs: Iterable[list], key: Callable[[Any], Any], room: int) -> Iterator:
    """The rows of runs that are in order by ``key``, in one order; equal rows stay as they came.

    A run shorter than ``room`` is the last one. A single one never leaves memory. Others wait on disk, so what is held is
    the run at hand, then ``READ`` rows of each run that is merged; every ``WAYS`` runs become one, so these stay few.
    """
    levels: list[list[IO[bytes]]] = [[]]
    last: list = []
    for run in runs:
        if len(run) < room:
            last = run
            break
        levels[0].append(_written(run))
        run.clear()
        for n, level in enumerate(levels):
            if len(level) < WAYS:
                break
            if n + 1 == len(levels):
                levels.append([])
            levels[n + 1].append(_written(merge(*map(_read, level), key=key)))
            level.clear()
    # Higher levels hold what came before; merge keeps that order among equal rows.
    yield from merge(*[_read(file) for level in reversed(levels) for file in level], last, key=key) if any(levels) else last
