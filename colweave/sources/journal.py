"""Answers kept while a task makes its calls, so that a task that is run again does not repeat them.

A task answers its rows in the order of their keys and writes what it has every few seconds, as a file
of its own in a folder of its partition. The files are therefore the beginning of what the task does: a
later attempt, on whatever executor, reads them in step with its rows and goes on after them. Only one
file is held at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs

from .staging import file_system

_SCHEMA = pa.schema([("key", pa.int64()), ("response", pa.string()), ("error", pa.string())])
_SUFFIX = ".arrow"

Answer = tuple  # (response, error)


@dataclass(frozen=True)
class Journal:
    """A folder that all executors reach. ``seconds`` bounds what a lost task has to ask again."""

    folder: str
    key: str
    seconds: float = 5.0

    def of_task(self, partition: int) -> TaskJournal:
        return TaskJournal(f"{self.folder}/part-{partition:06d}", self.seconds)


@dataclass
class TaskJournal:
    folder: str
    seconds: float
    _waiting: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        self._system, self._path = file_system(self.folder)
        self._system.create_dir(self._path, recursive=True)
        self._kept = self._read()
        self._next = next(self._kept, None)
        self._written = time.monotonic()

    def recall(self, key: int) -> Answer | None:
        """The answer kept under ``key``; keys must be asked for in ascending order."""
        while self._next is not None and self._next[0] < key:
            self._next = next(self._kept, None)
        return self._next[1:] if self._next is not None and self._next[0] == key else None

    def add(self, key: int, answer: Answer) -> None:
        self._waiting.append((key, *answer))

    def keep(self, places: list[int], keys: list, responses: list, errors: list) -> None:
        """Add the answers at some places of three lists."""
        self._waiting.extend((keys[n], responses[n], errors[n]) for n in places)

    @property
    def holds_more(self) -> bool:
        """Whether answers of an earlier attempt are left to recall."""
        return self._next is not None

    def is_due(self) -> bool:
        return time.monotonic() - self._written >= self.seconds

    def flush(self, now: bool = False) -> None:
        """Write what waits, if it is time; under its last name only when it is whole."""
        if not self._waiting or not (now or self.is_due()):
            return
        name = f"{self._waiting[0][0]:020d}-{uuid.uuid4().hex}{_SUFFIX}"
        rows = pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*self._waiting), _SCHEMA)], schema=_SCHEMA)
        with self._system.open_output_stream(f"{self._path}/{name}.tmp") as out, pa.ipc.new_file(out, _SCHEMA) as file:
            file.write_table(rows)
        self._system.move(f"{self._path}/{name}.tmp", f"{self._path}/{name}")
        self._waiting = []
        self._written = time.monotonic()

    def _read(self) -> Iterator[tuple]:
        files = self._system.get_file_info(fs.FileSelector(self._path))
        last = None
        # by the first key; two attempts at a time may both have answered a key
        for path in sorted(info.path for info in files if info.path.endswith(_SUFFIX)):
            with self._system.open_input_file(path) as source:
                rows = pa.ipc.open_file(source).read_all()
            for row in zip(*(column.to_pylist() for column in rows.columns)):
                if last is None or row[0] > last:
                    last = row[0]
                    yield row
