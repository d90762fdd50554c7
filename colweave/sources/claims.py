"""Ranges of ids that one writer has to itself, by files that only one writer can create.

The n-th claim is the file ``n`` in a folder of the log and holds the first and the last id of a range
that begins after that of the claim before, and who made it. Of writers that saw the same last claim only one
creates the next file; the others look again. A claim is done when its rows are written, and
broken when its writer gave up, who may have written some of them: how far the log goes is then looked
up in the log once. A writer that is lost leaves a gap, as an identity column does.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from .staging import drop_folder, hadoop_path

LIVE, DONE, BROKEN = "", ".done", ".broken"


@dataclass(frozen=True)
class Claim:
    number: int
    first: int
    last: int
    owner: str
    state: str = LIVE


@dataclass(frozen=True)
class Claims:
    spark: SparkSession
    folder: str

    def known(self) -> list[Claim]:
        """The claims that stand, by number. Those before the last finished one are taken away."""
        files, folder = hadoop_path(self.spark, self.folder)
        if not files.exists(folder):
            return []
        names = {status.getPath().getName() for status in files.listStatus(folder)}
        found = []
        for name in sorted(names):
            if name.isdigit():
                state = next((s for s in (DONE, BROKEN) if name + s in names), LIVE)
                text = self._read(name)
                if text:  # taken away since
                    first, last, owner = text.split(" ", 2)
                    found.append(Claim(int(name), int(first), int(last), owner, state))
        return found

    def claim(self, n: int, owner: str, mark: Callable[[], int]) -> Claim:
        """The next ``n`` ids. ``mark`` looks up the greatest id of the log, where claims do not tell."""
        while True:
            known = self.known()
            if known and known[-1].state != BROKEN:
                after = known[-1].last
            else:
                after = max([mark(), *(c.last for c in known if c.state != BROKEN)])
            made = self.take(known, after + 1, after + n, owner)
            if made is not None:
                return made

    def take(self, known: list[Claim], first: int, last: int, owner: str) -> Claim | None:
        """A claim of these ids if nobody claimed any since ``known``."""
        number = known[-1].number + 1 if known else 0
        made = self._create(f"{number:012d}", f"{first} {last} {owner}")
        return Claim(number, first, last, owner) if made else None

    def end(self, claim: Claim, state: str) -> None:
        """Mark a claim as done or broken; what ended before it is not needed any more."""
        self._create(f"{claim.number:012d}{state}", state)
        if state == DONE:
            for old in self.known():
                if old.number < claim.number and (old.state != LIVE or old.owner == claim.owner):
                    for suffix in (LIVE, DONE, BROKEN):
                        files, path = hadoop_path(self.spark, f"{self.folder}/{old.number:012d}{suffix}")
                        files.delete(path, False)

    def forget(self) -> None:
        """Take all claims away unless some writer is at it."""
        known = self.known()
        if known and all(claim.state != LIVE for claim in known):
            drop_folder(self.spark, self.folder)

    def _read(self, name: str) -> str | None:
        files, path = hadoop_path(self.spark, f"{self.folder}/{name}")
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Create a file with its text unless it is there; no reader sees it without."""
        files, whole = hadoop_path(self.spark, f"{self.folder}/_{uuid.uuid4().hex}")
        _, target = hadoop_path(self.spark, f"{self.folder}/{name}")
        stream = files.create(whole, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if files.getUri().getScheme() == "file":  # where a rename may put a file over another
                os.link(whole.toUri().getPath(), target.toUri().getPath())
            else:
                hadoop = self.spark._jvm.org.apache.hadoop.fs
                none = self.spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
                hadoop.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(
                    whole, target, none
                )
        except FileExistsError:
            return False
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            return False
        finally:
            files.delete(whole, False)
        return True
