"""The append-only conversion log."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.checks import refuse_violations
from ..operators.ids import MARK, ids_of, lay_out
from ..schemas import CONVERSION_LOG, CONVERSION_ROW, conform
from .claims import BROKEN, DONE, Claim, Claims
from .mapping import is_path
from .staging import is_staged, move_files, stage, staged_names, unstage

#: Which id an attempt gave to the row of a mark; the texts stay in the staged rows.
ATTEMPT = T.StructType([T.StructField(MARK, T.LongType()), T.StructField("id", T.LongType())])


@dataclass(frozen=True)
class ConversionLog:
    """A log at a path or under a table name. Writers and readers at any time.

    Every append claims its ids before it writes (``claims``), so ids are unique whoever writes
    beside it, and an append does not read the log to number its rows. Rows that were written
    by something else than a ``ConversionLog`` must be there before its first append.
    """

    spark: SparkSession
    location: str
    format: str = "parquet"

    def read(self) -> DataFrame:
        """All rows; none, under the declared schema, before the first append."""
        try:
            if is_path(self.location):
                reader = self.spark.read.format(self.format)
                if self.format != "delta":
                    reader = reader.schema(CONVERSION_LOG)
                rows = reader.load(self.location)
            else:
                rows = self.spark.read.table(self.location)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
                raise
            return self.spark.createDataFrame([], CONVERSION_LOG)
        return conform(rows, CONVERSION_LOG, self.location)

    def high_water_mark(self) -> DataFrame:
        """One row with the greatest id, 0 for an empty log."""
        return self.read().agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_id"))

    def max_id(self) -> int:
        """The greatest id: the last one claimed, where all claims are written, without reading the log."""
        known = self.claims.known()
        if known and all(claim.state == DONE for claim in known):
            return known[-1].last
        return self.high_water_mark().first()["max_id"]

    @property
    def claims(self) -> Claims:
        if is_path(self.location):  # they go with the log; names with an underscore are no data
            return Claims(self.spark, f"{self.location.rstrip('/')}/_claims")
        name = hashlib.md5(self.location.encode()).hexdigest()
        claims = Claims(self.spark, f"{self.spark.conf.get('spark.sql.warehouse.dir')}/_claims/{name}")
        if not self.spark.catalog.tableExists(self.location):
            claims.forget()  # those of a table that was dropped
        return claims

    def _mark(self) -> int:
        return self.high_water_mark().first()["max_id"]

    def _put(self, claim: Claim, rows: DataFrame) -> DataFrame:
        """Write the rows of a claim; one whose write fails is broken."""
        try:
            self._write(rows)
        except BaseException:
            self.claims.end(claim, BROKEN)
            raise
        self.claims.end(claim, DONE)
        return rows

    def since(self, mark: int | None) -> DataFrame:
        """Rows appended after ``mark``, in id order; all of them for None."""
        return self.read().filter(F.col("id") > (mark or 0)).orderBy("id")

    def for_package(self, file_name: str, columns: Sequence[str] = CONVERSION_LOG.names) -> DataFrame:
        """The rows of one package in id order, all columns or some."""
        rows = self.read().filter(F.col("ssis_file_name") == file_name)
        return rows.orderBy("id").select(*columns)

    def append(self, rows: DataFrame, order: Sequence[str], run: str | None = None) -> DataFrame:
        """Append rows with the next ids, counted in ``order``; gives the appended rows.

        ``order`` may name columns beside the eight of a log row; they are not stored. A row
        without a required column fails the append before anything is written.
        """
        conform(rows, CONVERSION_ROW, "log rows")
        wanted = [*CONVERSION_ROW.names, *(name for name in order if name not in CONVERSION_ROW.names)]
        marked = lay_out(refuse_violations(rows.select(*wanted)), *order)
        return self.append_marked(stage(marked, run and self.part(run, "rows")), run)

    def append_marked(self, marked: DataFrame, run: str | None = None) -> DataFrame:
        """Append rows that were laid out in order and staged; gives the appended rows.

        A ``run`` name makes a retry exact. The ids of every attempt are recorded before its write.
        A row counts as written where the log holds it, all eight columns of it, under an id that an
        attempt gave it. What is absent keeps its ids where they are free; where another writer went
        on above the mark, it is numbered after the new maximum. A finished run is recorded and only
        read after that.
        """
        if run is None:
            own = self.claims.claim(marked.count(), uuid.uuid4().hex, self._mark)
            numbered = ids_of(marked.select(*CONVERSION_ROW.names, MARK), own.first - 1)
            return self._put(own, numbered.select(*CONVERSION_LOG.names))
        done = self.part(run, "done")
        rows = marked.select(*CONVERSION_ROW.names, MARK)
        if is_staged(self.spark, done):
            return self._with_ids(rows, stage(self._none(), done, ATTEMPT))
        attempts = []
        while is_staged(self.spark, self.part(run, f"try{len(attempts)}")):
            attempts.append(stage(self._none(), self.part(run, f"try{len(attempts)}"), ATTEMPT))
        if not attempts:
            own = self.claims.claim(rows.count(), run, self._mark)
            final = self._attempt(run, 0, rows.select(MARK, F.col(MARK).alias("_key")), own.first - 1)
            # the same ids again, where the rows are
            self._put(own, ids_of(rows, own.first - 1).select(*CONVERSION_LOG.names))
        else:
            # text is compared where the ids meet, in a retry only
            given = self._with_ids(rows, reduce(DataFrame.unionByName, attempts), MARK)
            log = self.read().select([F.col(name).alias(f"_{name}") for name in CONVERSION_LOG.names])
            met = given.join(log.hint("merge"), F.col("id") == F.col("_id"))
            same = reduce(and_, (F.col(n).eqNullSafe(F.col(f"_{n}")) for n in CONVERSION_ROW.names))
            written = stage(met.filter(same).select(MARK, "id").groupBy(MARK).agg(F.min("id").alias("id")))
            absent = stage(attempts[-1].join(written.select(MARK), MARK, "left_anti"))
            final = written
            if not absent.isEmpty():
                own, wanted = self._again(run, attempts, absent, written)
                self._put(own, self._with_ids(rows, wanted))
                final = wanted.unionByName(written)
        return self._with_ids(rows, stage(final, done))

    def _again(
        self, run: str, attempts: list[DataFrame], absent: DataFrame, written: DataFrame
    ) -> tuple[Claim, DataFrame]:
        """A claim for the absent rows, and their ids: those they had, where nobody else has any of them."""
        before = attempts[0].agg(F.min("id")).first()[0]
        had = absent.agg(F.min("id").alias("first"), F.max("id").alias("last")).first()
        while True:
            claims = self.claims
            known = claims.known()
            foreign = [c for c in known if c.state != BROKEN and c.owner != run and c.last >= before]
            others = self.read().filter(F.col("id") >= before).select("id").join(written.select("id"), "id", "left_anti")
            if foreign or not others.isEmpty():
                own = claims.claim(absent.count(), run, self._mark)
                again = stage(lay_out(absent.select(F.col(MARK).alias("_key")), "_key"))
                return own, self._attempt(run, len(attempts), again, own.first - 1)
            own = claims.take(known, had["first"], max(had["last"], *(c.last for c in known), 0), run)
            if own is not None:
                return own, absent

    def _attempt(self, run: str, n: int, rows: DataFrame, start: int) -> DataFrame:
        """Number rows after ``start`` and record it; ``_key`` holds their marks in the run."""
        numbered = ids_of(rows, start).select(F.col("_key").alias(MARK), "id")
        return stage(numbered, self.part(run, f"try{n}"))

    def _with_ids(self, rows: DataFrame, ids: DataFrame, *carry: str) -> DataFrame:
        return rows.join(ids, MARK).select(*CONVERSION_LOG.names, *carry)

    def _write(self, rows: DataFrame) -> DataFrame:
        writer = rows.write.mode("append").format(self.format)
        if not is_path(self.location):
            writer.saveAsTable(self.location)
        elif self.format != "parquet":
            writer.save(self.location)
        else:
            # written apart and moved: two appends to one folder would clear each other's unfinished files
            apart = f"{self.location.rstrip('/')}/_claims/rows-{uuid.uuid4().hex}"
            writer.save(apart)
            move_files(self.spark, apart, self.location)
        return rows

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], ATTEMPT)

    def part(self, run: str, name: str) -> str:
        """The name of a staged part of a run; runs of different logs share nothing."""
        return f"{hashlib.md5(self.location.encode()).hexdigest()}-{run}-{name}"

    def claim(self, run: str, **settings: str | None) -> None:
        """Record what a run is made of; raises where it was begun with other settings."""
        rows = [(key, value) for key, value in sorted(settings.items())]
        declared = self.spark.createDataFrame(rows, "setting string, value string")
        begun = {r["setting"]: r["value"] for r in stage(declared, self.part(run, "settings")).collect()}
        changed = sorted(key for key, value in rows if begun.get(key) != value)
        if changed:
            raise ValueError(f"run {run!r} was begun with other settings: {changed}")

    def release(self, run: str) -> None:
        """Delete the staged parts of a finished run. It cannot be taken up or read from after that."""
        for name in staged_names(self.spark, self.part(run, "")):
            unstage(self.spark, name)
