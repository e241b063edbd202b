"""Sessions over versioned tables: snapshots, buffered edits, savepoints, commit and rollback."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.constraints import orphans, require_empty, require_key, require_valid
from quarry.operators.overlay import conflicts, edit_rows, last_edits, merge
from quarry.sources.staging import staged
from quarry.sources.storage import TwoPhase, VersionedTable

LEVELS = ("read uncommitted", "read committed", "repeatable read", "serializable")


class ReadOnlyError(PermissionError):
    pass


@dataclass
class Session:
    """One transaction on a table with a primary key.

    Repeatable read and serializable pin the version at the start; the other two read the latest one
    each time (nothing uncommitted of others is ever visible). Own edits are visible at once; each statement
    must satisfy the table's keys and checks. Commit fails if a row that was changed here has changed since, if
    another session has inserted its key or a value of a unique key (or, serializable, if anything has changed);
    then nothing is written. Only the rows of the edits are checked, against one scan of the table.
    """

    table: VersionedTable
    keys: list[str]
    level: str = "repeatable read"
    read_only: bool = False
    edits: list[DataFrame] = field(default_factory=list)
    marks: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        if self.level not in LEVELS:
            raise ValueError(self.level)
        self.pinned = self.table.version()

    def _version(self) -> int:
        return self.pinned if self.level in LEVELS[2:] else self.table.version()

    def log(self) -> DataFrame | None:
        out = None
        for e in self.edits:
            out = e if out is None else out.unionByName(e)
        return out

    def read(self) -> DataFrame:
        base, log = self.table.read(self._version()), self.log()
        return base if log is None else merge(base, log, self.keys)

    def count(self) -> int:
        """Rows as this session sees them, with its own edits."""
        return self.read().count()

    def _add(self, edits: DataFrame) -> None:
        if self.read_only:
            raise ReadOnlyError("the transaction is read only")
        # the rows are those of now: a plan would be evaluated again, and again differently, at every read
        edits = staged(edits, "edits")
        new = edits.where("op <> 'delete'").select(*[F.col(f"row.`{c}`").alias(c) for c in self.table.read(self._version()).columns])
        rest = self.read().join(last_edits(edits, self.keys).select(*self.keys), self.keys, "left_anti")
        require_valid(new, rest, self.table.meta(self._version()))
        self.edits.append(edits)

    def insert(self, rows: DataFrame) -> None:
        rows = rows.select(*self.table.read(self._version()).columns)
        require_key(rows, self.keys)
        require_empty(rows.join(self.read().select(*self.keys), self.keys, "left_semi").select(*self.keys), "duplicate key")
        self._add(edit_rows(rows, self.keys, "insert", F.lit(len(self.edits))))

    def update(self, where, assign: dict) -> None:
        """A key that is assigned moves: the old one ends, the new one begins."""
        seen = self.read()
        rows = seen.where(where)
        old = F.struct(*[F.col(f"_old_{k}").alias(k) for k in self.keys])
        wide = rows.select(*rows.columns, *[F.col(k).alias(f"_old_{k}") for k in self.keys])
        new = wide.select(*[assign[c].cast(rows.schema[c].dataType).alias(c) if c in assign else F.col(c) for c in rows.columns], *[f"_old_{k}" for k in self.keys])
        if set(assign) & set(self.keys):
            require_key(new, self.keys)
            stay = seen.join(rows.select(*self.keys), self.keys, "left_anti")
            require_empty(new.join(stay.select(*self.keys), self.keys, "left_semi").select(*self.keys), "duplicate key")
        row = F.struct(*rows.columns)
        self._add(new.select(F.lit(len(self.edits)).cast("long").alias("seq"), F.lit("update").alias("op"), old.alias("old"), row.alias("row")))

    def delete(self, where) -> None:
        self._add(edit_rows(self.read().where(where), self.keys, "delete", F.lit(len(self.edits))))

    def replace(self, rows: DataFrame) -> None:
        """REPLACE: rows that hold the primary or a unique key of a given one go, the given ones come."""
        rows = staged(rows.select(*self.table.read(self._version()).columns), "given")
        require_key(rows, self.keys)
        seen, meta = self.read(), self.table.meta(self._version())
        hit = None
        for columns in [self.keys, *meta.get("unique", []), *(i["columns"] for i in meta.get("indexes", {}).values() if i["unique"])]:
            own = seen.join(rows.select(*columns), columns, "left_semi").select(*seen.columns)
            hit = own if hit is None else hit.unionByName(own)
        gone = edit_rows(hit.dropDuplicates(self.keys), self.keys, "delete", F.lit(len(self.edits)))
        self._add(gone.unionByName(edit_rows(rows, self.keys, "insert", F.lit(len(self.edits)))))

    def insert_ignore(self, rows: DataFrame) -> None:
        """INSERT IGNORE: rows whose primary or unique key is taken are left out."""
        seen, meta = self.read(), self.table.meta(self._version())
        rows = rows.select(*seen.columns).dropDuplicates(self.keys)
        for columns in [self.keys, *meta.get("unique", [])]:
            present = F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False))
            rows = rows.where(present).unionByName(rows.where(~present).dropDuplicates(columns).join(seen.select(*columns), columns, "left_anti").select(*rows.columns))
        self._add(edit_rows(rows, self.keys, "insert", F.lit(len(self.edits))))

    def upsert(self, rows: DataFrame, on_duplicate: dict) -> None:
        """INSERT ... ON DUPLICATE KEY UPDATE by the primary key: expressions over ``old`` and ``new`` columns."""
        seen = self.read()
        rows = staged(rows.select(*seen.columns), "given")
        require_key(rows, self.keys)
        same = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in self.keys]
        both = seen.alias("old").join(rows.alias("new"), same)
        changed = both.select(*[on_duplicate.get(c, F.col(f"old.{c}")).cast(seen.schema[c].dataType).alias(c) for c in seen.columns])
        fresh = rows.join(seen.select(*self.keys), self.keys, "left_anti").select(*seen.columns)
        at = F.lit(len(self.edits))
        self._add(edit_rows(changed, self.keys, "update", at).unionByName(edit_rows(fresh, self.keys, "insert", at)))

    def savepoint(self, name: str) -> None:
        self.marks.pop(name, None)  # declared again, it moves
        self.marks[name] = len(self.edits)

    def rollback_to(self, name: str) -> None:
        n = self.marks[name]
        del self.edits[n:]
        names = list(self.marks)
        for later in names[names.index(name) + 1 :]:
            del self.marks[later]

    def release(self, name: str) -> None:
        names = list(self.marks)
        for gone in names[names.index(name) :]:
            del self.marks[gone]

    def rollback(self) -> None:
        self.edits.clear()
        self.marks.clear()
        self.pinned = self.table.version()

    def commit(self, **meta) -> int:
        """The version that holds the edits. ``meta`` goes with it (``tx``: see :class:`TwoPhase`)."""
        log = self.log()
        if log is None:
            return self._version()
        now = self.table.version()
        base = self.table.read(now)
        last = staged(last_edits(log, self.keys), "last")
        if now != self.pinned:
            if self.level == "serializable":
                require_empty(self.table.read(self.pinned).exceptAll(base).limit(1), "row changed")
                require_empty(base.exceptAll(self.table.read(self.pinned)).limit(1), "row changed")
            seen = self.table.read(self.pinned).join(last.select(*self.keys), self.keys, "left_semi")
            require_empty(conflicts(base, seen, self.keys, last), "row changed")
        new = last.where("not gone").select(*[F.col(f"row.`{c}`").alias(c) for c in base.columns])
        own = self.table.meta(now)
        require_valid(new, base.join(last.select(*self.keys), self.keys, "left_anti"), own)
        for k in own.get("foreign_keys", []):
            parent = VersionedTable(self.table.spark, f"{self.table.path.rsplit('/', 1)[0]}/{k['parent'].lower()}")
            require_empty(orphans(new, k["columns"], parent.read(), k["parent_columns"]), f"foreign key {k['columns']}")
        out = self.table.commit_edits(log, self.keys, now, **meta)
        self.rollback()
        return out


def commit_together(meta_path: str, name: str, sessions: list[Session]) -> None:
    """Commit sessions on several tables, all of them or none."""
    spark = sessions[0].table.spark
    TwoPhase(spark, meta_path).commit(spark, name, {s.table.path: lambda tx, s=s: s.commit(tx=tx) for s in sessions})
