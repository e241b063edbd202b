"""The engine: databases of versioned tables, SQL over them, and transactions."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.types import field
from quarry.operators import constraints, dml, fulltext, stats
from quarry.operators.ddl import information_schema_columns
from quarry.plans import definitions
from quarry.plans.ranges import RangedSession, RangedTable, placed
from quarry.plans.router import KeyRange, RouteError
from quarry.plans.statements import Statement, StatementError, parse
from quarry.operators.transactions import Session, commit_together
from quarry.sources.staging import staged
from quarry.sources.storage import TwoPhase, VersionedTable


class Engine:
    """Tables under ``warehouse/<database>/<table>``; names are found in any case and keep their spelling."""

    def __init__(self, spark: SparkSession, warehouse: str, database: str = "app"):
        self.spark, self.warehouse, self.database = spark, warehouse.rstrip("/"), database

    def _path(self, name: str) -> str:
        return f"{self.warehouse}/{self.database.lower()}/{name.lower()}"

    def table(self, name: str) -> VersionedTable:
        t = VersionedTable(self.spark, self._path(name))
        if t.version() is None:
            raise LookupError(f"no table {name}")
        return t

    def tables(self) -> list[str]:
        files = VersionedTable(self.spark, self._path("x")).files
        return [n for n in files.names(f"{self.warehouse}/{self.database.lower()}") if VersionedTable(self.spark, self._path(n)).version() is not None]

    def create_table(self, name: str, columns: dict[str, str], primary_key: list[str] = (), unique: list[list[str]] = (), checks: list[str] = (), rows: DataFrame | None = None, **more) -> VersionedTable:
        """A table from declared MySQL types, empty or with rows that must satisfy its constraints. ``more``:
        auto_increment (the counted column), defaults and on_update (expressions by column), comment, ..."""
        from pyspark.sql import types as T

        schema = T.StructType([field(c, k, c not in primary_key) for c, k in columns.items()])
        data = self.spark.createDataFrame([], schema) if rows is None else rows.select(*[rows[c].cast(schema[c].dataType).alias(c) for c in columns])
        meta = {"name": name, "columns": columns, "primary_key": list(primary_key), "unique": [list(u) for u in unique], "checks": list(checks)} | more
        self.validate(data, meta)
        return VersionedTable.create(self.spark, self._path(name), data, **meta)

    def drop_table(self, name: str) -> None:
        t = self.table(name)
        t.files.delete(t.path)

    def rename_table(self, old: str, new: str) -> None:
        t = self.table(old)
        t.backup(self._path(new))
        t.files.delete(t.path)

    @staticmethod
    def validate(rows: DataFrame, meta: dict) -> None:
        if meta.get("primary_key"):
            constraints.require_key(rows, meta["primary_key"])
        for u in meta.get("unique", []):
            constraints.require_empty(constraints.duplicates(rows, u), f"unique {u}")
        for i in meta.get("indexes", {}).values():
            if i["unique"]:
                constraints.require_empty(constraints.duplicates(rows, i["columns"], prefixes=i.get("prefixes")), f"unique {i['columns']}")
        for c in meta.get("checks", []):
            constraints.require_empty(constraints.check_failures(rows, c), f"check {c}")

    def write(self, name: str, rows: DataFrame) -> int:
        """A new version with these rows, which must satisfy the constraints."""
        t = self.table(name)
        v = t.version()
        self.validate(rows, t.meta(v))
        return t.commit(rows, v)

    def alter(self, name: str, rows: DataFrame, columns: dict[str, str], check: dict | None = None, **changes) -> int:
        """A new version with another schema (see :mod:`quarry.operators.ddl`). ``check``: the constraints that the
        change can break; all of them without it."""
        t = self.table(name)
        v = t.version()
        meta = t.meta(v) | {"columns": columns} | changes
        self.validate(rows, meta if check is None else check)
        return t.commit(rows, v, **{k: meta[k] for k in ("columns", *changes)})

    def set_attributes(self, name: str, **changes) -> int:
        """A new version with the same rows and other metadata: comment, collation, indexes, keys."""
        t = self.table(name)
        v = t.version()
        m = t.meta(v)
        return t.publish(m["folder"], v, **{"edits": m.get("edits", []), **changes})

    def create_index(self, name: str, index: str, columns: list[str], unique: bool = False, prefixes: dict[str, int] | None = None) -> None:
        """The definition of an index; a unique one is refused, and not kept, if rows break it."""
        t = self.table(name)
        known = t.meta().get("indexes", {})
        if index.lower() in (k.lower() for k in known):
            raise FileExistsError(f"index {index}")
        own = {"columns": columns, "unique": unique, "prefixes": prefixes or {}}
        self.validate(t.read(), {"indexes": {index: own}})
        self.set_attributes(name, indexes=known | {index: own})

    def drop_index(self, name: str, index: str) -> None:
        known = self.table(name).meta().get("indexes", {})
        self.set_attributes(name, indexes={k: v for k, v in known.items() if k.lower() != index.lower()})

    def indexes(self, name: str) -> list[tuple[str, list[str]]]:
        """PRIMARY first, the others by name."""
        m = self.table(name).meta()
        own = [(k, v["columns"]) for k, v in sorted(m.get("indexes", {}).items())]
        return ([("PRIMARY", m["primary_key"])] if m.get("primary_key") else []) + own

    def add_foreign_key(self, name: str, columns: list[str], parent: str, parent_columns: list[str]) -> None:
        rows = constraints.orphans(self.table(name).read(), columns, self.table(parent).read(), parent_columns)
        constraints.require_empty(rows, f"foreign key {columns}")
        keys = self.table(name).meta().get("foreign_keys", [])
        self.set_attributes(name, foreign_keys=[*keys, {"columns": columns, "parent": parent, "parent_columns": parent_columns}])

    def check_foreign_keys(self, name: str) -> None:
        for k in self.table(name).meta().get("foreign_keys", []):
            rows = constraints.orphans(self.table(name).read(), k["columns"], self.table(k["parent"]).read(), k["parent_columns"])
            constraints.require_empty(rows, f"foreign key {k['columns']}")

    def analyze(self, name: str, columns: list[str]) -> dict:
        """Statistics of the latest version, kept with the table until they are dropped."""
        t = self.table(name)
        own = stats.analyze(t.read(), columns).first().asDict()
        self.set_attributes(name, statistics=t.meta().get("statistics", {}) | {",".join(columns): own})
        return own

    def statistics(self, name: str, columns: list[str]) -> dict | None:
        return self.table(name).meta().get("statistics", {}).get(",".join(columns))

    def drop_statistics(self, name: str) -> None:
        self.set_attributes(name, statistics={})

    def begin(self, name: str, level: str = "repeatable read", read_only: bool = False) -> Session:
        """A transaction over one table; over all its ranges if it has some."""
        t = self.table(name)
        m = t.meta()
        if m.get("ranges"):
            return RangedSession(t, m["primary_key"], level, read_only, ranged=RangedTable(t, m["range_column"]))
        return Session(t, m["primary_key"], level, read_only)

    # ranges
    def shard_table(self, name: str, column: str, ranges: list[KeyRange], unique: list[str] = ()) -> None:
        """Store the table by ranges of a key, those it has and these; all its rows must be in one."""
        t = self.table(name)
        v = t.version()
        m, rows = t.meta(v), t.read(v)
        if m.get("ranges") and m["range_column"] != column:
            raise RouteError(f"{name} is placed by {m['range_column']}")
        ranges = [KeyRange(p["group"], p["start"], p["end"], p["copying"]) for p in m.get("ranges", [])] + list(ranges)
        ends = sorted((float("-inf") if r.start is None else r.start, float("inf") if r.end is None else r.end) for r in ranges)
        if any(a >= b for a, b in ends) or any(one[1] > two[0] for one, two in zip(ends, ends[1:])):
            raise RouteError("ranges overlap or are empty")
        if not placed(rows, column, ranges).where("range_id is null").isEmpty():
            raise RouteError("no range holds some keys")
        uniques = m.get("unique", []) + [[c] for c in unique if [c] not in m.get("unique", [])]
        self.validate(rows, m | {"unique": uniques})
        parts = [vars(r) | {"folder": t.stage(rows.where(r.predicate(column)))} for r in ranges]
        t.publish(parts[0]["folder"], v, ranges=parts, range_column=column, unique=uniques)

    def _ranged(self, name: str) -> RangedTable:
        t = self.table(name)
        m = t.meta()
        if not m.get("ranges"):
            raise RouteError(f"{name} has no ranges")
        return RangedTable(t, m["range_column"])

    def split_range(self, name: str, at: int | None = None, group: str | None = None) -> int:
        own = self._ranged(name)
        taken = {r.group for r, _ in own.parts()}
        return own.split(at, group or next(g for n in range(len(taken) + 1) if (g := f"g{n}") not in taken))

    def split_over(self, name: str, limit: int) -> list[int]:
        """Split every range that is stored in more than ``limit`` bytes; the keys at which it split."""
        own = self._ranged(name)
        taken = {r.group for r, _ in own.parts()}
        return own.split_over(limit, lambda n: [g for i in range(n + len(taken) + 1) if (g := f"g{i}") not in taken][n])

    def commit_together(self, sessions: list[Session]) -> None:
        """Commit sessions on several tables, all of them or none."""
        commit_together(f"{self.warehouse}/_transactions", uuid.uuid4().hex, sessions)

    def recover(self) -> dict[str, bool]:
        """Finish what a crash has left between prepare and decision."""
        return TwoPhase(self.spark, f"{self.warehouse}/_transactions").recover(self.spark)

    # SQL text
    def _register(self, text: str) -> None:
        """Temporary views of the tables and stored views that a statement names; nothing else is opened."""
        words = {w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_$]*", text)}
        for n, body in self.definitions("view").items():
            if n in words:
                self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{n}` AS {self._prepared(body['text'])}")
        for n in VersionedTable(self.spark, self._path("x")).files.names(f"{self.warehouse}/{self.database.lower()}"):
            if n in words and not n.startswith("_"):
                self._frame(n).createOrReplaceTempView(n)

    def _frame(self, name: str) -> DataFrame:
        """The rows that a statement sees of a table."""
        return self.table(name).read()

    def _prepared(self, text: str) -> str:
        self._register(text)
        return text

    def sql(self, text: str, **binds) -> DataFrame:
        """A query over the latest versions of the tables that it names; ``:name`` takes a bind value."""
        return self.spark.sql(self._prepared(text), args=binds or None)

    def execute(self, text: str, session: Session | None = None) -> DataFrame | int:
        """Any statement: a query gives its rows, a change the number of rows that it matched.

        INSERT, REPLACE, INSERT IGNORE, ON DUPLICATE KEY UPDATE (VALUES or SELECT), UPDATE, DELETE and TRUNCATE
        of one table. Without a session a change commits at once; with one (of that table) it is part of it.
        A table without a primary key takes INSERT, DELETE and UPDATE too; equal rows count one by one.
        Statements that define, show, load or copy: see :mod:`quarry.plans.definitions`; they have their own commits.
        """
        if (out := definitions.run(self, text)) is not None:
            return out
        s = parse(text)
        if s.kind == "query":
            return self.sql(text)
        t = self.table(s.table)
        keys = t.meta().get("primary_key")
        if s.kind == "truncate":
            n = t.read().count()
            v = t.version()
            t.commit(t.read(v).limit(0), v, counter=1)
            return n
        if not keys:
            return self._execute_keyless(t, s)
        own = session or self.begin(s.table)
        n = self._change(own, s)
        if session is None:
            own.commit()
        return n

    def _given(self, t: VersionedTable, s: Statement) -> DataFrame:
        """The rows of an INSERT in the table's columns: defaults and the counter fill what isn't named."""
        return self._completed(s.table, self.sql(s.source), s.columns)

    def _completed(self, name: str, rows: DataFrame, columns=()) -> DataFrame:
        t = self.table(name)
        meta, schema = t.meta(), t.read().schema
        names = columns or [f.name for f in schema.fields]
        if len(rows.columns) != len(names):
            raise ValueError(f"{len(names)} columns, {len(rows.columns)} values")
        rows = rows.toDF(*names)
        if missing := [c for c in names if c not in schema.names]:
            raise LookupError(f"no column {missing}")
        defaults = meta.get("defaults", {})
        out = rows.select(*[(F.col(f.name) if f.name in names else F.expr(defaults[f.name]) if f.name in defaults else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        if auto := meta.get("auto_increment"):
            out = self.numbered(name, out, auto)
        return out

    def load(self, name: str, rows: DataFrame, mode: str = "insert") -> int:
        """Rows whose columns are named like the table's, in one commit; ``mode``: insert, replace or ignore."""
        t = self.table(name)
        rows = staged(self._completed(name, rows, rows.columns), "given")
        if not t.meta().get("primary_key"):
            v = t.version()
            out = t.read(v).unionByName(rows)
            self.validate(out, t.meta(v))
            t.commit(out, v)
            return rows.count()
        own = self.begin(name)
        {"insert": own.insert, "replace": own.replace, "ignore": own.insert_ignore}[mode](rows)
        own.commit()
        return rows.count()

    def restore(self, source: str) -> int:
        """Bring back the tables of a backup, none of which may exist now; their number."""
        names = VersionedTable(self.spark, self._path("x")).files.names(source)
        if taken := sorted(set(names) & set(self.tables())):
            raise FileExistsError(f"tables {taken}")
        for n in names:
            VersionedTable.restore(self.spark, f"{source}/{n}", self._path(n))
        return len(names)

    def connect(self, level: str = "repeatable read") -> Connection:
        return Connection(self.spark, self.warehouse, self.database, level)

    def numbered(self, name: str, rows: DataFrame, column: str) -> DataFrame:
        """Rows without a value in the counted column get the next ones; the counter is kept with the table, and
        an explicit value above it raises it. It is raised before the rows are written, so a number that was
        given is not given again, and gaps stay."""
        rows = staged(rows.withColumn("_at", F.monotonically_increasing_id()), "rows")
        blank = rows.where(F.col(column).isNull()).count()
        top = rows.agg(F.max(column)).first()[0]
        t = self.table(name)
        start = t.meta().get("counter", 1)
        after = max(start + blank, 0 if top is None else int(top) + 1 + blank)
        if blank or after > start:
            self.set_attributes(name, counter=after)
        return dml.auto_increment(rows, column, start, "_at").drop("_at")

    def _change(self, own: Session, s: Statement) -> int:
        table = own.table
        if s.kind in ("insert", "replace", "ignore", "upsert"):
            rows = staged(self._given(table, s), "given")
            n = rows.count()
            if own.pinned != table.version() and not own.edits:
                own.pinned = table.version()  # the counter may have moved the table
            if s.kind == "upsert":
                own.upsert(rows, {c: F.expr(re.sub(r"(?i)\bvalues\s*\(\s*`?(\w+)`?\s*\)", r"new.\1", e)) for c, e in self._qualified(s, rows).items()})
            else:
                {"insert": own.insert, "replace": own.replace, "ignore": own.insert_ignore}[s.kind](rows)
            return n
        where = F.expr(s.where) if s.where else F.lit(True)
        n = own.read().where(where).count()
        if s.kind == "delete":
            own.delete(where)
        else:
            changes = dict(s.assign)
            for c, e in table.meta().get("on_update", {}).items():
                changes.setdefault(c, e)
            own.update(where, {c: F.expr(e) for c, e in changes.items()})
        return n

    @staticmethod
    def _qualified(s: Statement, rows: DataFrame) -> dict[str, str]:
        """Bare column names of ON DUPLICATE KEY UPDATE mean the old row."""
        names = "|".join(map(re.escape, rows.columns))
        inner = re.compile(rf"(?i)(values\s*\(\s*`?\w+`?\s*\)|'(?:[^']|'')*'|\b\w+\.\w+)|\b({names})\b")
        return {c: inner.sub(lambda m: m[1] or f"old.{m[2]}", e) for c, e in s.assign.items()}

    def _execute_keyless(self, t: VersionedTable, s: Statement) -> int:
        v = t.version()
        base = t.read(v)
        if s.kind == "insert":
            rows = self._given(t, s)
            self.validate(base.unionByName(rows), t.meta(v))
            t.commit(base.unionByName(rows), v)
            return rows.count()
        where = F.expr(s.where) if s.where else F.lit(True)
        if s.kind not in ("update", "delete"):
            raise ValueError(f"{s.kind} needs a key")
        hit = base.where(where)
        out = dml.delete(base, where) if s.kind == "delete" else dml.update(base, where, {c: F.expr(e) for c, e in s.assign.items()})
        self.validate(out, t.meta(v))
        n = hit.count()
        t.commit(out, v)
        return n

    # databases, views, indexes
    def databases(self) -> list[str]:
        files = VersionedTable(self.spark, self._path("x")).files
        return [n for n in files.names(self.warehouse) if not n.startswith("_")]

    def create_database(self, name: str) -> None:
        files = VersionedTable(self.spark, self._path("x")).files
        if not files.create(f"{self.warehouse}/{name.lower()}/_database.json", json.dumps({"name": name})):
            raise FileExistsError(f"database {name}")

    def drop_database(self, name: str) -> None:
        files = VersionedTable(self.spark, self._path("x")).files
        if name.lower() not in self.databases():
            raise LookupError(f"no database {name}")
        files.delete(f"{self.warehouse}/{name.lower()}")

    def use(self, name: str) -> None:
        if name.lower() not in self.databases():
            raise LookupError(f"no database {name}")
        self.database = name

    def create_view(self, name: str, text: str, replace: bool = False) -> None:
        """Kept with the database; its text is checked now and run anew by each query that names it."""
        self.sql(text)
        if replace and name.lower() in self.definitions("view"):
            self.drop_definition("view", name)
        self.save_definition("view", name, {"text": text})

    def drop_view(self, name: str) -> None:
        if name.lower() not in self.definitions("view"):
            raise LookupError(f"no view {name}")
        self.drop_definition("view", name)
        self.spark.catalog.dropTempView(name.lower())

    def rename_index(self, name: str, old: str, new: str) -> None:
        known = self.table(name).meta().get("indexes", {})
        found = next((k for k in known if k.lower() == old.lower()), None)
        if found is None:
            raise LookupError(f"no index {old}")
        if new.lower() in (k.lower() for k in known if k != found):
            raise FileExistsError(f"index {new}")
        self.set_attributes(name, indexes={new if k == found else k: v for k, v in known.items()})

    def add_primary_key(self, name: str, columns: list[str]) -> None:
        t = self.table(name)
        if t.meta().get("primary_key"):
            raise FileExistsError("primary key")
        constraints.require_key(t.read(), columns)
        self.set_attributes(name, primary_key=columns)

    def drop_primary_key(self, name: str) -> None:
        """The rows stay; edits that need the key are merged first. A counted column needs its key."""
        t = self.table(name)
        if not t.meta().get("primary_key"):
            raise LookupError("no primary key")
        if t.meta().get("auto_increment") in t.meta()["primary_key"]:
            raise ValueError("a counted column must be a key")
        t.compact()
        self.set_attributes(name, primary_key=[])

    # full text
    def create_fulltext(self, name: str, index: str, column: str) -> None:
        """A stored inverted index, kept in step by :meth:`refresh_fulltext`."""
        t = self.table(name)
        known = t.meta().get("fulltext", {})
        if index in known:
            raise FileExistsError(f"index {index}")
        v = t.version()
        key = t.meta(v)["primary_key"]
        if len(key) != 1:
            raise ValueError("a full-text index needs a key of one column")
        fulltext.store(t.read(v), key[0], column, f"{t.path}/_fulltext/{index}/v{v}")
        self.set_attributes(name, fulltext=known | {index: {"column": column, "version": v}})

    def refresh_fulltext(self, name: str) -> None:
        """Bring the stored indexes to the latest version: only rows that changed are read as text."""
        t = self.table(name)
        v, m = t.version(), t.meta()
        own = dict(m.get("fulltext", {}))
        for index, i in own.items():
            if t.folders(m) == t.folders(t.meta(i["version"])):
                continue
            path = f"{t.path}/_fulltext/{index}"
            fulltext.update(self.spark, f"{path}/v{i['version']}", f"{path}/v{v}", t.read(i["version"]), t.read(v), m["primary_key"][0], i["column"])
            own[index] = i | {"version": v}
        self.set_attributes(name, fulltext=own)

    def match(self, name: str, index: str, words: list[str]) -> DataFrame:
        """id and score of MATCH ... AGAINST, from the stored index alone."""
        self.refresh_fulltext(name)
        t = self.table(name)
        i = t.meta()["fulltext"][index]
        return fulltext.match_stored(self.spark, f"{t.path}/_fulltext/{index}/v{i['version']}", words)

    def information_schema(self) -> DataFrame:
        return information_schema_columns(self.spark, {n: self.table(n).read() for n in self.tables()}, self.database)

    def save_definition(self, kind: str, name: str, body: dict) -> None:
        """Keep the definition of a view, trigger, procedure or event; a name is taken once."""
        files = VersionedTable(self.spark, self._path("x")).files
        if not files.create(f"{self._path('_' + kind)}/{name.lower()}.json", json.dumps(body)):
            raise FileExistsError(f"{kind} {name}")

    def definitions(self, kind: str) -> dict[str, dict]:
        files = VersionedTable(self.spark, self._path("x")).files
        folder = self._path("_" + kind)
        return {n.removesuffix(".json"): json.loads(files.read(f"{folder}/{n}")) for n in files.names(folder) if n.endswith(".json")}

    def drop_definition(self, kind: str, name: str) -> None:
        files = VersionedTable(self.spark, self._path("x")).files
        files.delete(f"{self._path('_' + kind)}/{name.lower()}.json")


class Connection(Engine):
    """Statements of one client, in transactions: BEGIN, COMMIT, ROLLBACK, SAVEPOINT and the like as text.

    Outside a transaction each change commits at once. In one, every table is seen as it was when it was first
    named, with the transaction's own changes; COMMIT publishes all tables or none. A statement that defines
    something commits what is open. Changes of a table without a primary key are refused in a transaction.
    """

    def __init__(self, spark: SparkSession, warehouse: str, database: str = "app", level: str = "repeatable read"):
        super().__init__(spark, warehouse, database)
        self.level, self.read_only = level, False
        self.sessions: dict[str, Session] | None = None
        self.pinned: dict[str, int] = {}
        self.marks: list[str] = []

    def session(self, name: str) -> Session:
        key = f"{self.database}/{name}".lower()
        if key not in self.sessions:
            own = self.sessions[key] = self.begin(name, self.level, self.read_only)
            for mark in self.marks:  # declared before the table was named
                own.savepoint(mark)
        return self.sessions[key]

    def _frame(self, name: str) -> DataFrame:
        if self.sessions is None:
            return super()._frame(name)
        t = self.table(name)
        if t.meta().get("primary_key"):
            return self.session(name).read()
        return t.read(self.pinned.setdefault(t.path, t.version()))

    def _end(self) -> None:
        self.sessions, self.pinned, self.marks, self.read_only = None, {}, [], False

    def commit(self) -> None:
        """Publish what the transaction has changed; it is over, whether that succeeds or not."""
        changed = [s for s in (self.sessions or {}).values() if s.edits]
        self._end()
        if len(changed) == 1:
            changed[0].commit()
        elif changed:
            self.commit_together(changed)

    def _mark(self, what: str, name: str) -> None:
        """SAVEPOINT, ROLLBACK TO or RELEASE of one name, in all tables."""
        if self.sessions is None:
            raise StatementError("no transaction")
        if what != "savepoint" and name not in self.marks:
            raise LookupError(f"no savepoint {name}")
        for s in self.sessions.values():
            getattr(s, what)(name)
        at = self.marks.index(name) if name in self.marks else len(self.marks)
        if what == "savepoint":
            self.marks = [m for m in self.marks if m != name] + [name]
        else:
            self.marks = self.marks[: at + (what == "rollback_to")]

    def execute(self, text: str, session: Session | None = None) -> DataFrame | int:
        words = text.strip().rstrip(";").split()
        first = " ".join(words[:2]).lower()
        if first == "begin" or first.startswith("begin ") or first == "start transaction":
            self.commit()
            self.sessions, self.read_only = {}, [w.lower() for w in words[-2:]] == ["read", "only"]
        elif first in ("commit", "commit work"):
            self.commit()
        elif m := re.fullmatch(r"(?i)\s*rollback(?:\s+work)?\s+to(?:\s+savepoint)?\s+`?(\w+)`?\s*;?\s*", text):
            self._mark("rollback_to", m[1].lower())
        elif first in ("rollback", "rollback work"):
            self._end()
        elif m := re.fullmatch(r"(?i)\s*(savepoint|release\s+savepoint)\s+`?(\w+)`?\s*;?\s*", text):
            self._mark("release" if m[1].lower().startswith("release") else "savepoint", m[2].lower())
        elif m := re.fullmatch(r"(?i)\s*set\s+(?:session\s+)?transaction\s+isolation\s+level\s+(.+?)\s*;?\s*", text):
            self.level = " ".join(m[1].lower().split())
        else:
            return self._statement(text, session)
        return 0

    def _statement(self, text: str, session: Session | None) -> DataFrame | int:
        if self.sessions is None or session is not None:
            return super().execute(text, session)
        if definitions.defines(text):
            self.commit()
            return super().execute(text)
        s = parse(text)
        if s.kind in ("insert", "replace", "ignore", "upsert", "update", "delete"):
            if not self.table(s.table).meta().get("primary_key"):
                raise StatementError(f"{s.table} has no key: it can't be changed in a transaction")
            return super().execute(text, self.session(s.table))
        return super().execute(text)
