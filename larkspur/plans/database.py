"""Tables that statements create and change: the dialect's DDL and DML over Parquet.

A table is a folder with a numbered version for each state; a change writes the next
version from the one before and then makes it the current one, so readers see whole states
only. What a statement changes is worked out as one plan over the stored rows; rows are
told apart by their keys, or by their place in the files where there are none.
"""

from __future__ import annotations

from collections.abc import Mapping
from copy import deepcopy
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import jsons
from larkspur.plans import rules
from larkspur.plans.frontend import COLLATION, Parser, Scope, _collated, kind_of, run, schema_of
from larkspur.plans.lexer import Unsupported, lex, name_of, string_of

TYPES = {
    "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "MEDIUMINT": T.IntegerType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(), "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "REAL": T.DoubleType(),
    "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampNTZType(), "BLOB": T.BinaryType(), "BINARY": T.BinaryType(),
    "VARBINARY": T.BinaryType(), "VECTOR": T.ArrayType(T.FloatType()),
}
TEXTS = {"CHAR", "VARCHAR", "TEXT", "TINYTEXT", "MEDIUMTEXT", "LONGTEXT", "JSON", "ENUM", "SET", "TIME"}


class ConstraintError(ValueError):
    """A row breaks a key, a NOT NULL or a CHECK."""


@dataclass(frozen=True)
class Affected:
    """How many rows a statement changed: 1 for an inserted row, 2 for one that an insert
    replaced or updated, 0 for one that already was as asked."""

    rows: int


@dataclass
class Stored:
    name: str
    columns: list[tuple[str, T.DataType]]
    path: str
    version: int = 0
    #: Primary key first, then unique keys.
    keys: list[list[str]] = field(default_factory=list)
    needed: set[str] = field(default_factory=set)
    defaults: dict[str, str] = field(default_factory=dict)
    checks: list[str] = field(default_factory=list)
    binary: set[str] = field(default_factory=set)
    counted: str | None = None

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in self.columns])


class Database:
    """Named tables in a shared folder, with ``run`` for any statement."""

    def __init__(self, spark: SparkSession, folder: str, tables: Mapping[str, DataFrame] | None = None, collation: str | None = COLLATION):
        self.spark, self.folder, self.collation = spark, folder.rstrip("/"), collation
        self.stored: dict[str, Stored] = {}
        self.views: dict[str, str] = {}
        self.given = {k.lower(): v for k, v in (tables or {}).items()}
        self.variables: dict[str, object] = {}

    # --- reading ----------------------------------------------------------------------

    def frame(self, name: str, places: bool = False) -> DataFrame:
        """A table's rows; ``places`` adds where each is stored."""
        key = name.lower()
        if key in self.given and key not in self.stored:
            return self.given[key]
        if key not in self.stored:
            raise LookupError(f"no table {name}")
        t = self.stored[key]
        if t.version == 0:
            empty = self.spark.createDataFrame([], t.schema)
            return empty.withColumn("_place", F.lit("")) if places else empty
        df = self.spark.read.schema(t.schema).parquet(f"{t.path}/{t.version:06d}")
        if places:
            return df.select(*t.names, F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias("_place"))
        return df

    def _tables(self) -> dict[str, DataFrame]:
        out = {**self.given, **{k: self.frame(k) for k in self.stored}}
        for name, text in self.views.items():
            out[name] = run(self.spark, text, {k: v for k, v in out.items()}, self.collation, self._binary())
        return out

    def _binary(self) -> tuple[str, ...]:
        return tuple({c for t in self.stored.values() for c in t.binary})

    def query(self, sql: str) -> DataFrame:
        words = {t.plain.lower() for t in lex(sql) if t.kind == "name"}
        tables = self._tables() if words & set(self.views) else {k: self.frame(k) for k in {*self.given, *self.stored} if k in words}
        used = {n: v for n, v in self.variables.items() if f"@{n}" in sql}
        return run(self.spark, sql, tables, self.collation, self._binary(), **used)

    def run(self, sql: str) -> DataFrame | Affected:
        """Rows of a query, or how many rows a statement changed."""
        jsons.register(self.spark)
        s = _Statement(self, sql.strip().rstrip(";"))
        return s.act()

    # --- writing ----------------------------------------------------------------------

    def write(self, t: Stored, rows: DataFrame, extra: str | None = None) -> int:
        """Make ``rows`` the next version; gives the sum of their column ``extra``."""
        path = f"{t.path}/{t.version + 1:06d}"
        typed = [F.col(name_of(n)).cast(k).alias(n) for n, k in t.columns]
        rows.select(*typed, *([F.col(extra)] if extra else [])).write.mode("overwrite").parquet(path)
        total = 0
        if extra:
            total = self.spark.read.parquet(path).agg(F.coalesce(F.sum(extra), F.lit(0))).first()[0]
        t.version += 1
        return int(total)

    def check(self, t: Stored, rows: DataFrame) -> None:
        """Raise ConstraintError if a row has a NULL where none may be or breaks a CHECK."""
        broken = F.lit(False)
        for n in t.needed:
            broken = broken | F.col(name_of(n)).isNull()
        for text in t.checks:
            parser = Parser(text, {}, None)
            parser.scope = Scope([(t.name, n, kind_of(k)) for n, k in t.columns])
            broken = broken | ~F.coalesce(F.expr(rules.truth(parser.expression())), F.lit(True))
        if (t.needed or t.checks) and not rows.where(broken).limit(1).isEmpty():
            raise ConstraintError(f"a row of {t.name} breaks a NOT NULL or a CHECK")

    def key(self, t: Stored, columns: list[str]) -> list:
        """Columns of a key as they are compared."""
        kinds = dict(t.columns)
        out = []
        for c in columns:
            known = next(n for n in t.names if n.lower() == c.lower())
            text = isinstance(kinds[known], T.StringType) and self.collation and known not in t.binary
            out.append(F.col(name_of(known)).cast(T.StringType(self.collation)) if text else F.col(name_of(known)))
        return out


class _Statement(Parser):
    """One statement that isn't a query."""

    def __init__(self, base: Database, sql: str):
        known = {k: schema_of(v) for k, v in base.given.items()}
        known |= {k: [(n, "bin" if n in t.binary else kind_of(d)) for n, d in t.columns] for k, t in base.stored.items()}
        super().__init__(sql, known, base.collation)
        self.base = base

    def act(self) -> DataFrame | Affected:
        w = self.peek().word
        if w in ("SELECT", "WITH", "(", "VALUES", "TABLE"):
            return self.base.query(self.sql)
        acts = {
            "INSERT": self.insert, "REPLACE": self.insert, "UPDATE": self.update, "DELETE": self.delete, "CREATE": self.create, "DROP": self.drop,
            "TRUNCATE": self.truncate, "ALTER": self.alter, "RENAME": self.rename, "SHOW": self.show, "DESCRIBE": self.describe, "DESC": self.describe,
            "EXPLAIN": self.explain, "ANALYZE": self.analyze, "SET": self.assign, "USE": self.ignored,
        }
        if w not in acts:
            raise Unsupported(f"statement {self.peek().text}")
        return acts[w]()

    def stored(self, name: str | None = None) -> Stored:
        name = name or self.name()
        if name.lower() not in self.base.stored:
            raise LookupError(f"no table {name}")
        return self.base.stored[name.lower()]

    def ignored(self) -> Affected:
        return Affected(0)

    def rest(self) -> str:
        return self.sql[self.peek().start :]

    def names_in_brackets(self) -> list[str]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.name())
            if self.word("("):
                self.skip()
            self.take("ASC")
            self.take("DESC")
            self.take(",")
        return out

    def frame_of(self, sql: str) -> DataFrame:
        """Rows of Spark SQL over the tables, which are views by then."""
        for name in {*self.base.given, *self.base.stored}:
            binary = self.base.stored[name].binary if name in self.base.stored else ()
            _collated(self.base.frame(name), self.collation, tuple(binary)).createOrReplaceTempView(name)
        return self.base.spark.sql(sql, args=self.base.variables or None)

    # --- INSERT, REPLACE ---------------------------------------------------------------

    def insert(self) -> Affected:
        replaces = self.next().word == "REPLACE"
        ignores = self.take("IGNORE")
        self.take("INTO")
        t = self.stored()
        columns = self.names_in_brackets() if self.word("(") and self.peek(1).word not in ("SELECT", "WITH") else []
        if self.take("SET"):
            pairs = self.assignments(Scope())
            columns, rows = [c for c, _ in pairs], self.frame_of("SELECT " + ", ".join(e for _, e in pairs))
        elif self.take("VALUES") or self.take("VALUE"):
            columns = columns or t.names
            selects = []
            while True:
                self.need("(")
                values = []
                while not self.take(")"):
                    place = columns[len(values)] if len(values) < len(columns) else "?"
                    values.append(self.default(t, place) if self.take("DEFAULT") else self.expression().sql)
                    self.take(",")
                if len(values) != len(columns):
                    raise Unsupported("as many values as columns are needed")
                kinds = {n.lower(): k.simpleString() for n, k in t.columns}
                selects.append("SELECT " + ", ".join(f"CAST({v} AS {kinds[c.lower()]}) AS {name_of(c)}" for c, v in zip(columns, values)) + f", {len(selects)} AS _seq")
                if not self.take(","):
                    break
            rows = self.frame_of(" UNION ALL ".join(selects))
        else:
            columns = columns or t.names
            end = self.find("ON") if self.upsert_follows() else None
            text = self.sql[self.peek().start : self.ts[end].start] if end else self.rest()
            rows = self.base.query(text)
            self.at = end if end is not None else len(self.ts)
        if "_seq" not in rows.columns:
            rows = rows.toDF(*columns).withColumn("_seq", F.monotonically_increasing_id())
        rows = self.completed(t, rows, columns)
        changes = []
        if self.take("ON", "DUPLICATE", "KEY", "UPDATE"):
            scope = Scope([(t.name, n, kind_of(k)) for n, k in t.columns])
            changes = self.assignments(scope, t)
        return self.merge(t, rows, "replace" if replaces else "ignore" if ignores else "update" if changes else "error", changes)

    def upsert_follows(self) -> bool:
        return any(a.word == "ON" and b.word == "DUPLICATE" for a, b in zip(self.ts, self.ts[1:]))

    def default(self, t: Stored, column: str) -> str:
        return t.defaults.get(column.lower(), "NULL")

    def completed(self, t: Stored, rows: DataFrame, columns: list[str]) -> DataFrame:
        """Rows with all columns of the table, in their types."""
        have = {c.lower(): c for c in columns}
        out = []
        for n, k in t.columns:
            e = F.col(name_of(have[n.lower()])) if n.lower() in have else F.expr(self.default(t, n))
            out.append(e.cast(k).alias(n))
        rows = rows.select(*out, "_seq")
        if t.counted:
            top = self.base.frame(t.name).agg(F.coalesce(F.max(t.counted), F.lit(0))).first()[0]
            kind = dict(t.columns)[t.counted]
            # Only the rows without a number are numbered, in their order.
            missing = rows.where(F.col(t.counted).isNull())
            if not missing.limit(1).isEmpty():
                from larkspur.operators.windows import numbered

                given = numbered(missing, [F.col("_seq")], "_n").withColumn(t.counted, (F.col("_n") + top).cast(kind)).drop("_n")
                rows = rows.where(F.col(t.counted).isNotNull()).unionByName(given)
        return rows

    def assignments(self, scope: Scope, t: Stored | None = None) -> list[tuple[str, str]]:
        """``column = expression`` pairs; with a table, VALUES(c) is the new row's value."""
        out = []
        self.scope = scope
        while True:
            parts = [self.name()]
            while self.take("."):
                parts.append(self.name())
            self.need("=")
            if t is not None:
                self.new_row = True
            if self.take("DEFAULT"):
                out.append((parts[-1], "NULL"))
            else:
                out.append((parts[-1], self.expression().sql))
            self.new_row = False
            if not self.take(","):
                return out

    new_row = False

    def call(self, w: str, start: int) -> rules.E:
        if w == "VALUES" and self.new_row:
            self.need("(")
            column = self.name()
            self.need(")")
            return rules.E(f"`_new`.{name_of(column)}", self.scope.kind(column, None), None, True)
        return super().call(w, start)

    def merge(self, t: Stored, rows: DataFrame, mode: str, changes: list[tuple[str, str]]) -> Affected:
        """Bring in rows under the table's keys, those of one statement one after the other."""
        base = self.base
        self.base.check(t, rows)
        old = base.frame(t.name)
        if not t.keys:
            return Affected(base.write(t, old.withColumn("_n", F.lit(0)).unionByName(rows.select(*t.names).withColumn("_n", F.lit(1))), "_n"))
        from larkspur.session import cut

        # Rows of one statement that share a key come in one round after the other.
        rank = F.lit(1)
        for k in t.keys:
            known = base.key(t, k)
            own = F.row_number().over(Window.partitionBy(*known).orderBy("_seq"))
            complete = known[0].isNotNull()
            for c in known[1:]:
                complete = complete & c.isNotNull()
            rank = F.greatest(rank, F.when(complete, own).otherwise(1))
        rows = cut(rows.withColumn("_round", rank))
        rounds = rows.agg(F.coalesce(F.max("_round"), F.lit(0))).first()[0]
        if mode == "error" and rounds > 1:
            raise ConstraintError(f"rows share a key of {t.name}")
        current = old.withColumn("_n", F.lit(0))
        for r in range(1, rounds + 1):
            current = self.round(t, current, rows.where(F.col("_round") == r).select(*t.names), mode, changes)
            if r < rounds:
                current = cut(current)
        return Affected(base.write(t, current, "_n"))

    def round(self, t: Stored, current: DataFrame, new: DataFrame, mode: str, changes: list[tuple[str, str]]) -> DataFrame:
        base = self.base
        n = new.select(F.struct(*[F.col(name_of(c)) for c in t.names]).alias("_new"), F.monotonically_increasing_id().alias("_id"))
        pairs = None
        for k in t.keys:
            mine = [c.alias(f"_k{i}") for i, c in enumerate(base.key(t, k))]
            theirs = n.select("_id", "_new", "_new.*").select("_id", "_new", *mine)
            held = current.select(F.struct(*[F.col(name_of(c)) for c in t.names], "_n").alias("_old"), *mine)
            met = theirs.join(held, [f"_k{i}" for i in range(len(k))]).select("_id", "_new", "_old")
            pairs = met if pairs is None else pairs.unionByName(met)
        if mode == "error":
            if not pairs.limit(1).isEmpty():
                raise ConstraintError(f"a key of {t.name} is there already")
            return current.unionByName(new.withColumn("_n", F.lit(1)))
        fresh = n.join(pairs.select("_id").distinct(), "_id", "left_anti").select("_new.*").withColumn("_n", F.lit(1))
        if mode == "ignore":
            return current.unionByName(fresh)
        primary = [F.col(f"_old.{name_of(c)}") for c in t.keys[0]]
        gone = pairs.select("_old.*").select(*[c.alias(f"_k{i}") for i, c in enumerate(base.key(t, t.keys[0]))]).distinct()
        kept = current.withColumns({f"_k{i}": c for i, c in enumerate(base.key(t, t.keys[0]))})
        same = None
        for i in range(len(t.keys[0])):
            c = kept[f"_k{i}"].eqNullSafe(gone[f"_k{i}"])
            same = c if same is None else same & c
        kept = kept.join(gone, same, "left_anti").select(*t.names, "_n")
        equal = F.lit(True)
        for c in t.names:
            equal = equal & F.col(f"_old.{name_of(c)}").eqNullSafe(F.col(f"_new.{name_of(c)}"))
        if mode == "replace":
            # One deletion for each row that stood there, and an insertion; an identical row counts once.
            done = pairs.groupBy("_id", "_new").agg(F.count(F.lit(1)).alias("_m"), F.bool_and(equal).alias("_same"), F.sum("_old._n").alias("_before"))
            changed = done.select("_new.*", (F.coalesce("_before", F.lit(0)) + F.when(F.col("_same"), 1).otherwise(F.col("_m") + 1)).cast("int").alias("_n"))
        else:
            first = pairs.groupBy(*[c.alias(f"_p{i}") for i, c in enumerate(primary)]).agg(F.min_by(F.struct("_old", "_new"), "_id").alias("_r")).select("_r.*")
            named = dict((c.lower(), e) for c, e in changes)
            kinds = dict(t.columns)
            flat = first.select("_new", *[F.col(f"_old.{name_of(c)}").alias(c) for c in t.names], F.col("_old._n").alias("_before"))
            sets = {c: F.expr(named[c.lower()]).cast(kinds[c]) if c.lower() in named else F.col(name_of(c)) for c in t.names}
            moved = F.lit(False)
            for c in t.names:
                moved = moved | ~sets[c].eqNullSafe(F.col(name_of(c)))
            changed = flat.alias(t.name).select(*[sets[c].alias(c) for c in t.names], (F.col("_before") + F.when(moved, 2).otherwise(0)).alias("_n"))
        base.check(t, changed)
        return kept.unionByName(fresh).unionByName(changed)

    # --- UPDATE, DELETE ----------------------------------------------------------------

    def places_view(self, t: Stored) -> None:
        df = self.base.frame(t.name, places=True)
        _collated(df, self.collation, (*t.binary, "_place")).createOrReplaceTempView(t.name)

    def update(self) -> Affected:
        self.next()
        self.take("IGNORE")
        scope = Scope()
        start = self.peek()
        source = self.sources(scope)
        name = start.plain
        t = self.stored(name)
        alias = scope.columns[0][0]
        self.need("SET")
        changes = self.assignments(scope)
        tail = self.condition(scope)
        picked = self.matched_places(t, alias, source, tail, [f"{e} AS {name_of('_s_' + c)}" for c, e in changes])
        hits = picked.dropDuplicates(["_place"]).withColumn("_hit", F.lit(True))
        both = self.base.frame(t.name, places=True).join(hits, "_place", "left")
        kinds = dict(t.columns)
        sets = {c.lower(): F.col(name_of("_s_" + c)) for c, _ in changes}
        new = {n: F.when(F.col("_hit"), sets[n.lower()].cast(kinds[n])).otherwise(F.col(name_of(n))) if n.lower() in sets else F.col(name_of(n)) for n in t.names}
        moved = F.lit(False)
        for n in t.names:
            moved = moved | ~new[n].eqNullSafe(F.col(name_of(n)))
        out = both.select(*[new[n].alias(n) for n in t.names], moved.cast("int").alias("_n"))
        self.base.check(t, out)
        for k in t.keys:
            if {c.lower() for c in k} & set(sets):
                known = self.base.key(t, k)
                if not out.groupBy(*known).agg(F.count(F.lit(1)).alias("c")).where("c > 1").dropna().limit(1).isEmpty():
                    raise ConstraintError(f"rows share a key of {t.name}")
        return Affected(self.base.write(t, out, "_n"))

    def matched_places(self, t: Stored, alias: str, source: str, tail: str, more: list[str]) -> DataFrame:
        for other in {*self.base.given, *self.base.stored} - {t.name.lower()}:
            binary = self.base.stored[other].binary if other in self.base.stored else ()
            _collated(self.base.frame(other), self.collation, tuple(binary)).createOrReplaceTempView(other)
        self.places_view(t)
        text = ", ".join([f"{name_of(alias)}.`_place`", *more])
        return self.base.spark.sql(f"SELECT {text}{source}{tail}", args=self.base.variables or None)

    def condition(self, scope: Scope) -> str:
        self.scope = scope
        out = f" WHERE {rules.truth(self.expression())}" if self.take("WHERE") else ""
        return out + (self.tail() if self.peek().word in ("ORDER", "LIMIT") else "")

    def delete(self) -> Affected:
        self.next()
        self.take("IGNORE")
        target = None
        if not self.take("FROM"):
            target = self.name()
            self.need("FROM")
        elif self.find("USING") is not None and self.peek(1).word == "USING":
            target = self.name()
            self.need("USING")
        scope = Scope()
        start = self.peek()
        source = self.sources(scope)
        names = {s.lower(): s for s, _, _ in scope.columns}
        alias = names[target.lower()] if target else scope.columns[0][0]
        known = target if target and target.lower() in self.base.stored else self.table_of(alias, start.plain)
        t = self.stored(known)
        tail = self.condition(scope)
        gone = self.matched_places(t, alias, source, tail, []).distinct()
        rows = self.base.frame(t.name, places=True)
        n = gone.count()
        self.base.write(t, rows.join(gone, "_place", "left_anti"))
        return Affected(n)

    def table_of(self, alias: str, first: str) -> str:
        """The table that an alias stands for."""
        for i, token in enumerate(self.ts[:-1]):
            following = self.ts[i + 1]
            if token.kind == "name" and token.plain.lower() in self.base.stored:
                after = self.ts[i + 2] if following.word == "AS" and i + 2 < len(self.ts) else following
                if after.plain.lower() == alias.lower():
                    return token.plain
        return alias if alias.lower() in self.base.stored else first

    # --- DDL ----------------------------------------------------------------------------

    def create(self) -> Affected:
        self.next()
        replaces = self.take("OR", "REPLACE")
        self.take("TEMPORARY")
        if self.take("VIEW"):
            name = self.name()
            if name.lower() in self.base.views and not replaces:
                raise ConstraintError(f"view {name} is there already")
            self.need("AS")
            self.base.views[name.lower()] = self.rest()
            return Affected(0)
        if self.take("FUNCTION"):
            return self.function()
        if self.peek().word in ("INDEX", "UNIQUE", "FULLTEXT", "SPATIAL"):
            unique = self.take("UNIQUE")
            while not self.take("ON"):
                self.next()
            t = self.stored()
            columns = self.names_in_brackets()
            if unique:
                self.unique(t, columns)
            return Affected(0)
        self.need("TABLE")
        spared = self.take("IF", "NOT", "EXISTS")
        name = self.name()
        if name.lower() in self.base.stored:
            if spared:
                return Affected(0)
            raise ConstraintError(f"table {name} is there already")
        t = Stored(name, [], f"{self.base.folder}/{name.lower()}")
        if self.take("LIKE") or self.word("(", "LIKE"):
            self.take("(")
            self.take("LIKE")
            other = self.stored()
            self.base.stored[name.lower()] = replace(deepcopy(other), name=name, path=t.path, version=0)
            return Affected(0)
        if self.word("(") and self.peek(1).word not in ("SELECT", "WITH"):
            self.definitions(t)
            while self.peek().kind != "end" and self.peek().word not in ("AS", "SELECT", "WITH", "("):
                self.next()
        self.take("AS")
        self.base.stored[name.lower()] = t
        if self.peek().word in ("SELECT", "WITH", "("):
            del self.base.stored[name.lower()]
            rows = self.base.query(self.rest())
            t.columns = t.columns or [(f.name, f.dataType) for f in rows.schema.fields]
            self.base.stored[name.lower()] = t
            return Affected(self.base.write(t, rows.toDF(*t.names).withColumn("_n", F.lit(1)), "_n"))
        return Affected(0)

    def function(self) -> Affected:
        """CREATE FUNCTION f(a INT, ...) RETURNS type ... RETURN expression: a function of the
        session whose body Spark writes into the plan."""
        name = self.name()
        self.need("(")
        given = []
        while not self.take(")"):
            column = self.name()
            given.append((column, self.column_type()[0]))
            self.take(",")
        self.need("RETURNS")
        kind = self.column_type()[0]
        while not self.take("RETURN"):
            if self.next().kind == "end" or self.peek().word == "BEGIN":
                raise Unsupported("a function's body has to be RETURN and an expression")
        self.scope = Scope([("", n, kind_of(k)) for n, k in given])
        body = self.expression().sql
        columns = ", ".join(f"{name_of(n)} {k.simpleString()}" for n, k in given)
        self.base.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name_of(name)}({columns}) RETURNS {kind.simpleString()} RETURN CAST({body} AS {kind.simpleString()})")
        return Affected(0)

    def unique(self, t: Stored, columns: list[str]) -> None:
        known = self.base.key(t, columns)
        shared = self.base.frame(t.name).select(*[c.alias(f"_k{i}") for i, c in enumerate(known)]).dropna()
        if not shared.groupBy(*shared.columns).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").limit(1).isEmpty():
            raise ConstraintError(f"rows share a key of {t.name}")
        t.keys.append(columns)

    def definitions(self, t: Stored) -> None:
        self.need("(")
        while not self.take(")"):
            if self.take("CONSTRAINT") and self.peek().word not in ("PRIMARY", "UNIQUE", "FOREIGN", "CHECK"):
                self.name()
            w = self.peek().word
            if self.take("PRIMARY", "KEY"):
                columns = self.names_in_brackets()
                t.keys.insert(0, columns)
                t.needed |= {n for n in t.names if n.lower() in {c.lower() for c in columns}}
            elif w in ("UNIQUE", "KEY", "INDEX", "FULLTEXT", "SPATIAL", "VECTOR") and (w != "VECTOR" or self.peek(1).word in ("INDEX", "KEY")):
                self.next()
                while not self.word("("):
                    self.next()
                columns = self.names_in_brackets()
                if w == "UNIQUE":
                    t.keys.append(columns)
            elif self.take("CHECK"):
                t.checks.append(self.bracket())
            elif self.take("FOREIGN", "KEY"):
                self.to_comma()
            else:
                self.column_definition(t)
            self.take(",")

    def bracket(self) -> str:
        start = self.at
        self.skip()
        return self.sql[self.ts[start].start : self.ts[self.at - 1].end]

    def to_comma(self) -> None:
        while self.peek().kind != "end" and not self.word(",") and not self.word(")"):
            self.skip() if self.word("(") else self.next()

    def column_type(self) -> tuple[T.DataType, list[str]]:
        w = self.next().word
        sizes: list[str] = []
        if self.word("("):
            start = self.at
            self.skip()
            sizes = [x.text for x in self.ts[start + 1 : self.at - 1] if x.word != ","]
        if self.take("UNSIGNED") and w == "BIGINT":
            return T.DecimalType(20, 0), sizes
        if w == "TINYINT" and sizes == ["1"]:
            return T.BooleanType(), sizes
        if w in ("DECIMAL", "NUMERIC", "DEC"):
            p, s = (int(x) for x in (*sizes, "10", "0")[:2]) if sizes else (10, 0)
            return T.DecimalType(min(p, 38), s if len(sizes) > 1 else 0), sizes
        if w in TEXTS:
            return T.StringType(), [w, *sizes]
        if w == "DOUBLE":
            self.take("PRECISION")
        if w in TYPES:
            return TYPES[w], sizes
        raise Unsupported(f"type {w}")

    def column_definition(self, t: Stored) -> str:
        name = self.name()
        kind, sizes = self.column_type()
        t.columns.append((name, kind))
        if sizes[:1] == ["ENUM"]:
            t.checks.append(f"{name_of(name)} IN ({', '.join(sizes[1:])})")
        elif sizes[:1] and sizes[0] in ("VARCHAR", "CHAR") and len(sizes) > 1:
            t.checks.append(f"CHAR_LENGTH({name_of(name)}) <= {sizes[1]}")
        while self.peek().kind != "end" and not self.word(",") and not self.word(")"):
            if self.take("NOT", "NULL"):
                t.needed.add(name)
            elif self.take("DEFAULT"):
                t.defaults[name.lower()] = self.bits().sql
            elif self.take("PRIMARY", "KEY"):
                t.keys.insert(0, [name])
                t.needed.add(name)
            elif self.take("UNIQUE"):
                self.take("KEY")
                t.keys.append([name])
            elif self.take("AUTO_INCREMENT"):
                t.counted = name
            elif self.take("CHECK"):
                t.checks.append(self.bracket())
            elif self.take("COLLATE"):
                named = self.name().lower()
                if named.endswith(("_bin", "_cs")) or named == "binary":
                    t.binary.add(name)
            elif self.word("("):
                self.skip()
            elif self.peek().word in ("FIRST", "AFTER"):
                break
            else:
                self.next()
        if t.counted == name:
            t.needed.discard(name) if not t.keys else None
        return name

    def drop(self) -> Affected:
        self.next()
        self.take("TEMPORARY")
        what = self.next().word
        if what not in ("TABLE", "VIEW"):
            while self.peek().kind != "end":
                self.next()
            return Affected(0)
        spared = self.take("IF", "EXISTS")
        while True:
            name = self.name().lower()
            kept = self.base.stored if what == "TABLE" else self.base.views
            if name not in kept and not spared:
                raise LookupError(f"no {what.lower()} {name}")
            t = kept.pop(name, None)
            if isinstance(t, Stored):
                path = self.base.spark._jvm.org.apache.hadoop.fs.Path(t.path)
                path.getFileSystem(self.base.spark._jsc.hadoopConfiguration()).delete(path, True)
            if not self.take(","):
                return Affected(0)

    def truncate(self) -> Affected:
        self.next()
        self.take("TABLE")
        t = self.stored()
        self.base.write(t, self.base.spark.createDataFrame([], t.schema))
        return Affected(0)

    def alter(self) -> Affected:
        self.next()
        self.need("TABLE")
        t = self.stored()
        rows = self.base.frame(t.name)
        changed = False
        while True:
            if self.take("ADD"):
                if self.peek().word in ("PRIMARY", "UNIQUE", "INDEX", "KEY", "FULLTEXT", "CONSTRAINT", "CHECK", "FOREIGN"):
                    if self.take("CONSTRAINT") and self.peek().word not in ("PRIMARY", "UNIQUE", "FOREIGN", "CHECK"):
                        self.name()
                    if self.take("CHECK"):
                        t.checks.append(self.bracket())
                        self.base.check(t, rows)
                    else:
                        key = self.peek().word in ("PRIMARY", "UNIQUE")
                        while not self.word("("):
                            self.next()
                        columns = self.names_in_brackets()
                        if key:
                            self.unique(t, columns)
                        self.to_comma()
                else:
                    self.take("COLUMN")
                    name = self.column_definition(t)
                    rows = rows.withColumn(name, F.expr(self.default(t, name)).cast(dict(t.columns)[name]))
                    if self.take("FIRST"):
                        t.columns.insert(0, t.columns.pop())
                    elif self.take("AFTER"):
                        after = self.name().lower()
                        t.columns.insert([n.lower() for n in t.names].index(after) + 1, t.columns.pop())
                    changed = True
            elif self.take("DROP"):
                self.take("COLUMN")
                name = self.name().lower()
                t.columns = [(n, k) for n, k in t.columns if n.lower() != name]
                t.keys = [k for k in t.keys if name not in {c.lower() for c in k}]
                t.needed = {n for n in t.needed if n.lower() != name}
                changed = True
            elif self.take("RENAME"):
                if self.take("COLUMN"):
                    old = self.name()
                    self.need("TO")
                    rows = self.renamed(t, rows, old, self.name())
                    changed = True
                else:
                    self.take("TO")
                    self.moved(t, self.name())
            elif self.peek().word in ("MODIFY", "CHANGE"):
                change = self.next().word == "CHANGE"
                self.take("COLUMN")
                old = self.name()
                if change:
                    rows = self.renamed(t, rows, old, self.peek().plain)
                at = [n.lower() for n in t.names].index((self.peek().plain if change else old).lower())
                if not change:
                    self.at -= 1
                name = self.column_definition(t)
                t.columns[at] = (t.columns[at][0], t.columns.pop()[1])
                changed = True
            else:
                raise Unsupported(f"ALTER TABLE ... {self.peek().text}")
            if not self.take(","):
                break
        if changed:
            self.base.check(t, rows)
            self.base.write(t, rows)
        return Affected(0)

    def renamed(self, t: Stored, rows: DataFrame, old: str, new: str) -> DataFrame:
        t.columns = [(new if n.lower() == old.lower() else n, k) for n, k in t.columns]
        t.keys = [[new if c.lower() == old.lower() else c for c in k] for k in t.keys]
        t.needed = {new if n.lower() == old.lower() else n for n in t.needed}
        t.checks = [c for c in t.checks if old.lower() not in c.lower()]
        return rows.withColumnRenamed(next(n for n in rows.columns if n.lower() == old.lower()), new)

    def moved(self, t: Stored, name: str) -> None:
        self.base.stored[name.lower()] = self.base.stored.pop(t.name.lower())
        t.name = name

    def rename(self) -> Affected:
        self.next()
        self.need("TABLE")
        while True:
            t = self.stored()
            self.need("TO")
            self.moved(t, self.name())
            if not self.take(","):
                return Affected(0)

    # --- what there is -------------------------------------------------------------------

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        return self.base.spark.createDataFrame(values, schema)

    def show(self) -> DataFrame:
        self.next()
        self.take("FULL")
        what = self.next().word
        if what == "TABLES":
            names = sorted({*self.base.stored, *self.base.given, *self.base.views})
            df = self.rows([(n,) for n in names], "table_name string")
            return df.where(F.call_function("ilike", "table_name", F.lit(string_of(self.next())))) if self.take("LIKE") else df
        if what in ("COLUMNS", "FIELDS"):
            self.next()
            return self.described(self.name())
        if what in ("INDEX", "INDEXES", "KEYS"):
            self.next()
            t = self.stored()
            keys = [(t.name, "PRIMARY" if i == 0 and set(k) <= t.needed else k[0], j + 1, c) for i, k in enumerate(t.keys) for j, c in enumerate(k)]
            return self.rows(keys, "table_name string, key_name string, seq_in_index int, column_name string")
        if what == "CREATE":
            self.need("TABLE")
            t = self.stored()
            parts = [f"  {name_of(n)} {k.simpleString().upper()}{' NOT NULL' if n in t.needed else ''}" for n, k in t.columns]
            parts += [f"  {'PRIMARY KEY' if i == 0 else 'UNIQUE KEY'} ({', '.join(map(name_of, k))})" for i, k in enumerate(t.keys)]
            return self.rows([(t.name, f"CREATE TABLE {name_of(t.name)} (\n" + ",\n".join(parts) + "\n)")], "table_name string, statement string")
        raise Unsupported(f"SHOW {what}")

    def described(self, name: str) -> DataFrame:
        t = self.base.stored.get(name.lower())
        fields = t.columns if t else [(f.name, f.dataType) for f in self.base.frame(name).schema.fields]
        keys = {c.lower(): "PRI" if i == 0 else "UNI" for i, k in reversed(list(enumerate(t.keys if t else []))) for c in k}
        rows = [
            (n, k.simpleString(), "NO" if t and n in t.needed else "YES", keys.get(n.lower(), ""), t.defaults.get(n.lower()) if t else None) for n, k in fields
        ]
        return self.rows(rows, "field string, type string, nullable string, key string, `default` string")

    def describe(self) -> DataFrame:
        self.next()
        if self.peek().word in ("SELECT", "WITH"):
            return self.plan()
        return self.described(self.name())

    def explain(self) -> DataFrame:
        self.next()
        while self.peek().word in ("ANALYZE", "EXTENDED", "FORMAT", "=", "TREE", "TRADITIONAL"):
            self.next()
        return self.plan()

    def plan(self) -> DataFrame:
        df = self.base.query(self.rest())
        text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.rows([(text,)], "plan string")

    def analyze(self) -> DataFrame:
        from larkspur.operators.dml import column_statistics

        self.next()
        self.need("TABLE")
        df = self.base.frame(self.name())
        return column_statistics(df, df.columns)

    def assign(self) -> Affected:
        self.next()
        while True:
            t = self.next()
            if t.kind != "variable" or t.text.startswith("@@"):
                return Affected(0)
            if not self.take("="):
                self.need(":=")
            e = self.expression()
            self.base.variables[t.text[1:]] = self.base.spark.sql(f"SELECT {e.sql}", args=self.base.variables or None).first()[0]
            if not self.take(","):
                return Affected(0)


def information_schema(base: Database) -> dict[str, DataFrame]:
    """Views ``tables``, ``columns`` and ``statistics`` over a database's own tables."""
    tables = [(n, "VIEW" if n in base.views else "BASE TABLE") for n in sorted({*base.stored, *base.given, *base.views})]
    columns = [
        (t, i + 1, n, k.simpleString())
        for t in sorted({*base.stored, *base.given})
        for i, (n, k) in enumerate(base.stored[t].columns if t in base.stored else [(f.name, f.dataType) for f in base.given[t].schema.fields])
    ]
    keys = [(t, i, j + 1, c) for t, s in sorted(base.stored.items()) for i, k in enumerate(s.keys) for j, c in enumerate(k)]
    make = base.spark.createDataFrame
    return {
        "tables": make(tables, "table_name string, table_type string"),
        "columns": make(columns, "table_name string, ordinal_position int, column_name string, data_type string"),
        "statistics": make(keys, "table_name string, key_number int, seq_in_index int, column_name string"),
    }

