"""Views that stay equal to their query while their sources change.

    engine = Engine(spark)
    engine.register("orders", df, key=["o_orderkey"])
    engine.create_view("by_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
    engine.apply("orders", inserts=new_rows)
    engine.read("by_status")

A change is a signed bag of rows. For every view on a changed source the signed change of its
rows is derived by substituting each occurrence of a changed relation in turn (occurrences
before it at their new state, those after it at their old), merged into the view's state, and
handed to the views above as its own signed change. Where a query is not linear in a changed
relation, its rows before and after are compared as bags instead: of an outer join by equal
columns those rows alone whose keys occur in the change, else all.

Rows of sources and of views without aggregates are a base and layers of changes, states of
aggregates likewise; a flush writes its own change. New tables are written whole before anything
points at them; a failed deferred view keeps its old state and is rebuilt by the next flush.
Tables that nothing has pointed at for KEPT changes are deleted, so rows that were read before
that many changes can't be evaluated any more.

Sums of DOUBLE columns are kept by adding and subtracting, so after deletes they can differ from
a recompute in the last digits; DECIMAL sums are exact.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import state as states
from .plans import aggregate, analyze, cross, decompose, nulls, sqltext
from .plans.analyze import Relation, ViewError
from .sources.changes import Bag, Delta, from_log, net, patched, signed, union
from .sources.storage import Store, path_of

TOPK = 16
#: Changes after which a replaced table is deleted.
KEPT = 2
_HISTORY = 64
_REGISTRY = "registry.json"


@dataclass
class Source:
    name: str
    bag: Bag
    key: list[str] | None = None
    track: bool = True
    pending: Delta = field(default_factory=Delta)
    batches: int = 0
    applied: set = field(default_factory=set)
    kept: list[set[str]] = field(default_factory=list)

    @property
    def data(self) -> DataFrame:
        return self.bag.rows()


@dataclass
class View:
    name: str
    sql: str
    kind: str  # aggregate, rows or reading
    depends_on: list[str]
    schema: object
    mode: str
    storage: str
    topk: int
    depth: int = 1
    key: list[str] | None = None
    plan: aggregate.Plan | None = None
    relations: list[Relation] = field(default_factory=list)
    counted: tuple[str, list[Relation]] | None = None  # its row query over groups of a cross join's sides
    children: list[str] = field(default_factory=list)  # sub-views it was decomposed into
    state: DataFrame | None = None
    layers: states.Layers = ()  # what an additive state is summed from
    bag: Bag | None = None  # the rows of a view without aggregates
    stale: bool = False  # to be rebuilt by the next flush
    kept: list[set[str]] = field(default_factory=list)
    flushes: int = 0
    last_rows: int | None = None
    last_ms: float | None = None
    last_error: str | None = None
    refreshed: float = field(default_factory=time.time)
    history: deque = field(default_factory=lambda: deque(maxlen=_HISTORY))
    lock: threading.RLock = field(default_factory=threading.RLock)


class Engine:
    def __init__(self, spark: SparkSession, folder: str | None = None, alter_source_policy: str = "warn"):
        self.spark, self.alter_source_policy = spark, alter_source_policy
        self.store = Store(spark, folder)
        self.sources: dict[str, Source] = {}
        self.views: dict[str, View] = {}
        self.warnings: list[str] = []
        self.statements: dict[str, dict] = {}
        self._saved: dict[str, dict] = {}
        self._joins: dict[str, list] = {}  # what join_equalities found, by statement
        self._lock = threading.RLock()  # one change at a time

    # sources

    def register(self, name: str, data: DataFrame, key: list[str] | None = None, track: bool = True) -> None:
        """A table that queries can name. key: columns that are unique, used to find deleted rows."""
        if name.lower() in self.views:
            raise ViewError(f"{name} is a view")
        self.sources[name.lower()] = Source(name, Bag(data, key), key, track)

    def compact(self, name: str) -> None:
        """Write a source's current rows, so that its plan does not grow with each change, or make a view's layers one."""
        if name.lower() in self.views:
            view = self._view(name)
            with view.lock:
                if len(view.layers) > 1:
                    view.state = self.store.write(view.name, view.state)
                    view.layers = states.base(view.state)
                elif view.bag and view.bag.layers:
                    view.bag = Bag(self.store.write(view.name, view.bag.rows()), view.key)
                self._written(view)
            return
        source = self._source(name)
        source.bag = Bag(self.store.write(f"sources/{source.name}", source.data), source.key)
        self._written(source)

    def _written(self, owner: Source | View) -> None:
        """Note which tables an owner stands on, and delete those that it has not stood on for a while."""
        frames = owner.bag.frames() if owner.bag else [owner.state, *[x for _, x in owner.layers]]
        now = {p for p in map(path_of, frames) if p} | self.store.new.pop(owner.name if isinstance(owner, View) else f"sources/{owner.name}", set())
        if not owner.kept or owner.kept[-1] != now:
            owner.kept.append(now)
        while len(owner.kept) > KEPT + 1:
            for path in owner.kept.pop(0) - set().union(*owner.kept):
                self.store.delete(path)

    def drop_source(self, name: str) -> list[str]:
        """Drop a source and, with it, every view that depends on it."""
        self._source(name)
        gone = []
        for view in sorted(self.views.values(), key=lambda v: -v.depth):
            if view.name.lower() in self.views and name.lower() in self._below(view):
                self._forget(view)
                gone.append(view.name)
        del self.sources[name.lower()]
        return gone

    def _source(self, name: str) -> Source:
        if name.lower() not in self.sources:
            raise ViewError(f"no source {name!r}")
        return self.sources[name.lower()]

    def _view(self, name: str) -> View:
        if name.lower() not in self.views:
            raise ViewError(f"no view {name!r}")
        return self.views[name.lower()]

    def _below(self, view: View) -> set[str]:
        out = set(view.depends_on)
        for name in view.depends_on:
            if name in self.views:
                out |= self._below(self.views[name])
        return out

    # evaluation

    def _current(self, name: str) -> DataFrame:
        return self.sources[name].data if name in self.sources else self.read(name)

    def _evaluate(self, sql: str, relations: list[Relation], frames: list[DataFrame]) -> DataFrame:
        """Run SQL with each of its table references replaced, at its place in the text."""
        views, text, parts = [], sql, []
        for r, frame in zip(relations, frames, strict=True):
            name = f"__r_{uuid.uuid4().hex}"
            frame.createOrReplaceTempView(name)
            views.append(name)
            parts.append((r.start, r.stop, name if r.aliased else f"{name} AS `{r.name.split('.')[-1]}`"))
        try:
            return self.spark.sql(nulls.split(self.spark, aggregate.replace_all(text, parts)))
        finally:
            for name in views:
                self.spark.catalog.dropTempView(name)

    def _rows(self, view: View, frames: list[DataFrame]) -> DataFrame:
        """A view's rows, or groups of equal ones with their numbers."""
        return self._evaluate(*(view.counted or (view.sql, view.relations)), frames)

    def _counted(self, view: View) -> tuple[str, list[Relation]] | None:
        text = cross.counted(view.sql, lambda piece: self._schema(f"SELECT * FROM {piece}", analyze.relations(self.spark, f"SELECT * FROM {piece}")).names)
        if text is None:
            return None
        found = self._known(analyze.relations(self.spark, text))
        kinds = self._schema(text, found)
        # products of decimals keep six places
        if any(kinds[c].dataType.typeName() == "decimal" and kinds[c].dataType.scale > 6 for c in view.plan.sums):
            return None
        return text, found

    def _known(self, relations: list[Relation]) -> list[Relation]:
        return [r for r in relations if r.name.lower() in self.sources or r.name.lower() in self.views]

    def query(self, sql: str) -> DataFrame:
        """A plain query over sources and views, evaluated afresh."""
        found = self._known(analyze.relations(self.spark, sql))
        return self._evaluate(sql, found, [self._current(r.name.lower()) for r in found])

    def read(self, name: str) -> DataFrame:
        view = self._view(name)
        if view.kind == "reading":
            return self._evaluate(view.sql, view.relations, [self._current(r.name.lower()) for r in view.relations])
        return view.bag.rows() if view.kind == "rows" else states.read(view.plan, view.state, view.schema)

    # creation

    def create_view(self, name: str, sql: str, unique_columns: list[str] | None = None, storage: str = "UNLOGGED", mode: str = "IMMEDIATE", topk: int = TOPK, if_not_exists: bool = False) -> str:
        """Create and fill a view. topk: values kept per group for MIN and MAX; 0 keeps one and rebuilds more often."""
        analyze.check_name(name)
        if storage.upper() not in ("LOGGED", "UNLOGGED"):
            raise ViewError(f"invalid storage {storage!r}: LOGGED or UNLOGGED")
        if mode.upper() not in ("IMMEDIATE", "DEFERRED"):
            raise ViewError(f"invalid mode {mode!r}: IMMEDIATE or DEFERRED")
        if name.lower() in self.views:
            if if_not_exists:
                return "ALREADY EXISTS (skipped)"
            raise ViewError(f"view {name!r} already exists")
        sql = sqltext.without_comments(sql)
        try:
            self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql if not sqltext.blanked(sql).lower().startswith("select distinct on") else "SELECT 1")
        except Exception as e:
            analyze.reject(sql)
            raise ViewError(f"parse error: {str(e).splitlines()[0]}") from None
        analyze.reject(sql)
        made: list[str] = []
        with self._lock:
            try:
                self._create(name, sql, unique_columns, storage.upper(), mode.upper(), max(topk, 1), made)
            except Exception:
                for x in reversed(made):
                    self._forget(self.views[x.lower()])
                raise
            self.statements[name.lower()] = {"name": name, "sql": sql, "unique_columns": unique_columns, "storage": storage, "mode": mode, "topk": topk}
            self._save()
        return f"CREATED {name}"

    def _save(self) -> None:
        """In a folder of the user's, write down the statements, and which tables LOGGED views stand on."""
        if not self.store.durable:
            return
        frame = lambda df: path_of(df) if df is not None else None
        tables = {}
        for key, view in self.views.items():
            waits = view.stale or any(self.sources[n].pending for n in self._below(view) if n in self.sources)
            if view.storage == "LOGGED" and view.kind != "reading" and not waits:
                if view.bag:
                    tables[key] = {"base": frame(view.bag.base), "layers": [[level, frame(d.minus), frame(d.plus)] for level, d in view.bag.layers]}
                else:
                    tables[key] = {"state": frame(view.state), "layers": [[level, frame(x)] for level, x in view.layers]}
        self.store.save_json(_REGISTRY, {"statements": list(self.statements.values()), "tables": tables})

    def restore(self) -> list[str]:
        """Create the views that were written down in this folder again, once the sources are registered.

        LOGGED views stand on their tables as they were; others, and those with changes that were queued, are filled afresh.
        """
        saved = self.store.load_json(_REGISTRY)
        if saved is None:
            return []
        with self._lock:
            self._saved = saved["tables"]
            try:
                for statement in saved["statements"]:
                    self.create_view(**statement)
            finally:
                self._saved = {}
            self._save()
        return [x["name"] for x in saved["statements"]]

    def _loaded(self, view: View) -> bool:
        known = self._saved.get(view.name.lower())
        if known is None or view.storage != "LOGGED":
            return False
        read = lambda path: self.store.read(path) if path else None
        if view.kind == "rows":
            view.bag = Bag(read(known["base"]), view.key, tuple((level, Delta(read(a), read(b))) for level, a, b in known["layers"]))
        else:
            view.layers = tuple((level, read(path)) for level, path in known["layers"])
            view.state = states.stacked(view.plan, view.layers) if len(view.layers) > 1 else read(known["state"])
        self._written(view)
        return True

    def _create(self, name, sql, unique, storage, mode, topk, made) -> View:
        make = lambda suffix, text: self._create(f"{name}__{suffix}", text, None, storage, mode, topk, made)
        if parts := decompose.with_clause(sql):
            ctes, body = parts
            children, names = [], {}
            for alias, text in ctes:
                decompose.check_alias(alias)
                child = make(f"cte_{alias}", self._renamed(text, names))
                names[alias.lower()] = child.name
                children.append(child.name)
            view = self._create(name, self._renamed(body, names), unique, storage, mode, topk, made)
            view.children += children
            return view
        if parts := decompose.set_operation(sql):
            operands, operators = parts
            children = [make(f"union_{i}", text) for i, text in enumerate(operands)]
            text = f"SELECT * FROM `{children[0].name}`"
            for operator, child in zip(operators, children[1:], strict=True):
                text = f"{text} {operator} SELECT * FROM `{child.name}`"
            return self._reading(name, text, storage, mode, topk, [c.name for c in children], made)
        select = sqltext.select_of(sql)
        names = self._names(sql, select)
        for decomposed in (decompose.distinct_on(select, names), decompose.windows(select, names, lambda e: analyze.columns_of(self.spark, e))):
            if decomposed:
                base, over = decomposed
                child = make("base", base)
                return self._reading(name, over.replace("{base}", f"`{child.name}`"), storage, mode, topk, [child.name], made)
        if decomposed := decompose.distinct_groups(select, names):
            base, over = decomposed
            child = make("base", base)
            view = self._create(name, over.replace("{base}", f"`{child.name}`"), unique, storage, mode, topk, made)
            view.children.append(child.name)
            return view
        found = analyze.relations(self.spark, sql)
        if any(self._grouped_subquery(i) for i in [select.source]):
            raise ViewError("a FROM subquery with GROUP BY is not supported; use a CTE")
        schema = self._schema(sql, found)
        plan = aggregate.plan(select, names)
        text = plan.row_sql if plan else sql
        view = View(name, text, "aggregate" if plan else "rows", [], schema, mode, storage, topk, plan=plan, relations=self._known(analyze.relations(self.spark, text)))
        self._place(view)
        view.counted = self._counted(view) if plan else None
        if unique and (missing := [c for c in unique if c not in schema.names]):
            raise ViewError(f"unique_columns {missing} are not in the view")
        view.key = unique or self._inherited_key(view, schema)
        self._fill(view)
        self._add(view, made)
        return view

    def _reading(self, name, sql, storage, mode, topk, children, made) -> View:
        found = self._known(analyze.relations(self.spark, sql))
        view = View(name, sql, "reading", [], self._schema(sql, found), mode, storage, topk, relations=found, children=children)
        self._place(view)
        self._add(view, made)
        return view

    def _add(self, view: View, made: list[str]) -> None:
        self.views[view.name.lower()] = view
        made.append(view.name)

    def _place(self, view: View) -> None:
        view.depends_on = sorted({r.name.lower() for r in view.relations})
        if view.name.lower() in view.depends_on or any(view.name.lower() in self._below(self.views[d]) for d in view.depends_on if d in self.views):
            raise ViewError(f"view {view.name!r} would depend on itself")
        for name in view.depends_on:
            if name in self.sources and not self.sources[name].track:
                self.warnings.append(f"{name} is static: call refresh_depending_on({name!r}) after it changes")
        view.depth = 1 + max((self.views[d].depth for d in view.depends_on if d in self.views), default=0)

    @staticmethod
    def _grouped_subquery(source: str) -> bool:
        import re

        blank = sqltext.blanked(source)
        depth = sqltext.depths(blank)
        return any(depth[m.start()] > 0 for m in re.finditer(r"\bgroup\s+by\b", blank, re.I))

    def _renamed(self, sql: str, names: dict[str, str]) -> str:
        if not names:
            return sql
        parts = []
        for r in analyze.relations(self.spark, self._parseable(sql)):
            if r.name.lower() in names:
                new = f"`{names[r.name.lower()]}`"
                parts.append((r.start, r.stop, new if r.aliased else f"{new} AS `{r.name}`"))
        return aggregate.replace_all(sql, parts)

    @staticmethod
    def _parseable(sql: str) -> str:
        """DISTINCT ON blanked out, at the same length."""
        import re

        blank = sqltext.blanked(sql)
        for m in re.finditer(r"\bdistinct\s+on\s*\(", blank, re.I):
            end = sqltext.closing(blank, m.end() - 1) + 1
            sql = sql[: m.start()] + " " * (end - m.start()) + sql[end:]
        return sql

    def _schema(self, sql: str, found: list[Relation]):
        known = self._known(found)
        return self._evaluate(sql, known, [self._empty(r.name.lower()) for r in known]).schema

    def _empty(self, name: str) -> DataFrame:
        schema = self.sources[name].data.schema if name in self.sources else self.views[name].schema
        return self.spark.createDataFrame([], schema)

    def _names(self, sql: str, select: sqltext.Select) -> list[str]:
        text = self._parseable(sql)
        names = self._schema(text, analyze.relations(self.spark, text)).names
        if len(set(map(str.lower, names))) != len(names):
            raise ViewError("output columns need distinct names")
        return names

    def _inherited_key(self, view: View, schema) -> list[str] | None:
        if view.kind == "rows" and len(view.relations) > 1:
            return self._joined_key(view, schema)
        if view.kind != "rows" or len(view.relations) != 1 or not view.relations[0].linear:
            return None
        source = self.sources.get(view.relations[0].name.lower())
        plain = {sqltext.normal(sqltext.alias_of(i)[0].split(".")[-1]): n for i, n in zip(sqltext.select_of(view.sql).items, schema.names)} if not sqltext.select_of(view.sql).items[0].endswith("*") else {n.lower(): n for n in schema.names}
        if source and source.key and all(k.lower() in plain for k in source.key):
            return [plain[k.lower()] for k in source.key]
        return None

    def _joined_key(self, view: View, schema) -> list[str] | None:
        """The key of a relation whose rows meet one row of each other at most: all are joined by their whole keys, one after the other."""
        aliases = [r.alias for r in view.relations]
        joins = analyze.join_equalities(self.spark, view.sql)
        found = analyze.relations(self.spark, view.sql)
        if len(set(aliases)) < len(aliases) or len(found) > len(aliases) or any(kind not in ("Inner", "LeftOuter") for kind, _ in joins):
            return None
        keys = {r.alias: [k.lower() for k in self.sources[r.name.lower()].key or ()] if r.name.lower() in self.sources else [] for r in view.relations}
        equal = [x for _, x in joins if x] + [x[::-1] for _, x in joins if x]
        names = {sqltext.normal(sqltext.alias_of(i)[0]): n for i, n in zip(sqltext.select_of(view.sql).items, schema.names)}
        for r in view.relations:
            own = [names.get(f"{r.alias}.{k}") for k in keys[r.alias]]
            reached = {r.alias}
            while more := {a for a in keys if a not in reached and keys[a] and all(any(x == (a, k) and y[0] in reached for x, y in equal) for k in keys[a])}:
                reached |= more
            if r.linear and own and all(own) and len(reached) == len(aliases):
                return own
        return None

    def _fill(self, view: View) -> None:
        if view.kind == "reading" or self._loaded(view):
            return
        rows = self._rows(view, [self._current(r.name.lower()) for r in view.relations])
        if view.plan:
            view.state = self.store.write(view.name, states.build(view.plan, rows, view.topk))
            view.layers = states.base(view.state) if not view.plan.heaps else ()
        else:
            view.bag = Bag(self.store.write(view.name, rows), view.key)
        view.stale, view.last_error = False, None
        view.refreshed = time.time()
        self._written(view)

    # changes

    def apply(self, source: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, updates: tuple[DataFrame, DataFrame] | None = None) -> None:
        """Change a source. updates: (old rows, new rows). Deferred views see it at the next flush."""
        own = self._source(source)
        for frame in (inserts, deletes, *(updates or ())):
            if frame is not None:
                self._check_schema(own, frame)
        fields = own.data.schema.fields
        pick = lambda x: x.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields]) if x is not None else None
        delta = Delta(pick(deletes), pick(inserts))
        if updates:
            delta = delta.then(Delta(pick(updates[0]), pick(updates[1])))
        self.change({source.lower(): delta})

    def truncate(self, source: str) -> None:
        self.change({source.lower(): Delta(minus=self._source(source).data)})

    def apply_log(self, source: str, log: DataFrame, batch_id: object = None) -> bool:
        """Apply an op-coded change log; a batch id that was applied before is skipped, so replays are harmless."""
        own = self._source(source)
        if batch_id is not None and batch_id in own.applied:
            return False
        self.change({source.lower(): net(from_log(log))})
        if batch_id is not None:
            own.applied.add(batch_id)
        return True

    def _stored_rows(self, source: Source, delta: Delta) -> Delta:
        """With a key, the rows that leave are those stored under the given keys, whatever else the given rows say."""
        if not source.key or delta.minus is None:
            return delta
        keys = self.store.write("keys", delta.minus.select(*[F.col(k).alias(f"__gone_{k}") for k in source.key]).distinct())
        same = [F.col(k).eqNullSafe(F.col(f"__gone_{k}")) for k in source.key]
        found = self.store.write("gone", source.data.join(keys, same, "left_semi"))
        wanted = keys.count()
        self.store.delete(path_of(keys))
        if found.count() < wanted:
            raise ViewError(f"a change deletes rows of {source.name} that are not there")
        return Delta(found, delta.plus)

    def _check_schema(self, source: Source, frame: DataFrame) -> None:
        """Under 'warn' new columns are left out and other types are cast; a missing column, or any change under 'error', is refused."""
        have, want = {f.name: f.dataType for f in frame.schema}, {f.name: f.dataType for f in source.data.schema}
        if have != want:
            message = f"the columns of {source.name} have changed: rebuild the views on it"
            if self.alter_source_policy == "error" or set(want) - set(have):
                raise ViewError(message)
            self.warnings.append(message)

    def change(self, deltas: dict[str, Delta]) -> None:
        """Change several sources at once."""
        with self._lock:
            self._change(deltas)
            self._save()

    def _change(self, deltas: dict[str, Delta]) -> None:
        written = {}
        for n, d in deltas.items():
            source = self.sources[n]
            bag, d = source.bag.changed(self._stored_rows(source, d), lambda df, s=source: self.store.write(f"sources/{s.name}", df))
            if not self._nothing(d):
                written[n] = bag, d
        if not written:
            return
        deltas = {n: d for n, (_, d) in written.items()}
        old = {n: self.sources[n].data for n in deltas}
        queued = {v.name.lower() for v in self.views.values() if v.mode == "DEFERRED"}
        # views above a deferred one wait with it
        for v in sorted(self.views.values(), key=lambda v: v.depth):
            if any(d in queued for d in v.depends_on):
                queued.add(v.name.lower())
        before = {n: (self.sources[n].bag, self.sources[n].pending) for n in deltas}
        for n, d in deltas.items():
            source = self.sources[n]
            source.bag = written[n][0]
            source.batches += 1
            if queued and any(n in self._below(self.views[v]) for v in queued):
                source.pending = source.pending.then(d)
        try:
            self._propagate(deltas, old, lambda v: v.name.lower() not in queued, isolate=False)
        except Exception:  # all or nothing
            for n, (bag, pending) in before.items():
                self.sources[n].bag, self.sources[n].pending = bag, pending
            raise
        for n in deltas:
            # queued changes are read until they are flushed
            if not self.sources[n].pending:
                self._written(self.sources[n])

    @staticmethod
    def _nothing(delta: Delta) -> bool:
        return all(x is None or x.isEmpty() for x in (delta.minus, delta.plus))

    def flush(self, source: str | None = None) -> str:
        """Bring deferred views up to date with what was queued, as one net change. A view that fails keeps its state and its error."""
        with self._lock:
            out = self._flush(source)
            self._save()
        return out

    def _flush(self, source: str | None) -> str:
        if source is not None:
            self._source(source)
        waiting = {v.name.lower() for v in self.views.values() if v.mode == "DEFERRED"}
        if not waiting:
            return "NO DEFERRED VIEWS"
        names = [n for n, s in self.sources.items() if s.pending and (source is None or n == source.lower())]
        deltas = {n: net(self.sources[n].pending) for n in names}
        # what is not flushed now stays at its state before
        others = {n: s.pending for n, s in self.sources.items() if s.pending and n not in names}
        back = lambda n, d: patched(self.sources[n].data, Delta(d.plus, d.minus), self.sources[n].key)
        if not deltas:
            return f"FLUSHED {self._rebuilt({n: back(n, d) for n, d in others.items()})} VIEWS"
        now = {n: s.bag for n, s in self.sources.items()}
        old = {n: back(n, d) for n, d in deltas.items()}
        held = {n: back(n, d) for n, d in others.items()}
        for v in sorted(self.views.values(), key=lambda v: v.depth):
            if any(d in waiting for d in v.depends_on):
                waiting.add(v.name.lower())
        for n, frame in held.items():
            self.sources[n].bag = Bag(frame, self.sources[n].key)
        try:
            late = self._rebuilt(old)
            done = self._propagate(deltas, old, lambda v: v.name.lower() in waiting, isolate=True)
        finally:
            for n in held:
                self.sources[n].bag = now[n]
        for n in names:
            self.sources[n].pending = Delta()
        return f"FLUSHED {done + late} VIEWS"

    def _rebuilt(self, old: dict[str, DataFrame]) -> int:
        """Rebuild views that failed before, at the sources' state before what is flushed now; their number."""
        stale = [v for v in sorted(self.views.values(), key=lambda v: v.depth) if v.stale]
        bags = {n: self.sources[n].bag for n in old}
        for n, frame in old.items():
            self.sources[n].bag = Bag(frame, self.sources[n].key)
        done = 0
        try:
            for view in stale:
                try:
                    self._fill(view)
                    done += 1
                except Exception as e:
                    view.stale, view.last_error = True, str(e).splitlines()[0]
                    self.warnings.append(f"{view.name}: {view.last_error}")
        finally:
            for n, bag in bags.items():
                self.sources[n].bag = bag
        return done

    def _propagate(self, deltas: dict[str, Delta], old: dict[str, DataFrame], wanted: Callable[[View], bool], isolate: bool) -> int:
        """One pass over the views in order of depth; each finds all its relations' changes and old states."""
        base, deltas, old, done = set(deltas), dict(deltas), dict(old), 0
        previous: list[tuple] = []
        afresh: set[str] = set()
        for view in sorted(self.views.values(), key=lambda v: v.depth):
            if any(d in self.views and self.views[d].stale for d in view.depends_on):
                view.stale = True  # rebuilt after what it stands on
            if view.stale or not wanted(view):
                continue
            # what it stands on has changed before this pass, or can't say what it was: its rows are evaluated anew
            if any(d in afresh or d in self.views and not wanted(self.views[d]) and base & self._below(self.views[d]) for d in view.depends_on):
                afresh.add(view.name.lower())
            if view.name.lower() not in afresh and not any(d in deltas for d in view.depends_on):
                continue
            with view.lock:
                began = time.time()
                previous.append((view, view.state, view.layers, view.bag))
                try:
                    if view.name.lower() in afresh:
                        before = self.read(view.name) if view.kind != "reading" else None
                        self._fill(view)
                        emitted = None
                        if before is not None and self._needed(view):
                            after = self.read(view.name)
                            emitted = Delta(before.exceptAll(after), after.exceptAll(before))
                            afresh.discard(view.name.lower())
                    else:
                        before = self._read_at(view, old) if self._needed(view) else None
                        emitted = self._refresh(view, deltas, old, before)
                    view.last_error = None
                except Exception as e:
                    view.last_error = str(e).splitlines()[0]
                    if not isolate:
                        for v, state, layers, bag in previous:
                            v.state, v.layers, v.bag = state, layers, bag
                        raise
                    _, view.state, view.layers, view.bag = previous.pop()
                    view.stale = True
                    self.warnings.append(f"{view.name}: {view.last_error}")
                    continue
                done += 1
                view.flushes += 1
                view.last_ms = (time.time() - began) * 1000
                view.history.append(view.last_ms)
                view.refreshed = time.time()
                if emitted:
                    deltas[view.name.lower()], old[view.name.lower()] = emitted, before
        for view, *_ in previous:
            if view.kind != "reading":
                self._written(view)
        return done

    def _read_at(self, view: View, old: dict[str, DataFrame]) -> DataFrame:
        """A view as it was before this pass."""
        if view.kind != "reading":
            return view.bag.rows() if view.kind == "rows" else states.read(view.plan, view.state, view.schema)
        frames = [old.get(r.name.lower()) for r in view.relations]
        return self._evaluate(view.sql, view.relations, [self._current(r.name.lower()) if f is None else f for r, f in zip(view.relations, frames, strict=True)])

    def _needed(self, view: View) -> bool:
        return any(view.name.lower() in v.depends_on for v in self.views.values())

    def _refresh(self, view: View, deltas: dict[str, Delta], old: dict[str, DataFrame], before: DataFrame) -> Delta:
        """Bring one view's state up to date; returns its own signed change if a view above needs it."""
        if view.kind == "reading":
            if not self._needed(view):
                return Delta()
            after = self.read(view.name)
            return Delta(before.exceptAll(after), after.exceptAll(before))
        change = self.delta_of(view, deltas, old)
        if not change:
            return Delta()
        keep = lambda df: self.store.write(view.name, df)
        if view.kind == "rows":
            bag, written = view.bag.changed(change, keep)
            view.last_rows = sum(x.count() for x in (written.minus, written.plus) if x is not None)
            if not view.last_rows:
                return Delta()
            view.bag = bag
            return net(written) if self._needed(view) else Delta()
        if view.layers:
            previous = view.layers
            view.layers, touched, view.last_rows = states.append(view.plan, previous, change, keep)
            if not view.last_rows:
                return Delta()
            view.state = view.layers[0][1] if len(view.layers) == 1 else states.stacked(view.plan, view.layers)
            if not self._needed(view):
                return Delta()
            was, is_ = (states.read_layers(view.plan, x, view.schema, touched) for x in (previous, view.layers))
            return Delta(was.exceptAll(is_), is_.exceptAll(was))
        now = lambda: self._rows(view, [self._current(r.name.lower()) for r in view.relations])
        previous = view.state
        view.state, touched = states.merge(view.plan, view.state, change, view.topk, now, keep)
        if not self._needed(view):
            return Delta()
        was, is_ = (states.read(view.plan, s, view.schema, touched) for s in (previous, view.state))
        return Delta(was.exceptAll(is_), is_.exceptAll(was))

    def delta_of(self, view: View, deltas: dict[str, Delta], old: dict[str, DataFrame]) -> Delta:
        """The signed change of a view's rows, by telescoping over the occurrences of what changed."""
        changed = [i for i, r in enumerate(view.relations) if r.name.lower() in deltas]
        frame = lambda i, is_new: self._current(view.relations[i].name.lower()) if is_new or i not in changed else old[view.relations[i].name.lower()]
        if not all(view.relations[i].linear for i in changed):
            near = self._near(view, changed, deltas)
            was, is_ = (self._rows(view, [near(i, frame(i, is_new)) for i in range(len(view.relations))]) for is_new in (False, True))
            return self._compared(view, was, is_)
        out = Delta()
        for i in changed:
            for side in ("minus", "plus"):
                part = getattr(deltas[view.relations[i].name.lower()], side)
                if part is None:
                    continue
                rows = self._rows(view, [part if j == i else frame(j, j < i) for j in range(len(view.relations))])
                setattr(out, side, union(getattr(out, side), rows))
        return net(out) if len(changed) > 1 else out

    def _compared(self, view: View, was: DataFrame, is_: DataFrame) -> Delta:
        """What two bags of a view's rows differ by. Each is evaluated once: with signs for sums, otherwise written after equal rows have cancelled."""
        if view.layers and self._exact(view.plan, is_):  # sums take the signs themselves
            times = lambda rows, sign: rows.withColumn(cross.TIMES, F.col(cross.TIMES) * sign if cross.TIMES in rows.columns else F.lit(sign).cast("bigint"))
            return Delta(plus=times(was, -1).unionByName(times(is_, 1)))
        return self.store.write_signed(view.name, signed(was, is_))

    @staticmethod
    def _exact(plan: aggregate.Plan, rows: DataFrame) -> bool:
        """Whether what enters and leaves a sum cancels to the last digit; products of decimals keep six places."""
        kinds = {c: rows.schema[c].dataType for c in plan.sums}
        return all(t.typeName() not in ("double", "float", "string") and (t.typeName() != "decimal" or t.scale <= 6) for t in kinds.values())

    def _near(self, view: View, changed: list[int], deltas: dict[str, Delta]) -> Callable[[int, DataFrame], DataFrame]:
        """What of a relation's rows a comparison has to see: all, or where one relation changed that is joined outer
        by equal columns, those rows of both relations alone whose keys occur in the change."""
        aliases = [r.alias for r in view.relations]
        if len(changed) != 1 or len(set(aliases)) < len(aliases):
            return lambda i, rows: rows
        own, delta = aliases[changed[0]], deltas[view.relations[changed[0]].name.lower()]
        # a change of one side of such a join is seen in rows of the same key alone
        if view.sql not in self._joins:
            self._joins[view.sql] = analyze.join_equalities(self.spark, view.sql)
        for sides in (x for kind, x in self._joins[view.sql] if x and "Outer" in kind):
            for (alias, column), (other, key) in (sides, sides[::-1]):
                if alias == own and other in aliases and other != own:
                    keys = union(*[x.select(F.col(f"`{column}`").alias("__key")) if x is not None else None for x in (delta.minus, delta.plus)]).distinct()
                    by = {changed[0]: column, aliases.index(other): key}
                    return lambda i, rows: rows.join(keys, rows[by[i]].eqNullSafe(keys["__key"]), "left_semi") if i in by else rows
        return lambda i, rows: rows

    # lifecycle

    def drop_view(self, name: str, cascade: bool = False) -> str:
        view = self._view(name)
        above = [v.name for v in self.views.values() if name.lower() in v.depends_on]
        if above and not cascade:
            raise ViewError(f"view {name!r} has dependent views: {', '.join(above)}")
        for child in above:
            if child.lower() in self.views:
                self.drop_view(child, cascade=True)
        self._forget(view)
        self.statements.pop(name.lower(), None)
        for child in reversed(view.children):
            if child.lower() in self.views and not any(child.lower() in v.depends_on for v in self.views.values()):
                self.drop_view(child, cascade=True)
        self._save()
        return f"DROPPED {name}"

    def _forget(self, view: View) -> None:
        self.views.pop(view.name.lower(), None)
        for path in set().union(*view.kept):
            self.store.delete(path)

    def reconcile(self, name: str) -> str:
        """Rebuild a view with the sub-views it stands on from the sources, and the views above it in order of depth."""
        view = self._view(name)
        with self._lock:
            self._settle(view.name.lower())
            below = {name.lower()}
            while more := {c.lower() for n in below if n in self.views for c in self.views[n].children} - below:
                below |= more
            for v in sorted(self.views.values(), key=lambda v: v.depth):
                if v.name.lower() in below or below & self._below(v):
                    with v.lock:
                        self._fill(v)
            self._save()
        return "RECONCILED"

    def _settle(self, name: str) -> None:
        """Flush what is queued below a view or source, so that a rebuild does not count it twice."""
        if any(s.pending and (n == name or name in self.views and n in self._below(self.views[name])) for n, s in self.sources.items()):
            self._flush(None)

    def refresh_depending_on(self, source: str, data: DataFrame | None = None) -> str:
        """Rebuild every view on a source, in order of depth; data replaces a static source's rows."""
        with self._lock:
            self._settle(source.lower())
            if data is not None:
                self._source(source).bag = Bag(data, self._source(source).key)
            views = sorted((v for v in self.views.values() if source.lower() in self._below(v)), key=lambda v: v.depth)
            for view in views:
                self._fill(view)
            self._save()
        return f"REFRESHED {len(views)} VIEWS"

    def scheduled_reconcile(self, max_age_minutes: float = 60) -> DataFrame:
        rows = []
        for view in sorted(self.views.values(), key=lambda v: v.depth):
            if time.time() - view.refreshed >= max_age_minutes * 60 and view.kind != "reading":
                began = time.time()
                try:
                    self.reconcile(view.name)
                    status = "RECONCILED"
                except Exception as e:
                    status = f"ERROR: {str(e).splitlines()[0]}"
                rows.append((view.name, status, (time.time() - began) * 1000))
        return self.spark.createDataFrame(rows, "name string, status string, ms double")
