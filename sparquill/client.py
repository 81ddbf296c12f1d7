"""The client: a delegate for each model, with the operations on it."""

from __future__ import annotations

import copy
import re
import time
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import QueryValidationError, RecordNotFoundError
from .operators import aggregate
from .operators.read import Reader
from .operators.write import Writer
from .schema import Schema, load
from .schema.document import Model
from .schema.relations import inverse, resolve
from .sources import Snapshots, open_source

#: Operations by the names that arguments and hooks use.
OPERATIONS = tuple("findMany findFirst findFirstOrThrow findUnique findUniqueOrThrow create createMany createManyAndReturn update updateMany upsert delete deleteMany count aggregate groupBy".split())


def _snake(name: str) -> str:
    return re.sub(r"[A-Z]", lambda m: "_" + m[0].lower(), name)


def _plan_of(out: Any) -> Callable[[], str] | None:
    """The plan's text, made when it is asked for."""
    return (lambda: out._jdf.queryExecution().toString()) if isinstance(out, DataFrame) else None


class Client:
    """Queries over the tables of a schema.

    source: a URL (see open_source), a function from table names to DataFrames, or a
    mapping of them. `client.order` or `client["Order"]` is the delegate of model Order.
    """

    def __init__(self, spark: SparkSession, schema: Schema | str, source: str | Callable[[str], DataFrame] | Mapping[str, DataFrame], **options: str):
        self.spark = spark
        self.schema = load(schema) if isinstance(schema, str) else schema
        self.source = Snapshots(spark, self.schema, open_source(spark, source, **options) if isinstance(source, str) else source)
        self.reader, self.writer = Reader(self.source), Writer(self.source)
        self._middleware: list[Callable] = []
        self._extensions: list[Mapping[str, Any]] = []
        self._listeners: list[Callable] = []

    def __getitem__(self, name: str) -> Delegate:
        model = self.schema.model(name)
        if model is None:
            raise KeyError(name)
        return Delegate(self, model)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_") or "schema" not in self.__dict__:
            raise AttributeError(name)
        for ext in reversed(self._extensions):
            if name in ext.get("client", {}):
                member = ext["client"][name]
                return (lambda *a, **k: member(self, *a, **k)) if callable(member) else member
        model = self.schema.model(name[:1].upper() + name[1:]) or self.schema.model(name)
        if model is None:
            raise AttributeError(name)
        return Delegate(self, model)

    # -- extension ----------------------------------------------------------

    def use(self, middleware: Callable[[dict, Callable], Any]) -> None:
        """Add middleware(params, next); the last added is outermost."""
        self._middleware.append(middleware)

    def extend(self, **extension: Mapping[str, Any]) -> Client:
        """A client with result, model, query or client extensions; this one stays as it is."""
        unknown = set(extension) - {"result", "model", "query", "client"}
        if unknown:
            raise QueryValidationError(f"unknown extension {sorted(unknown)}")
        out = copy.copy(self)
        out._extensions = [*self._extensions, extension]
        out._middleware = list(self._middleware)
        return out

    def on(self, event: str, listener: Callable[[dict], None]) -> None:
        """Call listener({model, action, seconds, plan}) after each operation (event: query); plan() gives the text of a read's plan."""
        if event != "query":
            raise QueryValidationError(f"unknown event {event}")
        self._listeners.append(listener)

    # -- raw ----------------------------------------------------------------

    def query_raw(self, sql: str | list[str] | tuple[str, ...], *params: Any) -> DataFrame:
        """Spark SQL over the models' tables by their names, with ? parameters.

        Also takes the parts of a template, with a parameter between each two of them.
        The tables that the text names are views while it is analysed; views of the same
        names are there again afterwards.
        """
        if not isinstance(sql, str):
            if len(params) != len(sql) - 1:
                raise QueryValidationError(f"{len(sql)} parts take {len(sql) - 1} values, not {len(params)}")
            sql = "?".join(sql)
        before: dict[str, DataFrame | None] = {}
        try:
            for m in self.schema.models:
                if re.search(rf"\b{re.escape(m.db_name)}\b", sql, re.I):
                    held = any(t.isTemporary and t.name == m.db_name.lower() for t in self.spark.catalog.listTables(pattern=m.db_name.lower()))
                    before[m.db_name] = self.spark.table(m.db_name) if held else None
                    self.source.frame(m).select(*(F.col(f"`{f.name}`").alias(f.db_name) for f in m.scalars)).createOrReplaceTempView(m.db_name)
            return self.spark.sql(sql, args=list(params)) if params else self.spark.sql(sql)
        finally:
            for name, view in before.items():
                if view is None:
                    self.spark.catalog.dropTempView(name)
                else:
                    view.createOrReplaceTempView(name)

    def execute_raw(self, sql: str | list[str] | tuple[str, ...], *params: Any) -> int:
        """Raw writes: versions of tables are DataFrames, which no SQL text can change."""
        raise QueryValidationError("tables take no raw writes; use update_many, delete_many, create_many, and save to write files")

    # -- transactions -------------------------------------------------------

    def transaction(self, work: Callable[[Client], Any] | list[Callable[[Client], Any]]) -> Any:
        """Run work(client), or a list of such, with all their writes or none."""
        with self.source.transaction():
            return [w(self) for w in work] if isinstance(work, list) else work(self)

    def save(self, folder: str) -> None:
        self.source.save(folder)


class Delegate:
    """The operations on one model. Reads return lazy DataFrames."""

    def __init__(self, client: Client, model: Model):
        self._client, self._model = client, model

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        action = next((op for op in OPERATIONS if name in (op, _snake(op))), None)
        if action:
            return lambda args=None, **more: self._run(action, {**(args or {}), **more})
        for ext in reversed(self._client._extensions):
            for scope in (self._model.name, "$allModels"):
                method = ext.get("model", {}).get(scope, {}).get(name)
                if method:
                    return lambda *a, **k: method(self, *a, **k)
        raise AttributeError(name)

    # -- the way of a call: hooks, then middleware, then the operation -------

    def _run(self, action: str, args: dict) -> Any:
        call = lambda given: self._through_middleware(action, given)
        for ext in self._client._extensions:
            for scope in (self._model.name, "$allModels"):
                hooks = ext.get("query", {}).get(scope, {})
                for name in (action, "$allOperations"):
                    if name in hooks:
                        call = self._hooked(hooks[name], action, call)
        return call(args)

    def _hooked(self, hook: Callable, action: str, inner: Callable) -> Callable:
        return lambda args: hook({"model": self._model.name, "operation": action, "args": args, "query": inner})

    def _through_middleware(self, action: str, args: dict) -> Any:
        def last(params: dict) -> Any:
            began = time.perf_counter()
            out = getattr(self, f"_{_snake(params['action'])}")(params["args"])
            for listener in self._client._listeners:
                listener({"model": self._model.name, "action": params["action"], "seconds": time.perf_counter() - began, "plan": _plan_of(out)})
            return out

        call = last
        for m in self._client._middleware:
            call = (lambda m, inner: lambda params: m(params, inner))(m, call)
        return call({"model": self._model.name, "action": action, "args": args})

    # -- computed fields ----------------------------------------------------

    def _computed(self) -> dict[str, tuple[list[str], Callable]]:
        out = {}
        for ext in self._client._extensions:
            for scope in ("$allModels", self._model.name):
                for name, given in ext.get("result", {}).get(scope, {}).items():
                    out[name] = (list(given.get("needs", ())), given["compute"])
        return out

    def _project(self, args: Mapping[str, Any]) -> DataFrame:
        computed = self._computed()
        select = args.get("select")
        wanted = computed if not select else {n: c for n, c in computed.items() if select.get(n)}
        if select and wanted:
            needed = {n: True for needs, _ in wanted.values() for n in needs}
            args = {**args, "select": {**{n: v for n, v in select.items() if n not in wanted}, **needed}}
        df = self._client.reader.find_many(self._model, args)
        for name, (needs, compute) in wanted.items():
            if all(n in df.columns for n in needs):
                made = compute({n: F.col(n) for n in needs})
                df = df.withColumn(name, made if isinstance(made, Column) else F.lit(made))
        return df

    # -- reads --------------------------------------------------------------

    def _find_many(self, args: dict) -> DataFrame:
        return self._project(args)

    def _find_first(self, args: dict) -> DataFrame:
        return self._project({**args, "take": 1})

    def _find_unique(self, args: dict) -> DataFrame:
        if not args.get("where"):
            raise QueryValidationError("findUnique needs where")
        return self._project({**args, "take": 1})

    def _or_throw(self, df: DataFrame) -> Any:
        row = df.first()
        if row is None:
            raise RecordNotFoundError(self._model.name)
        return row

    def _find_first_or_throw(self, args: dict) -> Any:
        return self._or_throw(self._find_first(args))

    def _find_unique_or_throw(self, args: dict) -> Any:
        return self._or_throw(self._find_unique(args))

    def _count(self, args: dict) -> DataFrame:
        return aggregate.count(self._client.reader, self._model, args)

    def _aggregate(self, args: dict) -> DataFrame:
        return aggregate.aggregate(self._client.reader, self._model, args)

    def _group_by(self, args: dict) -> DataFrame:
        return aggregate.group_by(self._client.reader, self._model, args)

    def traverse(self, where: Mapping[str, Any], relation: str, args: Mapping[str, Any] | None = None) -> DataFrame:
        """Rows of a relation of the rows that `where` chooses, by the relation's other end."""
        back = inverse(self._client.schema, self._model, relation)
        if back is None:
            raise QueryValidationError(f"{self._model.name}.{relation} has no other end")
        target = resolve(self._client.schema, self._model, relation).target
        lead = {back.name: {"some": where} if back.is_list else {"is": where}}
        args = dict(args or {})
        args["where"] = {"AND": [lead, args.get("where") or {}]}
        return Delegate(self._client, target)._project(args)

    def follow(self, where: Mapping[str, Any] | None = None) -> Traversal:
        """The rows that `where` chooses, to go on from along relations: follow({...}).orders().lines().rows()."""
        return Traversal(self._client, self._model, self._client.writer.matching(self._model, where))

    # -- writes -------------------------------------------------------------

    def _shown(self, args: Mapping[str, Any], where: Mapping[str, Any]) -> DataFrame:
        return self._project({"where": where, **{k: args[k] for k in ("select", "include", "omit") if args.get(k)}})

    def _create(self, args: dict) -> DataFrame:
        with self._client.source.transaction():
            row = self._client.writer.create(self._model, args["data"])
        return self._shown(args, Writer.key(self._model, row))

    def _create_many(self, args: dict) -> int:
        return self._create_many_and_return(args).count()

    def _create_many_and_return(self, args: dict) -> DataFrame:
        with self._client.source.transaction():
            rows = self._client.writer.create_many(self._model, list(args["data"]), bool(args.get("skipDuplicates")))
        names = [f.name for f in self._model.scalars if (not args.get("select") or args["select"].get(f.name)) and not (args.get("omit") or {}).get(f.name)]
        return rows.select(*names)

    def _update(self, args: dict) -> DataFrame:
        with self._client.source.transaction():
            key = self._client.writer.update(self._model, args["where"], args["data"])
        return self._shown(args, key)

    def _update_many(self, args: dict) -> int:
        with self._client.source.transaction():
            return self._client.writer.update_many(self._model, args.get("where"), args["data"])

    def _upsert(self, args: dict) -> DataFrame:
        with self._client.source.transaction():
            if self._client.writer.first(self._model, args["where"]) is None:
                key = Writer.key(self._model, self._client.writer.create(self._model, args["create"]))
            else:
                key = self._client.writer.update(self._model, args["where"], args["update"])
        return self._shown(args, key)

    def _delete(self, args: dict) -> DataFrame:
        with self._client.source.transaction():
            row = self._client.writer.first(self._model, args["where"])
            if row is None:
                raise RecordNotFoundError(f"{self._model.name} to delete")
            key = Writer.key(self._model, row)
            out = self._shown(args, key)
            self._client.writer.delete_many(self._model, key)
        return out

    def _delete_many(self, args: dict) -> int:
        with self._client.source.transaction():
            return self._client.writer.delete_many(self._model, args.get("where"))


class Traversal:
    """A set of rows of a model; each relation, called by its name, leads to the rows related to any of them."""

    def __init__(self, client: Client, model: Model, frame: DataFrame):
        self._client, self._model, self._frame = client, model, frame

    def __getattr__(self, name: str) -> Callable[..., Traversal]:
        field = self._model.field(name)
        if field is None or field.kind != "object":
            raise AttributeError(name)
        return lambda where=None: self._step(name, where)

    def _step(self, name: str, where: Mapping[str, Any] | None) -> Traversal:
        join = resolve(self._client.schema, self._model, name)
        target = self._client.writer.matching(join.target, where)
        keys = self._frame.select(*(F.col(o).alias(f"_k{i}") for i, o in enumerate(join.own)))
        same = [target[o] == keys[f"_k{i}"] for i, o in enumerate(join.other)]
        return Traversal(self._client, join.target, target.join(keys, same, "left_semi"))

    def rows(self, **args: Any) -> DataFrame:
        """The rows, with arguments of find_many but where."""
        return self._client.reader.shape(self._frame, self._model, args)
