"""Statements beyond SELECT over an Engine's collections: definitions, changes, files, graphs, search and views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polymera.operators import dml, graph, lookups, match, search, timeseries
from polymera.session import Engine, Sequences
from polymera.sources import files
from polymera.storage import new_folder, written

#: Spark types of the declared column types.
TYPES = {
    "TEXT": "string",
    "VARCHAR": "string",
    "STRING": "string",
    "INT": "int",
    "INTEGER": "int",
    "BIGINT": "bigint",
    "SMALLINT": "smallint",
    "FLOAT": "double",
    "DOUBLE": "double",
    "REAL": "float",
    "BOOL": "boolean",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp",
    "TIMESTAMPTZ": "timestamp",
    "DATE": "date",
    "BYTES": "binary",
    "JSON": "string",
    "DECIMAL": "decimal(38,9)",
}

_FORMS: list[tuple[re.Pattern, Callable]] = []


def _form(pattern: str):
    def keep(f: Callable) -> Callable:
        _FORMS.append((re.compile(pattern + r"\s*;?\s*$", re.I | re.S), f))
        return f

    return keep


class Statements:
    """Runs statements; what it does not know goes to Spark SQL. Changes replace a collection's view by a written table."""

    def __init__(self, engine: Engine):
        self.engine, self.spark = engine, engine.spark
        self.sequences = Sequences()
        self.views = lookups.MaterializedViews(new_folder(self.spark, "views"))
        self.keys: dict[str, str] = {}
        self.kinds: dict[str, str] = {}

    def execute(self, text: str) -> DataFrame:
        for pattern, run in _FORMS:
            m = pattern.match(text.strip())
            if m:
                return run(self, **m.groupdict())
        return self.engine.sql(text.strip().rstrip(";"))

    def table(self, source: str) -> DataFrame:
        """A collection, or a query in parentheses."""
        source = source.strip()
        return self.engine.sql(source[1:-1]) if source.startswith("(") else self.engine.collection(source)

    def replaced(self, name: str, df: DataFrame) -> DataFrame:
        return self.engine.register(name, written(df, f"collection-{name}"))

    def rows(self, columns: list[str], values: list) -> DataFrame:
        return self.spark.createDataFrame(values, ", ".join(f"`{c}` string" for c in columns))


def _option(options: str | None, name: str, default=None):
    found = re.search(rf"\b{name}\s*=?\s*('[^']*'|[\w.+-]+)", options or "", re.I)
    return found[1].strip("'") if found else default


@_form(r"CREATE\s+(?:COLLECTION|TABLE)\s+(?:IF\s+NOT\s+EXISTS\s+)?(?P<name>\w+)\s*(?:\((?P<columns>.*?)\))?\s*(?P<options>(?:TYPE\s+\w+|WITH\b).*)?")
def create_collection(s: Statements, name: str, columns: str | None, options: str | None) -> DataFrame:
    """Columns of known types, an optional primary key; the engine is kept as a note."""
    parts = re.split(r",(?![^(]*\))", columns) if columns else ["id TEXT PRIMARY KEY"]
    fields = []
    for part in parts:
        words = part.split()
        kind = words[1].upper()
        vector = re.match(r"VECTOR\((\d+)\)", kind)
        fields.append(f"`{words[0]}` {'array<float>' if vector else TYPES[kind.partition('(')[0]]}")
        if "PRIMARY" in part.upper():
            s.keys[name] = words[0]
    s.kinds[name] = _option(options, "engine") or _option(options, "TYPE") or "document"
    s.engine.register(name, s.spark.createDataFrame([], ", ".join(fields)))
    return s.rows(["created"], [(name,)])


@_form(r"DROP\s+(?:COLLECTION|TABLE)\s+(?P<maybe>IF\s+EXISTS\s+)?(?P<name>\w+)")
def drop_collection(s: Statements, name: str, maybe: str | None) -> DataFrame:
    if name not in s.engine.schemas and not maybe:
        raise ValueError(f"42P01: no collection {name}")
    if name in s.engine.schemas:
        s.engine.drop(name)
    return s.rows(["dropped"], [(name,)])


@_form(r"SHOW\s+COLLECTIONS")
def show_collections(s: Statements) -> DataFrame:
    return s.rows(["name", "engine"], [(n, s.kinds.get(n, "table")) for n in sorted(s.engine.schemas)])


@_form(r"DESCRIBE\s+(?:COLLECTION\s+)?(?P<name>\w+)")
def describe(s: Statements, name: str) -> DataFrame:
    return s.rows(["column", "type", "primary_key"], [(c, t, str(s.keys.get(name) == c).lower()) for c, t in s.engine.schemas[name].items()])


def _values(s: Statements, name: str, columns: str | None, body: str) -> DataFrame:
    schema = s.engine.schemas[name]
    names = [c.strip().strip("`\"") for c in columns.split(",")] if columns else list(schema)
    rows = s.engine.sql(f"SELECT * FROM ({body}) AS given({', '.join(f'`{n}`' for n in names)})") if body.upper().startswith("VALUES") else s.engine.sql(body).toDF(*names)
    return rows.select(*[F.col(f"`{n}`").cast(schema[n]).alias(n) for n in names])


@_form(r"(?P<verb>INSERT|UPSERT)\s+INTO\s+(?P<name>\w+)\s*(?:\((?P<columns>[\w\s,`\"]*)\))?\s*(?P<body>(?:VALUES|SELECT|WITH)\b.*?)(?P<ignore>\s+ON\s+CONFLICT\s+(?:\(\w+\)\s+)?DO\s+NOTHING)?")
def insert(s: Statements, verb: str, name: str, columns: str | None, body: str, ignore: str | None) -> DataFrame:
    """INSERT appends, with DO NOTHING only new keys; UPSERT replaces rows of equal primary keys."""
    rows, old = _values(s, name, columns, body), s.engine.collection(name)
    if verb.upper() == "UPSERT" or ignore:
        key = s.keys.get(name, old.columns[0])
        new = dml.insert_or_ignore(old, rows, [key]) if ignore else dml.upsert(old, rows, [key])
    else:
        new = dml.insert(old, rows)
    return s.replaced(name, new)


@_form(r"UPDATE\s+(?P<name>\w+)\s+SET\s+(?P<sets>.*?)(?:\s+WHERE\s+(?P<where>.*))?")
def update(s: Statements, name: str, sets: str, where: str | None) -> DataFrame:
    pairs = dict(p.split("=", 1) for p in re.split(r",(?![^(]*\))", sets))
    old = s.engine.collection(name)
    return s.replaced(name, dml.update(old, F.expr(where or "true"), {k.strip(): F.expr(v).cast(old.schema[k.strip()].dataType) for k, v in pairs.items()}))


@_form(r"DELETE\s+FROM\s+(?P<name>\w+)(?:\s+WHERE\s+(?P<where>.*))?")
def delete(s: Statements, name: str, where: str | None) -> DataFrame:
    return s.replaced(name, dml.delete(s.engine.collection(name), F.expr(where or "true")))


@_form(r"TRUNCATE\s+(?:TABLE\s+|COLLECTION\s+)?(?P<name>\w+)")
def truncate(s: Statements, name: str) -> DataFrame:
    return s.replaced(name, dml.truncate(s.engine.collection(name)))


@_form(r"COPY\s+(?P<name>\w+)\s+FROM\s+'(?P<path>[^']+)'(?P<options>.*)?")
def copy_from(s: Statements, name: str, path: str, options: str | None) -> DataFrame:
    """Append a file's rows to a collection, by its column types."""
    schema = ", ".join(f"`{c}` {t}" for c, t in s.engine.schemas[name].items())
    rows = files.copy_from(s.spark, path, schema, _option(options, "FORMAT"), _option(options, "DELIMITER"), str(_option(options, "HEADER", "true")).lower() == "true")
    return s.replaced(name, dml.insert(s.engine.collection(name), rows))


@_form(r"COPY\s+(?P<source>\w+|\(.*\))\s+TO\s+'(?P<path>[^']+)'(?P<options>.*)?")
def copy_to(s: Statements, source: str, path: str, options: str | None) -> DataFrame:
    files.copy_to(s.table(source), path, _option(options, "FORMAT"), _option(options, "DELIMITER", ","))
    return s.rows(["written"], [(path,)])


@_form(r"GRAPH\s+ALGO\s+(?P<name>\w+)\s+ON\s+(?P<source>\w+)(?P<options>.*)?")
def graph_algorithm(s: Statements, name: str, source: str, options: str | None) -> DataFrame:
    """An algorithm over a collection of (src, dst[, weight]) or (_from, _to[, weight])."""
    edges = s.engine.collection(source).withColumnsRenamed({"_from": "src", "_to": "dst", "_type": "label"})
    name = {"kcore": "k_core", "community": "louvain"}.get(name.lower(), name.lower())
    more = {}
    if name in ("pagerank", "label_propagation") and _option(options, "ITERATIONS"):
        more["max_iterations"] = int(_option(options, "ITERATIONS"))
    if name == "pagerank" and _option(options, "DAMPING"):
        more["damping"] = float(_option(options, "DAMPING"))
    if name == "louvain" and _option(options, "RESOLUTION"):
        more["resolution"] = float(_option(options, "RESOLUTION"))
    if name == "degree" and _option(options, "DIRECTION"):
        more["direction"] = _option(options, "DIRECTION").lower()
    if name == "sssp":
        more["source"] = _option(options, "FROM")
    return graph.ALGORITHMS[name](edges, **more)


@_form(r"GRAPH\s+TRAVERSE\s+(?:ON\s+)?(?P<source>\w+)\s+FROM\s+'(?P<node>[^']+)'(?P<options>.*)?")
def graph_traverse(s: Statements, source: str, node: str, options: str | None) -> DataFrame:
    edges = s.engine.collection(source).withColumnsRenamed({"_from": "src", "_to": "dst", "_type": "label"})
    start = graph.vertices(edges).where(F.col("id").cast("string") == node)
    return graph.bfs(edges, start, int(_option(options, "DEPTH", 10)), _option(options, "DIRECTION", "out").lower(), _option(options, "LABEL"))


@_form(r"MATCH\s+(?P<pattern>.*?)\s+(?:OPTIONAL\s+MATCH\s+(?P<optional>.*?)\s+)?ON\s+(?P<nodes>\w+)\s*,\s*(?P<edges>\w+)(?:\s+WHERE\s+(?P<where>.*?))?\s+RETURN\s+(?P<returned>.*?)(?:\s+ORDER\s+BY\s+(?P<order>.*?))?(?:\s+LIMIT\s+(?P<limit>\d+))?")
def match_query(s: Statements, pattern, optional, nodes, edges, where, returned, order, limit) -> DataFrame:
    """MATCH over a node and an edge collection; variables are node ids."""
    e = s.engine.collection(edges).withColumnsRenamed({"_from": "src", "_to": "dst", "_type": "label"})
    rows = match.match(s.engine.collection(nodes), e, pattern, optional)
    rows = rows.where(where) if where else rows
    rows = rows.selectExpr(*[c.strip() for c in returned.split(",")])
    rows = rows.orderBy(*[F.expr(c) for c in order.split(",")]) if order else rows
    return rows.limit(int(limit)) if limit else rows


@_form(r"SEARCH\s+(?P<name>\w+)\s+USING\s+VECTOR\s*\(\s*(?P<column>\w+)\s*,\s*ARRAY\s*\[(?P<vector>[^\]]*)\]\s*,\s*(?P<k>\d+)\s*(?:,\s*'?(?P<metric>\w+)'?\s*)?\)")
def search_vector(s: Statements, name: str, column: str, vector: str, k: str, metric: str | None) -> DataFrame:
    df = s.engine.collection(name)
    return search.knn(df, [float(x) for x in vector.split(",")], int(k), column, s.keys.get(name, df.columns[0]), metric or "l2")


@_form(r"SEARCH\s+(?P<name>\w+)\s+USING\s+TEXT\s*\(\s*(?P<column>\w+)\s*,\s*'(?P<text>[^']*)'\s*,\s*(?P<k>\d+)\s*\)")
def search_text(s: Statements, name: str, column: str, text: str, k: str) -> DataFrame:
    df = s.engine.collection(name)
    return search.bm25(df, text, s.keys.get(name, df.columns[0]), column).orderBy(F.desc("score"), "id").limit(int(k))


@_form(r"SHOW\s+TAG\s+VALUES\s+(?:FOR|FROM)\s+(?P<name>\w+)\s*\(?\s*(?P<tag>\w+)\s*\)?")
def show_tag_values(s: Statements, name: str, tag: str) -> DataFrame:
    return timeseries.tag_values(s.engine.collection(name), tag)


@_form(r"CREATE\s+MATERIALIZED\s+VIEW\s+(?P<name>\w+)\s+AS\s+(?P<body>.*)")
def create_view(s: Statements, name: str, body: str) -> DataFrame:
    s.views.create(name, lambda: s.engine.sql(body))
    return refresh_view(s, name)


@_form(r"REFRESH\s+(?:MATERIALIZED\s+VIEW|CONTINUOUS\s+AGGREGATE)\s+(?P<name>\w+)")
def refresh_view(s: Statements, name: str) -> DataFrame:
    s.views.refresh(name)
    s.spark.catalog.refreshByPath(f"{s.views.folder}/{name}")
    return s.engine.register(name, s.views.read(s.spark, name))


@_form(r"DROP\s+MATERIALIZED\s+VIEW\s+(?P<name>\w+)")
def drop_view(s: Statements, name: str) -> DataFrame:
    s.views.drop(name)
    s.engine.drop(name)
    return s.rows(["dropped"], [(name,)])


@_form(r"SHOW\s+MATERIALIZED\s+VIEWS")
def show_views(s: Statements) -> DataFrame:
    return s.rows(["name"], [(n,) for n in s.views.show()])


@_form(r"CREATE\s+SEQUENCE\s+(?P<name>\w+)(?P<options>.*)?")
def create_sequence(s: Statements, name: str, options: str | None) -> DataFrame:
    s.sequences.setval(name, int(_option(re.sub(r"(?i)START\s+WITH", "START", options or ""), "START", 1)) - 1)
    return s.rows(["created"], [(name,)])


@_form(r"SELECT\s+(?P<call>NEXTVAL|CURRVAL)\s*\(\s*'(?P<name>\w+)'\s*\)")
def sequence_value(s: Statements, call: str, name: str) -> DataFrame:
    value = s.sequences.nextval(name).start if call.upper() == "NEXTVAL" else s.sequences.currval(name)
    return s.spark.range(1).select(F.lit(value).cast("long").alias(call.lower()))


@_form(r"SHOW\s+SEQUENCES")
def show_sequences(s: Statements) -> DataFrame:
    return s.rows(["name", "value"], [(n, str(v)) for n, v in sorted(s.sequences.values.items())])


@_form(r"SHOW\s+GRAPH\s+STATS\s+(?:FOR|ON)\s+(?P<source>\w+)")
def show_graph_stats(s: Statements, source: str) -> DataFrame:
    return graph.statistics(s.engine.collection(source).withColumnsRenamed({"_from": "src", "_to": "dst", "_type": "label"}))
