"""A PromQL subset over samples (name, labels map, ts in ms, value), evaluated at every step of a range."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polymera.functions.datetimes import interval_ms

#: Fixed value: how far back an instant selector looks, in ms.
LOOKBACK_MS = 300_000

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?(?![\w]))|(\"[^\"]*\"|'[^']*')|(\d+[a-z][\da-z]*)|([A-Za-z_:][\w:]*)|(=~|!~|!=|==|>=|<=|[-+*/%^(){}\[\],=<>]))")

AGGREGATES = ("sum", "avg", "min", "max", "count", "stddev", "stdvar", "topk", "bottomk", "quantile", "count_values", "group")
SETS = ("and", "or", "unless")


@dataclass
class Node:
    kind: str  # number, selector, call, aggregate, binary, negate
    value: object = None
    args: list = field(default_factory=list)
    matchers: list = field(default_factory=list)
    window: int | None = None
    offset: int = 0
    by: list | None = None
    without: list | None = None
    on: list | None = None
    ignoring: list | None = None
    is_bool: bool = False
    group: str | None = None


class _Parser:
    LEVELS = (("or",), ("and", "unless"), ("==", "!=", ">", "<", ">=", "<="), ("+", "-"), ("*", "/", "%"))

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"cannot read {text[at:]!r}")
            self.tokens.append((("number", "string", "duration", "name", "op")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, offset: int = 0):
        return self.tokens[self.at + offset][1] if self.at + offset < len(self.tokens) else None

    def take(self, want: str | None = None):
        if self.at >= len(self.tokens) or want is not None and self.peek() != want:
            raise ValueError(f"expected {want!r}, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self) -> Node:
        out = self.binary(0)
        if self.peek() is not None:
            raise ValueError(f"unexpected {self.peek()!r}")
        return out

    def names(self) -> list:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.take())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return out

    def binary(self, level: int) -> Node:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in self.LEVELS[level]:
            n = Node("binary", self.take())
            if self.peek() == "bool":
                self.take()
                n.is_bool = True
            if self.peek() in ("on", "ignoring"):
                setattr(n, self.take(), self.names())
            if self.peek() in ("group_left", "group_right"):
                n.group = self.take()
                if self.peek() == "(":
                    self.names()
            n.args = [left, self.binary(level + 1)]
            left = n
        return left

    def unary(self) -> Node:
        if self.peek() == "-":
            self.take()
            return Node("negate", args=[self.unary()])
        left = self.postfix()
        if self.peek() == "^":
            self.take()
            return Node("binary", "^", [left, self.unary()])
        return left

    def postfix(self) -> Node:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if text == "(":
            self.take()
            out = self.binary(0)
            self.take(")")
            return out
        if kind == "number":
            return Node("number", float(self.take()))
        if kind == "string":
            return Node("string", self.take()[1:-1])
        if kind == "name" and text in AGGREGATES and self.peek(1) in ("(", "by", "without"):
            n = Node("aggregate", self.take())
            if self.peek() in ("by", "without"):
                setattr(n, self.take(), self.names())
            n.args = self.arguments()
            if self.peek() in ("by", "without"):
                setattr(n, self.take(), self.names())
            return n
        if kind == "name" and self.peek(1) == "(":
            name = self.take()
            return Node("call", name, self.arguments())
        if kind == "name" or text == "{":
            return self.selector()
        raise ValueError(f"unexpected {text!r}")

    def arguments(self) -> list:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.binary(0))
            if self.peek() == ",":
                self.take()
        self.take(")")
        return out

    def selector(self) -> Node:
        n = Node("selector", self.take() if self.peek() != "{" else None)
        if self.peek() == "{":
            self.take()
            while self.peek() != "}":
                n.matchers.append((self.take(), self.take(), self.take()[1:-1]))
                if self.peek() == ",":
                    self.take()
            self.take("}")
        if self.peek() == "[":
            self.take()
            n.window = interval_ms(self.take())
            self.take("]")
        if self.peek() == "offset":
            self.take()
            n.offset = interval_ms(self.take())
        return n


def parse(text: str) -> Node:
    return _Parser(text).parse()


def evaluate(text: str, samples: DataFrame, start: int, end: int | None = None, step: int = 60_000) -> DataFrame:
    """(ts, labels, value) of an expression at start, start + step, ... up to end (None: start alone).

    A sample meets only the steps whose window it is in, by arithmetic on its time: no cross join.
    """
    return _Evaluator(samples, start, start if end is None else end, step).vector(parse(text))


class _Evaluator:
    def __init__(self, samples: DataFrame, start: int, end: int, step: int):
        self.samples, self.start, self.end, self.step = samples, start, end, max(1, step)
        self.last = start + (end - start) // self.step * self.step

    def selected(self, n: Node) -> DataFrame:
        rows = self.samples if n.value is None else self.samples.where(F.col("name") == n.value)
        for label, op, value in n.matchers:
            own = F.coalesce(F.col("labels")[label], F.lit("")) if label != "__name__" else F.col("name")
            rows = rows.where({"=": own == value, "!=": own != value, "=~": own.rlike(f"^(?:{value})$"), "!~": ~own.rlike(f"^(?:{value})$")}[op])
        return rows

    def windowed(self, n: Node, width: int) -> DataFrame:
        """(labels, step time t, ts, value): each sample at every step t with t - width < ts <= t."""
        at = F.col("ts") + n.offset
        first = F.greatest(F.lit(self.start), F.lit(self.start) + F.ceil((at - self.start) / self.step) * self.step)
        final = F.least(F.lit(self.last), F.lit(self.start) + F.floor((at + width - 1 - self.start) / self.step) * self.step)
        rows = self.selected(n).where((at > self.start - width) & (at <= self.last))
        steps = F.when(first <= final, F.sequence(first.cast("long"), final.cast("long"), F.lit(self.step).cast("long")))
        return rows.select(_sorted(F.col("labels")).alias("labels"), F.explode(steps).alias("t"), "ts", "value")

    def vector(self, n: Node) -> DataFrame:
        return getattr(self, n.kind)(n)

    def number(self, n: Node) -> DataFrame:
        spark = self.samples.sparkSession
        return spark.range(self.start, self.last + 1, self.step).select(F.col("id").alias("ts"), _sorted(F.create_map().cast("map<string,string>")).alias("labels"), F.lit(n.value).alias("value"))

    def selector(self, n: Node) -> DataFrame:
        if n.window is not None:
            raise ValueError("a range vector needs a function")
        return self.windowed(n, LOOKBACK_MS).groupBy("labels", "t").agg(F.max_by("value", "ts").alias("value")).select(F.col("t").alias("ts"), "labels", "value")

    def negate(self, n: Node) -> DataFrame:
        return self.vector(n.args[0]).withColumn("value", -F.col("value"))

    def call(self, n: Node) -> DataFrame:
        name = n.value
        if name in _SCALAR:
            inner = self.vector(n.args[0])
            numbers = [a.value for a in n.args[1:]]
            return inner.withColumn("value", _SCALAR[name](F.col("value"), *numbers)).where("value IS NOT NULL")
        if name in ("sort", "sort_desc"):
            return self.vector(n.args[0]).orderBy(F.col("t"), F.col("value").desc() if name == "sort_desc" else F.col("value").asc(), F.col("labels").cast("string"))
        q = n.args[0].value if name == "quantile_over_time" else None
        arg = n.args[-1]
        if arg.kind != "selector" or arg.window is None:
            raise ValueError(f"{name} needs a range vector")
        rows, seconds = self.windowed(arg, arg.window), arg.window / 1000
        if name in ("rate", "increase", "irate", "resets", "changes", "delta", "deriv", "idelta"):
            w = Window.partitionBy("labels", "t").orderBy("ts")
            rows = rows.withColumn("before", F.lag("value").over(w))
            grown = F.when(F.col("value") >= F.col("before"), F.col("value") - F.col("before")).otherwise(F.col("value"))
            rows = rows.withColumn("grown", F.when(F.col("before").isNotNull(), grown))
            span = (F.max("ts") - F.min("ts")) / 1000
            two = F.count("*") >= 2
            made = {
                "rate": F.when(two & (span > 0), F.sum("grown") / span),
                "increase": F.when(two & (span > 0), F.sum("grown") / span * seconds),
                "irate": F.when(two, F.max_by(F.col("grown"), "ts") / ((F.max("ts") - F.max(F.when(F.col("before").isNull(), None).otherwise(F.col("ts")))) / 1000 + 0.0)),
                "resets": F.sum(F.coalesce((F.col("value") < F.col("before")).cast("double"), F.lit(0.0))),
                "changes": F.sum(F.coalesce((F.col("value") != F.col("before")).cast("double"), F.lit(0.0))),
                "delta": F.when(two & (span > 0), (F.max_by("value", "ts") - F.min_by("value", "ts")) / span * seconds),
                "idelta": F.when(two, F.max_by(F.col("value") - F.col("before"), "ts")),
                "deriv": F.when(two, F.regr_slope(F.col("value"), F.col("ts") / 1000)),
            }[name]
            if name == "irate":
                rows = rows.withColumn("gap", (F.col("ts") - F.lag("ts").over(w)) / 1000)
                made = F.when(two, F.max_by(F.col("grown") / F.col("gap"), "ts"))
        else:
            made = {
                "sum_over_time": F.sum("value"),
                "avg_over_time": F.avg("value"),
                "min_over_time": F.min("value"),
                "max_over_time": F.max("value"),
                "count_over_time": F.count("value").cast("double"),
                "last_over_time": F.max_by("value", "ts"),
                "present_over_time": F.lit(1.0),
                "stddev_over_time": F.stddev_pop("value"),
                "stdvar_over_time": F.var_pop("value"),
                "quantile_over_time": F.percentile("value", F.lit(q if q is not None else 0.5)),
            }[name]
        return rows.groupBy("labels", "t").agg(made.alias("value")).where("value IS NOT NULL").select(F.col("t").alias("ts"), "labels", "value")

    def aggregate(self, n: Node) -> DataFrame:
        rows = self.vector(n.args[-1])
        kept = F.filter(F.col("labels"), lambda e: e["key"].isin(*n.by)) if n.by is not None else F.filter(F.col("labels"), lambda e: ~e["key"].isin(*n.without)) if n.without is not None else F.filter(F.col("labels"), lambda e: F.lit(False))
        rows = rows.withColumn("g", kept)
        if n.value in ("topk", "bottomk"):
            order = F.desc("value") if n.value == "topk" else F.asc("value")
            ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("ts", "g").orderBy(order, F.col("labels").cast("string"))))
            return ranked.where(F.col("n") <= int(n.args[0].value)).select("ts", "labels", "value")
        if n.value == "count_values":
            name = n.args[0].value
            extra = F.array(F.struct(F.lit(name).alias("key"), F.col("value").cast("string").alias("value")))
            return rows.withColumn("g", F.array_sort(F.concat("g", extra))).groupBy("ts", F.col("g").alias("labels")).agg(F.count("*").cast("double").alias("value"))
        made = {
            "sum": F.sum("value"),
            "avg": F.avg("value"),
            "min": F.min("value"),
            "max": F.max("value"),
            "count": F.count("*").cast("double"),
            "group": F.lit(1.0),
            "stddev": F.stddev_pop("value"),
            "stdvar": F.var_pop("value"),
            "quantile": F.percentile("value", F.lit(n.args[0].value)) if n.value == "quantile" else F.lit(0.0),
        }[n.value]
        return rows.groupBy("ts", F.col("g").alias("labels")).agg(made.alias("value"))

    def binary(self, n: Node) -> DataFrame:
        op, (left, right) = n.value, n.args
        if left.kind == "number" and right.kind == "number":
            return self.number(Node("number", 0.0)).withColumn("value", _op(op, F.lit(left.value), F.lit(right.value), True))
        if right.kind == "number" or left.kind == "number":
            vector = self.vector(left if right.kind == "number" else right)
            number = F.lit((right if right.kind == "number" else left).value)
            a, b = (F.col("value"), number) if right.kind == "number" else (number, F.col("value"))
            return _compared(vector, op, a, b, n.is_bool)
        key = lambda c: F.filter(c, lambda e: e["key"].isin(*n.on)) if n.on is not None else F.filter(c, lambda e: ~e["key"].isin(*(n.ignoring or [""])))
        l = self.vector(left).withColumn("k", key(F.col("labels")))
        r = self.vector(right).withColumn("k", key(F.col("labels")))
        if op in SETS:
            keys = r.select("ts", "k").distinct()
            if op == "or":
                return l.select("ts", "labels", "value").unionByName(r.join(l.select("ts", "k").distinct(), ["ts", "k"], "left_anti").select("ts", "labels", "value"))
            return l.join(keys, ["ts", "k"], "left_semi" if op == "and" else "left_anti").select("ts", "labels", "value")
        r = r.select("ts", "k", F.col("labels").alias("other_labels"), F.col("value").alias("other"))
        labels = F.col("other_labels") if n.group == "group_right" else F.col("labels") if n.group == "group_left" or (n.on is None and n.ignoring is None) else F.col("k")
        j = l.join(r, ["ts", "k"]).withColumn("labels", labels)
        return _compared(j, op, F.col("value"), F.col("other"), n.is_bool)


def _sorted(labels: Column) -> Column:
    """Labels as sorted entries, which can be grouped by; labels['x'] on the result is by label()."""
    return F.array_sort(F.map_entries(labels))


def _op(op: str, a: Column, b: Column, as_number: bool) -> Column:
    forms = {"+": a + b, "-": a - b, "*": a * b, "/": F.when(b != 0, a / b), "%": F.when(b != 0, a % b), "^": F.pow(a, b)}
    if op in forms:
        return forms[op]
    test = {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return test.cast("double") if as_number else F.when(test, a)


def _compared(rows: DataFrame, op: str, a: Column, b: Column, is_bool: bool) -> DataFrame:
    if op in ("==", "!=", ">", "<", ">=", "<=") and not is_bool:
        return rows.where(_op(op, a, b, True) == 1).select("ts", "labels", "value")
    return rows.select("ts", "labels", _op(op, a, b, True).alias("value")).where("value IS NOT NULL")


_SCALAR = {
    "abs": F.abs,
    "ceil": lambda v: F.ceil(v).cast("double"),
    "floor": lambda v: F.floor(v).cast("double"),
    "round": lambda v, to=1.0: F.floor(v / to + 0.5) * to,
    "exp": F.exp,
    "ln": F.ln,
    "log2": F.log2,
    "log10": F.log10,
    "sqrt": F.sqrt,
    "clamp_min": lambda v, low: F.greatest(v, F.lit(low)),
    "clamp_max": lambda v, high: F.least(v, F.lit(high)),
    "clamp": lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high)),
}


def label(labels: Column, name: str) -> Column:
    """A label's value from sorted entries."""
    return F.filter(labels, lambda e: e["key"] == name)[0]["value"]
