"""SHACL Core: shapes read into a small driver-side model, each constraint compiled to a DataFrame of results.

A result row is (focus, path, value, shape, component, severity, message). Shapes graphs are read whole by the driver, up to `MAX_SHAPE_TRIPLES`
statements; data graphs never are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadloom.errors import QueryError
from quadloom.functions.values import Val, compare, const
from quadloom.operators.inference import transitive
from quadloom.operators.validation import well_formed
from quadloom.plans.algebra import Path
from quadloom.plans.paths import PathCompiler
from quadloom.session import cut
from quadloom.store import Active, QuadStore, equals
from quadloom.terms import BNODE, IRI, LITERAL, RDF, RDFS, TERM, Term, nt_text, sh, short_dt

MAX_SHAPE_TRIPLES = 200_000
TYPE, SUBCLASS, FIRST, REST, NIL = RDF + "type", RDFS + "subClassOf", RDF + "first", RDF + "rest", RDF + "nil"
_RESULT = f"focus {TERM.simpleString()}, path string, value {TERM.simpleString()}, shape string, component string, severity string, message string"


@dataclass
class Shape:
    node: Term
    props: dict[str, list[Term]]
    path: Path | None = None
    path_text: str | None = None
    nested: dict[str, list] = field(default_factory=dict)

    def get(self, name: str) -> list[Term]:
        return self.props.get(sh[name], [])

    def one(self, name: str) -> Term | None:
        got = self.get(name)
        return got[0] if got else None


class Shapes:
    """The shapes of a graph of (s, p, o)."""

    def __init__(self, triples: DataFrame):
        rows = triples.select("s", "p", "o").limit(MAX_SHAPE_TRIPLES + 1).collect()
        if len(rows) > MAX_SHAPE_TRIPLES:
            raise QueryError(f"a shapes graph of more than {MAX_SHAPE_TRIPLES} statements")
        self.by: dict[Term, dict[str, list[Term]]] = {}
        for r in rows:
            self.by.setdefault(Term(*r["s"]), {}).setdefault(r["p"], []).append(Term(*r["o"]))
        self.cache: dict[Term, Shape] = {}

    def list_(self, t: Term) -> list[Term]:
        out, seen = [], set()
        while t.v != NIL and t in self.by and t not in seen:
            seen.add(t)
            out += self.by[t].get(FIRST, [])
            t = self.by[t].get(REST, [Term(IRI, NIL)])[0]
        return out

    def path(self, t: Term) -> Path:
        if t.k == IRI:
            return Path("iri", (t.v,))
        props = self.by.get(t, {})
        for name, op in (("inversePath", "inv"), ("zeroOrMorePath", "star"), ("oneOrMorePath", "plus"), ("zeroOrOnePath", "opt")):
            if sh[name] in props:
                return Path(op, (self.path(props[sh[name]][0]),))
        many = [self.path(x) for x in self.list_(props[sh["alternativePath"]][0])] if sh["alternativePath"] in props else [self.path(x) for x in self.list_(t)]
        op = "alt" if sh["alternativePath"] in props else "seq"
        return reduce(lambda a, b: Path(op, (a, b)), many)

    def shape(self, t: Term) -> Shape:
        if t not in self.cache:
            props = self.by.get(t, {})
            path = props.get(sh["path"])
            self.cache[t] = Shape(t, props, self.path(path[0]) if path else None, (path[0].v if path[0].k == IRI else _path_text(self.path(path[0]))) if path else None)
        return self.cache[t]

    def recursive(self, t: Term) -> bool:
        """Whether a shape refers to itself through others."""
        seen: set[Term] = set()
        todo = [t]
        while todo:
            props = self.by.get(todo.pop(), {})
            refs = [x for n in ("node", "not", "property", "qualifiedValueShape") for x in props.get(sh[n], [])]
            refs += [x for n in ("and", "or", "xone") for head in props.get(sh[n], []) for x in self.list_(head)]
            if t in refs:
                return True
            todo += [x for x in refs if x not in seen]
            seen |= set(refs)
        return False

    def roots(self) -> list[Shape]:
        """Shapes with a target."""
        targets = [sh[x] for x in ("targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf")]
        out = []
        for t, props in self.by.items():
            kinds = {x.v for x in props.get(TYPE, [])}
            implicit = RDFS + "Class" in kinds and kinds & {sh["NodeShape"], sh["PropertyShape"]}
            if implicit or any(x in props for x in targets):
                out.append(self.shape(t))
        return out


def _path_text(p: Path) -> str:
    mark = {"star": "*", "plus": "+", "opt": "?"}
    if p.op == "iri":
        return f"<{p.args[0]}>"
    if p.op == "inv":
        return "^" + _path_text(p.args[0])
    if p.op in mark:
        return f"({_path_text(p.args[0])}){mark[p.op]}"
    return ("|" if p.op == "alt" else "/").join(map(_path_text, p.args))


class Validator:
    """Checks one data graph against one shapes graph."""

    def __init__(self, spark: SparkSession, data: DataFrame, shapes: DataFrame):
        self.spark = spark
        self.data = cut(data.select("s", "p", "o").distinct())
        self.store = QuadStore(self.data.withColumn("g", F.lit(None).cast(TERM)), distinct=False)
        self.shapes = Shapes(shapes)
        self._classes: DataFrame | None = None
        self.active: set[Term] = set()
        self.assumed: dict[Term, DataFrame] = {}  # the nodes known, or in a round assumed, to fail a recursive shape

    def instances(self, cls: str) -> DataFrame:
        """(t): the instances of a class and of its subclasses."""
        if self._classes is None:
            pairs = self.data.where((F.col("p") == SUBCLASS) & (F.col("o.k") == IRI)).select(F.col("s.v").alias("a"), F.col("o.v").alias("b"))
            self._classes = transitive(pairs)
        sub = self._classes.where(F.col("b") == cls).select("a").unionByName(self.spark.range(1).select(F.lit(cls).alias("a")))
        types = self.data.where(F.col("p") == TYPE)
        return types.join(sub, F.col("o.v") == F.col("a"), "left_semi").select(F.col("s").alias("t")).distinct()

    def targets(self, s: Shape) -> DataFrame:
        parts = [self.spark.range(1).select(t.col().cast(TERM).alias("t")) for t in s.get("targetNode")]
        parts += [self.instances(t.v) for t in s.get("targetClass")]
        if RDFS + "Class" in {x.v for x in s.props.get(TYPE, [])}:
            parts.append(self.instances(s.node.v))
        parts += [self.data.where(F.col("p") == t.v).select(F.col("s").alias("t")) for t in s.get("targetSubjectsOf")]
        parts += [self.data.where(F.col("p") == t.v).select(F.col("o").alias("t")) for t in s.get("targetObjectsOf")]
        return reduce(DataFrame.unionByName, parts).distinct()

    def report(self) -> DataFrame:
        parts = [self.check(s, self.targets(s)) for s in self.shapes.roots()]
        return reduce(DataFrame.unionByName, parts).distinct() if parts else self.empty()

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], _RESULT)

    def failing(self, t: Term, nodes: DataFrame) -> DataFrame:
        """(t): those of the nodes that do not conform to a shape."""
        if t in self.assumed:
            return nodes.join(self.assumed[t].withColumnRenamed("t", "f"), F.col("t") == F.col("f"), "left_semi")
        return self.check(self.shapes.shape(t), nodes).select(F.col("focus").alias("t")).distinct()

    def check(self, s: Shape, focus: DataFrame) -> DataFrame:
        """The results of a shape for focus nodes (t)."""
        if any(x.v in ("true", "1") for x in s.get("deactivated")):
            return self.empty()
        if s.node in self.active and s.node not in self.assumed:
            raise QueryError(f"a shape that has itself as a property {s.node.nt()}")
        if s.node not in self.assumed and s.node not in self.active and self.shapes.recursive(s.node):
            self._settle(s)
        self.active.add(s.node)
        try:
            focus = focus.select("t").distinct()
            if s.path is None:
                values = focus.select(F.col("t").alias("focus"), F.col("t").alias("value"))
            else:
                pairs = PathCompiler(self.store, Active()).pairs(s.path).distinct()
                values = pairs.join(focus, F.col("s") == F.col("t"), "left_semi").select(F.col("s").alias("focus"), F.col("o").alias("value"))
            parts = [r for r in self._constraints(s, focus, values) if r is not None]
        finally:
            self.active.discard(s.node)
        return reduce(DataFrame.unionByName, parts) if parts else self.empty()

    def _settle(self, s: Shape) -> None:
        """Find the nodes that fail a recursive shape: none at first, then those that fail if the ones found do, until no more come. Nodes that refer to
        each other in a circle conform if nothing else is against it."""
        everything = cut(self.data.select(F.explode(F.array("s", "o")).alias("t")).distinct())
        self.assumed[s.node], n = everything.limit(0), 0
        while True:
            found = cut(self.check(s, everything).select(F.col("focus").alias("t")).distinct())
            if not self.assumed[s.node].join(found, "t", "left_anti").isEmpty():
                raise QueryError(f"a shape that depends on its own negation {s.node.nt()}")
            self.assumed[s.node], before = found, n
            if (n := found.count()) == before:
                return

    def _result(self, s: Shape, df: DataFrame, component: str, value: bool = True, path: Column | None = None) -> DataFrame:
        severity = s.one("severity")
        message = s.one("message")
        v = F.col("value") if value and "value" in df.columns else F.lit(None).cast(TERM)
        return df.select(
            F.col("focus"), (path if path is not None else F.lit(s.path_text)).cast("string").alias("path"), v.cast(TERM).alias("value"), F.lit(s.node.v).alias("shape"),
            F.lit(component + "ConstraintComponent").alias("component"), F.lit((severity.v if severity else sh["Violation"]).split("#")[-1]).alias("severity"), F.lit(message.v if message else component).alias("message"),
        )

    def _constraints(self, s: Shape, focus: DataFrame, values: DataFrame):
        v = F.col("value")
        bad = lambda name, ok: self._result(s, values.where(~F.coalesce(ok, F.lit(False))), name)
        path_values = lambda p: self.data.where(F.col("p") == p.v).select(F.col("s").alias("f2"), F.col("o").alias("v2"))
        count = focus.select(F.col("t").alias("focus")).join(values.groupBy(F.col("focus").alias("f2")).agg(F.count(F.lit(1)).alias("n")), F.col("focus") == F.col("f2"), "left")
        n = F.coalesce(F.col("n"), F.lit(0))
        for x in s.get("minCount"):
            yield self._result(s, count.where(n < int(x.v)), "MinCount", False)
        for x in s.get("maxCount"):
            yield self._result(s, count.where(n > int(x.v)), "MaxCount", False)
        for x in s.get("datatype"):
            yield bad("Datatype", (v["k"] == LITERAL) & (v["dt"] == short_dt(x.v)) & well_formed(v))
        for x in s.get("class"):
            good = self.instances(x.v)
            yield self._result(s, values.join(good, v == F.col("t"), "left_anti"), "Class")
        for x in s.get("nodeKind"):
            kinds = {"IRI": [IRI], "BlankNode": [BNODE], "Literal": [LITERAL], "BlankNodeOrIRI": [BNODE, IRI], "BlankNodeOrLiteral": [BNODE, LITERAL], "IRIOrLiteral": [IRI, LITERAL]}[x.v.split("#")[-1]]
            yield bad("NodeKind", v["k"].isin(kinds))
        for name, op in (("minInclusive", ">="), ("maxInclusive", "<="), ("minExclusive", ">"), ("maxExclusive", "<")):
            for x in s.get(name):
                yield bad(name[0].upper() + name[1:], compare(op, Val("term", v), const(x)))
        text = F.when(v["k"] != BNODE, v["v"])
        for x in s.get("minLength"):
            yield bad("MinLength", F.char_length(text) >= int(x.v))
        for x in s.get("maxLength"):
            yield bad("MaxLength", F.char_length(text) <= int(x.v))
        flags = s.one("flags")
        for x in s.get("pattern"):
            yield bad("Pattern", text.rlike((f"(?{flags.v})" if flags and flags.v else "") + x.v))
        for x in s.get("languageIn"):
            tags = [t.v.lower() for t in self.shapes.list_(x)]
            ok = reduce(lambda a, b: a | b, [(F.lower(v["lang"]) == t) | F.lower(v["lang"]).startswith(t + "-") for t in tags], F.lit(False))
            yield bad("LanguageIn", ok)
        if any(x.v in ("true", "1") for x in s.get("uniqueLang")):
            twice = values.where(v["lang"].isNotNull()).groupBy("focus", F.lower(v["lang"]).alias("lang")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            yield self._result(s, twice, "UniqueLang", False)
        for x in s.get("in"):
            options = self.shapes.list_(x)
            yield bad("In", reduce(lambda a, b: a | b, [equals(v, t) for t in options], F.lit(False)))
        for x in s.get("hasValue"):
            with_it = values.where(equals(v, x)).select(F.col("focus").alias("f2")).distinct()
            yield self._result(s, focus.select(F.col("t").alias("focus")).join(with_it, F.col("focus") == F.col("f2"), "left_anti"), "HasValue", False)
        for x in s.get("equals"):
            other = path_values(x).join(focus, F.col("f2") == F.col("t"), "left_semi")
            on = (F.col("focus") == F.col("f2")) & (v == F.col("v2"))
            missing = other.join(values, on, "left_anti").select(F.col("f2").alias("focus"), F.col("v2").alias("value"))
            yield self._result(s, values.join(other, on, "left_anti").unionByName(missing), "Equals")
        for x in s.get("disjoint"):
            yield self._result(s, values.join(path_values(x), (F.col("focus") == F.col("f2")) & (v == F.col("v2")), "left_semi"), "Disjoint")
        for name, op in (("lessThan", "<"), ("lessThanOrEquals", "<=")):
            for x in s.get(name):
                pairs = values.join(path_values(x), F.col("focus") == F.col("f2"))
                wrong = pairs.where(~F.coalesce(compare(op, Val("term", v), Val("term", F.col("v2"))), F.lit(False)))
                yield self._result(s, wrong.select("focus", "value").distinct(), name[0].upper() + name[1:])
        yield from self._logic(s, focus, values)
        if any(x.v in ("true", "1") for x in s.get("closed")):
            allowed = {self.shapes.shape(p).path.args[0] for p in s.get("property") if self.shapes.shape(p).path and self.shapes.shape(p).path.op == "iri"}
            for x in s.get("ignoredProperties"):
                allowed |= {t.v for t in self.shapes.list_(x)}
            extra = self.data.where(~F.col("p").isin(sorted(allowed)) if allowed else F.lit(True)).join(values, F.col("s") == v, "left_semi")
            yield self._result(s, extra.select(F.col("s").alias("focus"), F.col("o").alias("value"), F.col("p").alias("by")), "Closed", path=F.col("by"))

    def _logic(self, s: Shape, focus: DataFrame, values: DataFrame):
        v = F.col("value")
        nodes = values.select(v.alias("t")).distinct()
        fails = lambda t: self.failing(t, nodes)
        hit = lambda bad: values.join(bad, v == F.col("t"), "left_semi")
        for x in s.get("node"):
            yield self._result(s, hit(fails(x)), "Node")
        for x in s.get("not"):
            yield self._result(s, values.join(fails(x), v == F.col("t"), "left_anti"), "Not")
        for x in s.get("and"):
            yield self._result(s, hit(reduce(DataFrame.unionByName, [fails(t) for t in self.shapes.list_(x)]).distinct()), "And")
        for name in ("or", "xone"):
            for x in s.get(name):
                options = self.shapes.list_(x)
                counted = reduce(DataFrame.unionByName, [fails(t) for t in options]).groupBy("t").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("t", "t2")
                passed = values.join(counted, v == F.col("t2"), "left").withColumn("ok", F.lit(len(options)) - F.coalesce("n", F.lit(0)))
                yield self._result(s, passed.where("ok = 0" if name == "or" else "ok <> 1"), "Or" if name == "or" else "Xone")
        for x in s.get("property"):
            yield self.check(self.shapes.shape(x), nodes)
        for x in s.get("qualifiedValueShape"):
            good = values.join(fails(x), v == F.col("t"), "left_anti")
            n = focus.select(F.col("t").alias("focus")).join(good.groupBy(F.col("focus").alias("f2")).agg(F.count(F.lit(1)).alias("n")), F.col("focus") == F.col("f2"), "left")
            k = F.coalesce(F.col("n"), F.lit(0))
            for m in s.get("qualifiedMinCount"):
                yield self._result(s, n.where(k < int(m.v)), "QualifiedMinCount", False)
            for m in s.get("qualifiedMaxCount"):
                yield self._result(s, n.where(k > int(m.v)), "QualifiedMaxCount", False)


def validate_shapes(spark: SparkSession, data: DataFrame, shapes: DataFrame) -> DataFrame:
    """The report: one row per result, none where the data conform."""
    return Validator(spark, data, shapes).report()


def conforms(spark: SparkSession, data: DataFrame, shapes: DataFrame) -> bool:
    return validate_shapes(spark, data, shapes).limit(1).isEmpty()


def conforming(spark: SparkSession, data: DataFrame, shapes: DataFrame) -> DataFrame:
    """(t): the focus nodes without a result."""
    v = Validator(spark, data, shapes)
    roots = v.shapes.roots()
    focus = reduce(DataFrame.unionByName, [v.targets(s) for s in roots]).distinct()
    return focus.join(v.report(), F.col("t") == F.col("focus"), "left_anti")


def report_prompt(report: DataFrame, max_results: int = 20) -> str:
    """The first results as text, with the number of all."""
    n = report.count()
    rows = report.select(nt_text(F.col("focus")).alias("f"), "path", nt_text(F.col("value")).alias("v"), "component", "severity", "message").orderBy("f", "path", "component").limit(max_results).collect()
    lines = [f"{n} results" if n else "conforms"]
    lines += [f"- {r['severity']}: {r['f']} {r['path'] or ''} {r['v'] or ''} {r['component']}: {r['message']}" for r in rows]
    return "\n".join(lines)
