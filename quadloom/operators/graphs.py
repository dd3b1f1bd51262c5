"""Operations on whole graphs: set operations, blank nodes, isomorphism, projections to edge lists and integer ids."""

from __future__ import annotations

from functools import reduce
from itertools import count
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadloom.session import cut
from quadloom.terms import BNODE, IRI, TERM, Term, term_col

GENID = "http://quadloom.example/.well-known/genid/"


def relabel(triples: DataFrame, scope: str) -> DataFrame:
    """Blank node labels under a scope, so that graphs can be merged without confusing them."""

    def one(t: Column) -> Column:
        return F.when(t["k"] == BNODE, t.withField("v", F.concat(F.lit(f"{scope}_"), t["v"]))).otherwise(t)

    return triples.withColumns({"s": one(F.col("s")), "o": one(F.col("o"))})


def union(a: DataFrame, b: DataFrame, rename: bool = True) -> DataFrame:
    """Set union; b's blank nodes are kept apart from a's unless rename is off."""
    cols = ["s", "p", "o"]
    return a.select(*cols).unionByName((relabel(b, "u") if rename else b).select(*cols)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("s", "p", "o").intersect(b.select("s", "p", "o"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("s", "p", "o").subtract(b.select("s", "p", "o"))


def is_subgraph(a: DataFrame, b: DataFrame) -> bool:
    return difference(a, b).limit(1).isEmpty()


def equal(a: DataFrame, b: DataFrame) -> bool:
    return is_subgraph(a, b) and is_subgraph(b, a)


def blank_nodes(triples: DataFrame) -> DataFrame:
    """(t): the distinct blank nodes."""
    return triples.select(F.explode(F.array("s", "o")).alias("t")).where(F.col("t.k") == BNODE).distinct()


def skolemize(triples: DataFrame, base: str = GENID) -> DataFrame:
    def one(t: Column) -> Column:
        return F.when(t["k"] == BNODE, term_col(IRI, F.concat(F.lit(base), t["v"]))).otherwise(t)

    return triples.withColumns({"s": one(F.col("s")), "o": one(F.col("o"))})


def deskolemize(triples: DataFrame, base: str = GENID) -> DataFrame:
    def one(t: Column) -> Column:
        return F.when((t["k"] == IRI) & t["v"].startswith(base), term_col(BNODE, F.substr(t["v"], F.lit(len(base) + 1)))).otherwise(t)

    return triples.withColumns({"s": one(F.col("s")), "o": one(F.col("o"))})


def _blank(c: str) -> Column:
    return F.coalesce(F.col(f"{c}.k") == BNODE, F.lit(False))


def _colours(rows: DataFrame, cols: tuple[str, ...], fixed: dict[str, str] | None = None) -> DataFrame:
    """(v, c): a colour per blank node in cols, refined by the colours around it until the number of colours no longer grows."""
    start = F.lit("b")
    for label, c in (fixed or {}).items():
        start = F.when(F.col("v") == label, c).otherwise(start)
    nodes = rows.select(F.explode(F.array(*[F.when(_blank(c), F.col(c)["v"]) for c in cols])).alias("v")).where("v is not null").distinct()
    colours = cut(nodes.select("v", F.sha2(start, 256).alias("c")))
    near = rows.where(reduce(or_, map(_blank, cols)))
    n = -1

    while True:
        seen = near
        for c in cols:
            seen = seen.join(colours.select(F.col("v").alias(f"v{c}"), F.col("c").alias(f"c{c}")), _blank(c) & (F.col(c)["v"] == F.col(f"v{c}")), "left")

        def signature(c: str) -> Column:
            what = lambda x: F.when(_blank(x), F.concat(F.lit("_:"), F.col(f"c{x}"), F.when(F.col(x)["v"] == F.col(c)["v"], "!").otherwise(""))).otherwise(F.coalesce(F.col(x).cast("string"), F.lit("-")))
            return F.struct(F.when(_blank(c), F.col(c)["v"]).alias("v"), F.sha2(F.concat_ws("|", F.lit(c), "p", *[what(x) for x in cols if x != c]), 256).alias("sig"))

        around = seen.select(F.explode(F.array(*[signature(c) for c in cols])).alias("x")).select("x.v", "x.sig").where("v is not null")
        # a sum of hashes stands for the multiset of neighbours: it combines before the shuffle and holds no list
        num = lambda i: F.conv(F.substr("sig", F.lit(i), F.lit(12)), 16, 10).cast("decimal(20,0)")
        sums = around.groupBy("v").agg(*[F.sum(num(i)).alias(f"h{i}") for i in (1, 13, 25, 37)])
        colours = cut(colours.join(sums, "v", "left").select("v", F.sha2(F.concat_ws("|", "c", *[F.coalesce(F.col(f"h{i}").cast("string"), F.lit("-")) for i in (1, 13, 25, 37)]), 256).alias("c")))
        m = colours.select("c").distinct().count()
        if m == n:
            return colours
        n = m


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """Equal up to a renaming of blank nodes: equal ground statements and equal colours. Equal-coloured nodes that share no statement with another such node
    can stand for each other; others are told apart one by one."""
    return _isomorphic(a.select("s", "p", "o"), b.select("s", "p", "o"), ("s", "o"))


def isomorphic_datasets(a: DataFrame, b: DataFrame) -> bool:
    """isomorphic for (g, s, p, o), whose graph names may be blank nodes too."""
    return _isomorphic(a.select("g", "s", "p", "o"), b.select("g", "s", "p", "o"), ("g", "s", "o"))


def _same(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def _isomorphic(a: DataFrame, b: DataFrame, cols: tuple[str, ...]) -> bool:
    a, b = cut(a.distinct()), cut(b.distinct())
    if a.count() != b.count():
        return False
    ground = lambda x: x.where(~reduce(or_, map(_blank, cols)))
    return _same(ground(a), ground(b)) and _match(a, b, cols, {}, {})


def _numbered(rows: DataFrame, cols: tuple[str, ...], colours: DataFrame) -> DataFrame:
    """colours, in which nodes of one colour that share no statement with a node of such a colour are numbered: all that is said of them is the same."""
    tied = colours.join(colours.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "c").select("v")
    shared = rows.select(F.array_distinct(F.filter(F.array(*[F.when(_blank(c), F.col(c)["v"]) for c in cols]), lambda v: v.isNotNull())).alias("vs")).where("size(vs) > 1").distinct()
    linked = shared.select("vs", F.explode("vs").alias("v")).join(tied, "v").groupBy("vs").agg(F.collect_list("v").alias("x")).where("size(x) > 1").select(F.explode("x").alias("v")).distinct()  # a statement's nodes
    flagged = colours.join(linked.withColumn("linked", F.lit(True)), "v", "left")
    number = F.row_number().over(W.partitionBy("c", "linked").orderBy("v"))
    return cut(flagged.select("v", F.when(F.col("linked"), F.col("c")).otherwise(F.concat("c", F.lit("#"), number)).alias("c")))


def _match(a: DataFrame, b: DataFrame, cols: tuple[str, ...], fa: dict[str, str], fb: dict[str, str]) -> bool:
    ca, cb = _colours(a, cols, fa), _colours(b, cols, fb)
    sizes = lambda c: c.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    if not _same(sizes(ca), sizes(cb)):
        return False
    ca, cb = _numbered(a, cols, ca), _numbered(b, cols, cb)
    tied = sizes(ca).where("n > 1").orderBy("n", "c").first()
    if tied is None:

        def renamed(g: DataFrame, c: DataFrame) -> DataFrame:
            names = g.columns
            for col in cols:
                m = c.select(F.col("v").alias(f"v{col}"), F.col("c").alias(f"c{col}"))
                t = F.col(col)
                g = g.join(m, _blank(col) & (t["v"] == F.col(f"v{col}")), "left").withColumn(col, F.when(_blank(col), t.withField("v", F.col(f"c{col}"))).otherwise(t))
            return g.select(*names)

        return _same(renamed(a, ca), renamed(b, cb))
    one = ca.where(F.col("c") == tied["c"]).orderBy("v").first()["v"]
    mark = f"m{len(fa)}"
    for r in cb.where(F.col("c") == tied["c"]).orderBy("v").toLocalIterator():
        if _match(a, b, cols, fa | {one: mark}, fb | {r["v"]: mark}):
            return True
    return False


# projections


def edges(triples: DataFrame, predicate: str | None = None, weight: Column | None = None) -> DataFrame:
    """(src, dst[, weight]) of distinct edges between resources; weight is an expression over o or p."""
    df = triples.where(F.col("o.k").isin(IRI, BNODE))
    if predicate is not None:
        df = df.where(F.col("p") == predicate)
    cols = [F.col("s").alias("src"), F.col("o").alias("dst")]
    return df.select(*cols, weight.alias("weight")).distinct() if weight is not None else df.select(*cols).distinct()


def weighted_edges(triples: DataFrame, predicate: str, weights: DataFrame) -> DataFrame:
    """Edges of a predicate with the weight that a table (src, dst, weight) gives them, 1.0 where it has none."""
    w = weights.select(F.col("src").alias("s2"), F.col("dst").alias("d2"), "weight")
    return edges(triples, predicate).join(w, (F.col("src") == F.col("s2")) & (F.col("dst") == F.col("d2")), "left").select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def index_terms(terms: DataFrame, column: str = "t") -> DataFrame:
    """(id, t): ids 1..N in the order of the terms, numbered by partition counts so that no task sees them all."""
    distinct = terms.select(F.col(column).alias("t")).where("t is not null").distinct()
    placed = cut(distinct.withColumn("part", F.pmod(F.xxhash64("t"), F.lit(256))))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # 256 rows
    starts = sizes.select("part", before.alias("start"))
    return placed.join(F.broadcast(starts), "part").select((F.col("start") + F.row_number().over(W.partitionBy("part").orderBy("t"))).alias("id"), "t")


def indexed_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(s, p, o) as ids, with the tables (id, t) of nodes and (id, t) of predicates."""
    nodes = index_terms(triples.select(F.explode(F.array("s", "o")).alias("t")))
    predicates = index_terms(triples.select(F.col("p").alias("t")))
    out = triples.select("s", "p", "o")
    for c, names in (("s", nodes), ("o", nodes), ("p", predicates)):
        out = out.join(names.select(F.col("id").alias(f"{c}_id"), F.col("t").alias(f"{c}_t")), F.col(c) == F.col(f"{c}_t")).drop(f"{c}_t")
    return out.select("s_id", "p_id", "o_id"), nodes, predicates


def match_ids(ids: DataFrame, s: int | None = None, p: int | None = None, o: int | None = None) -> DataFrame:
    """The rows of (s_id, p_id, o_id) that fit the given ids; None is a wildcard, and 0, the id of no term, fits nothing."""
    for c, x in (("s_id", s), ("p_id", p), ("o_id", o)):
        if x is not None:
            ids = ids.where(F.col(c) == x)
    return ids


def each_id(ids: DataFrame) -> DataFrame:
    """All rows of (s_id, p_id, o_id) in the order of subject, predicate and object."""
    return ids.orderBy("s_id", "p_id", "o_id")


def id_of(terms: DataFrame, t: Term | str) -> int:
    """The id of a term (an IRI's text in the table of predicates), or 0 where there is none."""
    from quadloom.store import equals

    row = terms.where(F.col("t") == t if isinstance(t, str) else equals(F.col("t"), t)).select("id").first()
    return row[0] if row else 0


def edge_predicates(triples: DataFrame) -> DataFrame:
    """(src, dst, predicates) of each pair of connected resources."""
    return triples.where(F.col("o.k").isin(IRI, BNODE)).groupBy(F.col("s").alias("src"), F.col("o").alias("dst")).agg(F.array_sort(F.collect_set("p")).alias("predicates"))


def degrees(triples: DataFrame) -> DataFrame:
    """(t, degree): statements a resource takes part in as subject or object."""
    ends = triples.select(F.explode(F.array("s", "o")).alias("t")).where(F.col("t.k").isin(IRI, BNODE))
    return ends.groupBy("t").agg(F.count(F.lit(1)).alias("degree"))


def components(pairs: DataFrame) -> DataFrame:
    """(v, component) of (src, dst): the smallest node reachable, by label propagation with pointer jumping; each round is checkpointed."""
    both = cut(pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(both.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("m")).select("v", F.least("v", "m").alias("c")))
    while True:
        near = both.join(label.select(F.col("v").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("v")).agg(F.min("c").alias("n"))
        new = label.join(near, "v").select("v", F.least("c", "n").alias("c"), F.col("c").alias("old"))
        jump = label.select(F.col("v").alias("c"), F.col("c").alias("j"))
        new = cut(new.join(jump, "c", "left").select("v", F.least("c", F.coalesce("j", "c")).alias("c"), "old"))
        if new.where("c <> old").limit(1).isEmpty():
            return new.select("v", F.col("c").alias("component"))
        label = new.select("v", "c")


def pagerank(pairs: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(v, rank) of a directed edge list; nodes without out-edges share their rank among all. With a tolerance, as many rounds as it takes until the
    ranks of one differ from those before by no more than that in sum."""
    e = cut(pairs.select("src", "dst").distinct())
    nodes = cut(e.select("src").union(e.select("dst")).distinct().withColumnRenamed("src", "v"))
    n = nodes.count()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    links = cut(e.join(out, "src"))
    for _ in range(rounds) if tolerance is None else count():
        sent = links.join(rank, F.col("src") == F.col("v")).groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("rank") / F.col("d")).alias("got"))
        loose = rank.join(out, F.col("v") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        rank = cut(rank.withColumnRenamed("rank", "old").join(sent, "v", "left").select("v", "old", (F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
        moved = F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0))
        if tolerance is not None and rank.agg(moved).first()[0] <= tolerance:
            break
        rank = rank.drop("old")
    return rank.select("v", "rank")


# annotations

REIFIES = "http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies"


def annotate(triples: DataFrame, s: Term, p: Term, o: Term, predicate: str, value: Term) -> DataFrame:
    """triples with a statement about a statement; its reifier is reused if it has one, else named after the statement."""
    import hashlib

    text = f"<<( {s.nt()} {p.nt()} {o.nt()} )>>"
    found = triples.where((F.col("p") == REIFIES) & (F.col("o.v") == text)).select("s").limit(1).collect()
    r = Term(*found[0]["s"]) if found else Term(BNODE, "r" + hashlib.sha1(text.encode()).hexdigest())
    spark = triples.sparkSession
    rows = spark.range(1).select(F.explode(F.array(
        F.struct(r.col().cast(TERM).alias("s"), F.lit(REIFIES).alias("p"), Term(3, text).col().cast(TERM).alias("o")),
        F.struct(r.col().cast(TERM).alias("s"), F.lit(predicate).alias("p"), value.col().cast(TERM).alias("o")),
    )).alias("x")).select("x.s", "x.p", "x.o")
    return triples.select("s", "p", "o").unionByName(rows).distinct()


def annotations(triples: DataFrame, s: Term, p: Term, o: Term) -> DataFrame:
    """(p, o) of all statements about a statement."""
    text = f"<<( {s.nt()} {p.nt()} {o.nt()} )>>"
    r = triples.where((F.col("p") == REIFIES) & (F.col("o.v") == text)).select(F.col("s").alias("r"))
    return triples.where(F.col("p") != REIFIES).join(r, F.col("s") == F.col("r")).select("p", "o")
