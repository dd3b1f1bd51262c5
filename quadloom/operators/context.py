"""Retrieval helpers: neighbourhoods, descriptions, embedding search, and context under a budget."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quadloom.operators.graphs import REIFIES, degrees
from quadloom.session import cut
from quadloom.sources.turtle import header, subject_blocks
from quadloom.terms import BNODE, IRI, LITERAL, RDF, TRIPLE, nt_text

TYPE = RDF + "type"


def concise_description(triples: DataFrame, nodes: DataFrame, annotations: bool = False) -> DataFrame:
    """The statements of the nodes (t) and, through blank objects, of what describes them; with statements about those statements if asked."""
    found, frontier = [], cut(nodes.select("t").distinct())
    seen = frontier
    while not frontier.isEmpty():
        got = triples.join(frontier, F.col("s") == F.col("t"), "left_semi")
        found.append(got)
        nxt = got.where(F.col("o.k") == BNODE).select(F.col("o").alias("t")).distinct()
        frontier = cut(nxt.join(seen.withColumnRenamed("t", "t2"), F.col("t") == F.col("t2"), "left_anti"))
        seen = seen.unionByName(frontier)
    out = reduce(DataFrame.unionByName, found).distinct() if found else triples.limit(0)
    if annotations:
        text = F.concat(F.lit("<<( "), nt_text(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), nt_text(F.col("o")), F.lit(" )>>"))
        about = triples.where((F.col("p") == REIFIES) & (F.col("o.k") == TRIPLE)).join(out.select(text.alias("x")), F.col("o.v") == F.col("x"), "left_semi")
        out = out.unionByName(triples.join(about.select(F.col("s").alias("r")), F.col("s") == F.col("r"), "left_semi")).distinct()
    return out


def ego_graph(triples: DataFrame, seeds: DataFrame, hops: int = 1, through_types: bool = False) -> DataFrame:
    """The statements within a number of hops of the seeds (t), followed in both directions; types are not followed unless asked."""
    frontier = cut(seeds.select("t").distinct())
    seen, found = frontier, []
    links = triples if through_types else triples.where(F.col("p") != TYPE)
    for _ in range(hops):
        f = frontier.withColumnRenamed("t", "f")
        out, into = triples.join(f, F.col("s") == F.col("f"), "left_semi"), links.join(f, F.col("o") == F.col("f"), "left_semi")
        found += [out, into]
        ends = links.join(f, F.col("s") == F.col("f"), "left_semi").where(F.col("o.k") != LITERAL).select(F.col("o").alias("t")).unionByName(into.select(F.col("s").alias("t"))).distinct()
        frontier = cut(ends.join(seen.withColumnRenamed("t", "t2"), F.col("t") == F.col("t2"), "left_anti"))
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, found).distinct() if found else triples.limit(0)


def to_context(triples: DataFrame, budget: int, prefixes: dict[str, str] | None = None) -> str:
    """Turtle text of whole subject blocks, best connected subjects first, in at most 4 * budget bytes.

    Only blocks that can still matter reach the driver: they are read in order until the budget is full.
    """
    blocks = subject_blocks(triples, prefixes)
    ranked = blocks.join(degrees(triples), F.col("s") == F.col("t")).where(F.octet_length("text") <= 4 * budget)
    out, room = [header(prefixes or {})], 4 * budget - len(header(prefixes or {}).encode())
    smallest = ranked.agg(F.min(F.octet_length("text"))).first()[0]
    for r in ranked.orderBy(F.desc("degree"), F.col("s.v")).select("text").toLocalIterator():
        size = len(r["text"].encode()) + 1
        if size <= room:
            out.append(r["text"] + "\n")
            room -= size
        if smallest is None or room <= smallest:
            break
    return "".join(out)


class EmbeddingIndex:
    """Unit vectors by key: a table (key, vector ARRAY<FLOAT>)."""

    def __init__(self, df: DataFrame, key: str = "key", vector: str = "vector"):
        v = F.col(vector).cast("array<double>")
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        self.df = df.select(F.col(key).alias("key"), v.alias("v"), norm.alias("n")).where("v is not null and n > 0").select("key", F.transform("v", lambda x: x / F.col("n")).alias("vector"))

    def add(self, df: DataFrame, key: str = "key", vector: str = "vector") -> EmbeddingIndex:
        """The index with new vectors, which replace old ones of the same key."""
        new = EmbeddingIndex(df, key, vector)
        out = EmbeddingIndex.__new__(EmbeddingIndex)
        out.df = self.df.join(new.df.select("key"), "key", "left_anti").unionByName(new.df)
        return out

    def knn(self, query: list[float], k: int) -> DataFrame:
        """(key, score): the k nearest by cosine, ties by key; all vectors are compared in the JVM and only k rows survive each task."""
        q = np.asarray(query, float)
        q = q / max(float(np.linalg.norm(q)), 1e-300)
        lit = F.array(*[F.lit(float(x)) for x in q])
        score = F.aggregate(F.zip_with("vector", lit, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return self.df.select("key", score.alias("score")).orderBy(F.desc("score"), "key").limit(k)

    def knn_join(self, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
        """(query, key, score): the k nearest of every query (key, vector), as matrix products of query blocks against partitions of the index.

        Queries form blocks of bounded size; each task keeps the best k of a block, and the partial bests are merged per query.
        """
        parts = lambda df: F.pmod(F.xxhash64("key"), F.lit(max(1, -(-df.count() // block))))
        boxed = lambda df, n, name: df.withColumn("b", parts(df)).groupBy(F.col("b").alias(n)).agg(F.collect_list(F.struct("key", "vector")).alias(name))
        # both sides in blocks of about `block` rows, so that a task holds two of them
        pairs = boxed(self.df, "xb", "xs").crossJoin(boxed(EmbeddingIndex(queries).df, "qb", "qs"))
        key = self.df.schema["key"].dataType.simpleString()

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for xs, qs in zip(batch["xs"], batch["qs"], strict=True):
                    xs = sorted(xs, key=lambda x: x["key"])
                    scores = np.array([list(x["vector"]) for x in qs]) @ np.array([list(x["vector"]) for x in xs]).T
                    rows = []
                    for i, x in enumerate(qs):
                        order = np.argsort(-scores[i], kind="stable")[:k]
                        rows += [(x["key"], xs[j]["key"], float(scores[i, j])) for j in order]
                    yield pd.DataFrame(rows, columns=["query", "key", "score"])

        from pyspark.sql import Window as W

        part = pairs.select("xs", "qs").mapInPandas(best, f"query {key}, key {key}, score double")
        n = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))
        return part.withColumn("rank", n).where(F.col("rank") <= k).drop("rank")


def retrieve(triples: DataFrame, index: EmbeddingIndex, query: list[float], k: int = 5, hops: int = 1, budget: int = 1000, prefixes: dict[str, str] | None = None) -> str:
    """Context around the resources nearest to a query vector; the index's keys are IRIs."""
    from quadloom.terms import TERM, term_col

    seeds = index.knn(query, k).select(term_col(IRI, F.col("key").cast("string")).cast(TERM).alias("t"))
    return to_context(ego_graph(triples, seeds, hops), budget, prefixes)


# schema summary


def describe_schema(triples: DataFrame) -> dict[str, DataFrame]:
    """classes (class, instances), properties (p, statements, subjects, objects, datatypes, multi, functional), and uses (class, p, n)."""
    types = triples.where((F.col("p") == TYPE) & (F.col("o.k") == IRI)).select("s", F.col("o.v").alias("class")).distinct()
    classes = types.groupBy("class").agg(F.count(F.lit(1)).alias("instances"))
    per = triples.groupBy("p", "s").agg(F.count(F.lit(1)).alias("n"))
    shape = per.groupBy("p").agg(F.sum("n").alias("statements"), F.count(F.lit(1)).alias("subjects"), F.max("n").alias("most"))
    kinds = F.when(F.col("o.k") == LITERAL, F.col("o.dt")).when(F.col("o.k") == IRI, "iri").otherwise("bnode")
    objects = triples.select("p", kinds.alias("kind")).distinct().groupBy("p").agg(F.array_sort(F.collect_set("kind")).alias("datatypes"))
    ndv = triples.select("p", "o").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("objects"))
    properties = shape.join(objects, "p").join(ndv, "p").select("p", "statements", "subjects", "objects", "datatypes", (F.col("most") > 1).alias("multi"))
    uses = triples.select("s", "p").distinct().join(types, "s").groupBy("class", "p").agg(F.count(F.lit(1)).alias("n"))
    return {"classes": classes, "properties": properties, "uses": uses}


def schema_prompt(schema: dict[str, DataFrame], budget: int = 500, prefixes: dict[str, str] | None = None) -> str:
    """A text of the schema in at most 4 * budget characters, most used classes and properties first."""
    short = lambda x: next((f"{k}:{x[len(v) :]}" for k, v in (prefixes or {}).items() if x.startswith(v)), f"<{x}>")
    lines, room = [], 4 * budget
    for kind, order in (("classes", "instances"), ("properties", "statements")):
        lines.append(f"# {kind}")
        for r in schema[kind].orderBy(F.desc(order), F.col(schema[kind].columns[0])).toLocalIterator():
            text = f"{short(r['class'])} ({r['instances']})" if kind == "classes" else f"{short(r['p'])} ({r['statements']}) -> {', '.join(r['datatypes'])}{' *' if r['multi'] else ''}"
            if sum(map(len, lines)) + len(lines) + len(text) > room:
                break
            lines.append(text)
    return "\n".join(lines)
