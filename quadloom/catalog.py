"""The driver's relational tables as a virtual graph, and its quads table as a stored one."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quadloom.engine import Engine
from quadloom.session import table
from quadloom.store import MappedStore, QuadStore, TableMap

BASE = "http://data.example/"
PREFIXES = {"": f"{BASE}v#", "d": BASE, "parl": "parl:"}


def _v(**props: tuple) -> dict[str, tuple]:
    return {f"{BASE}v#{k}": v for k, v in props.items()}


def _maps(spark: SparkSession, d: str) -> list[TableMap]:
    lit = lambda c, kind="str": ("lit", c, kind)
    ref = lambda c, to: ("ref", c, f"{BASE}{to}/")
    big = lambda c: ("lit", f"cast({c} as bigint)", "int")

    def one(name: str, key: str, cls: str, path: str, /, **props: tuple) -> TableMap:
        return TableMap(name, lambda: table(spark, d, name), f"{BASE}{path}/", key, f"{BASE}v#{cls}", _v(**props))

    return [
        one("region", "r_regionkey", "Region", "region", name=lit("r_name")),
        one("nation", "n_nationkey", "Nation", "nation", name=lit("n_name"), region=ref("n_regionkey", "region")),
        one("customer", "c_custkey", "Customer", "customer", name=lit("c_name"), nation=ref("c_nationkey", "nation"), balance=lit("c_acctbal", "dbl"), segment=lit("c_mktsegment")),
        one("supplier", "s_suppkey", "Supplier", "supplier", name=lit("s_name"), nation=ref("s_nationkey", "nation"), balance=lit("s_acctbal", "dbl")),
        one("part", "p_partkey", "Part", "part", name=lit("p_name"), brand=lit("p_brand"), partType=lit("p_type"), size=big("p_size"), price=lit("p_retailprice", "dbl")),
        one("orders", "o_orderkey", "Order", "order", customer=ref("o_custkey", "customer"), status=lit("o_orderstatus"), total=lit("o_totalprice", "dbl"), date=lit("o_orderdate", "time"), priority=lit("o_orderpriority")),
        # (l_orderkey, l_linenumber) is not unique: the row's place in its file names it
        one("lineitem", "concat(_metadata.file_name, '-', _metadata.row_index)", "LineItem", "lineitem", order=ref("l_orderkey", "order"), part=ref("l_partkey", "part"), supplier=ref("l_suppkey", "supplier"), lineNumber=big("l_linenumber"), quantity=lit("l_quantity", "dbl"), extendedPrice=lit("l_extendedprice", "dbl"), discount=lit("l_discount", "dbl"), tax=lit("l_tax", "dbl"), returnFlag=lit("l_returnflag"), lineStatus=lit("l_linestatus"), shipDate=lit("l_shipdate", "time")),
        one("events", "event_id", "Event", "event", user=ref("user_id", "user"), at=lit("ts", "time"), eventType=lit("event_type"), value=lit("value", "dbl")),
        one("documents", "doc_id", "Document", "doc", source=lit("source"), chars=lit("n_chars", "int"), party=lit("party"), agenda=lit("agenda_item"), reissueOf=ref("reissue_of", "doc")),
    ]


_STORES: dict[tuple[str, str], MappedStore] = {}


def mapped_engine(spark: SparkSession, d: str) -> Engine:
    """Queries over the relational tables, which are opened once in an application."""
    key = spark.sparkContext.applicationId, d
    if key not in _STORES:
        _STORES[key] = MappedStore(_maps(spark, d))
    return Engine(spark, _STORES[key], BASE, PREFIXES)


def quad_store(spark: SparkSession, d: str) -> QuadStore:
    return QuadStore(table(spark, d, "quads").select("g", "s", "p", "o"), short=True)


def quad_engine(spark: SparkSession, d: str) -> Engine:
    """Queries over the quads; vocabulary IRIs stand in the table in short form."""
    return Engine(spark, quad_store(spark, d), BASE, PREFIXES | {"p": "http://parl.example/"})


