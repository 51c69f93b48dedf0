"""The driver's Parquet tables as a graph: a table is a class, a column a property."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dataset import ClassTable, Dataset
from ..ontology import ClassDef, Ontology, PropertyDef
from ..terms import DATETIME, DOUBLE, INTEGER, STRING, T
from ..vocab import DATA, RDFS, XSD

BASE = "http://data/"
GRAPHS = BASE + "graph/"
RESOURCE = RDFS + "Resource"
_CLASSES = {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "order", "LineItem": "lineitem", "Event": "event", "Document": "document", "Label": "label", "Turn": "turn", "Page": "page", "BenchmarkItem": "item", "Embedding": "vector"}


def key(name: str) -> T:
    return T("key", f"{BASE}{_CLASSES[name]}/", "string" if name == "Turn" else "bigint")


#: table: (class, key expression, {property: (expression, type)}, graph expression)
MAPPING: dict[str, tuple] = {
    "region": ("Region", "r_regionkey", {"name": ("r_name", STRING)}, None),
    "nation": ("Nation", "n_nationkey", {"name": ("n_name", STRING), "region": ("n_regionkey", key("Region"))}, None),
    "customer": ("Customer", "c_custkey", {"name": ("c_name", STRING), "nation": ("c_nationkey", key("Nation")), "acctbal": ("c_acctbal", DOUBLE), "mktsegment": ("c_mktsegment", STRING)}, None),
    "supplier": ("Supplier", "s_suppkey", {"name": ("s_name", STRING), "nation": ("s_nationkey", key("Nation")), "acctbal": ("s_acctbal", DOUBLE)}, None),
    "part": ("Part", "p_partkey", {"name": ("p_name", STRING), "brand": ("p_brand", STRING), "ptype": ("p_type", STRING), "size": ("cast(p_size as bigint)", INTEGER), "retailprice": ("p_retailprice", DOUBLE)}, None),
    "orders": ("Order", "o_orderkey", {"customer": ("o_custkey", key("Customer")), "orderstatus": ("o_orderstatus", STRING), "totalprice": ("o_totalprice", DOUBLE), "orderdate": ("@o_orderdate", DATETIME), "orderpriority": ("o_orderpriority", STRING)}, None),
    "lineitem": ("LineItem", None, {"order": ("l_orderkey", key("Order")), "part": ("l_partkey", key("Part")), "supplier": ("l_suppkey", key("Supplier")), "linenumber": ("cast(l_linenumber as bigint)", INTEGER), "quantity": ("l_quantity", DOUBLE), "extendedprice": ("l_extendedprice", DOUBLE), "discount": ("l_discount", DOUBLE), "tax": ("l_tax", DOUBLE), "returnflag": ("l_returnflag", STRING), "linestatus": ("l_linestatus", STRING), "shipdate": ("@l_shipdate", DATETIME)}, None),
    "events": ("Event", "event_id", {"time": ("@ts", DATETIME), "user": ("user_id", key("Customer")), "eventType": ("event_type", STRING), "value": ("value", DOUBLE), "props": ("props", STRING)}, None),
    "documents": ("Document", "doc_id", {"text": ("text", STRING), "lang": ("lang", STRING), "source": ("source", STRING), "nChars": ("n_chars", INTEGER)}, f"concat('{GRAPHS}', source)"),
    "labels": ("Label", "doc_id", {"document": ("doc_id", key("Document")), "quality": ("cast(quality as bigint)", INTEGER), "toxic": ("cast(toxic as bigint)", INTEGER)}, None),
    "conversations": ("Turn", "concat(conv_id, '-', turn)", {"conversation": ("conv_id", INTEGER), "turnNumber": ("turn", INTEGER), "role": ("role", STRING), "content": ("text", STRING), "next": ("next_key", key("Turn"))}, None),
    "pages": ("Page", "page_id", {"url": ("url", STRING), "html": ("html", STRING)}, None),
    "benchmark": ("BenchmarkItem", "item_id", {"content": ("text", STRING)}, None),
    "embeddings": ("Embedding", "vec_id", {"cluster": ("cast(label as bigint)", INTEGER)}, None),
}
_RANGES = {STRING: "string", INTEGER: "integer", DOUBLE: "double", DATETIME: "dateTime"}


def ontology() -> Ontology:
    classes = [ClassDef(DATA + "Agent", (RESOURCE,))]
    classes += [ClassDef(DATA + c, (DATA + "Agent",) if c in ("Customer", "Supplier") else (RESOURCE,), notify=c in ("Customer", "Order")) for c in _CLASSES]
    properties = {}
    for cls, _, columns, _ in MAPPING.values():
        for p, (_, t) in columns.items():
            rng = XSD + _RANGES[t] if t in _RANGES else DATA + next(c for c, path in _CLASSES.items() if t.prefix == f"{BASE}{path}/")
            seen = properties.get(p)
            properties[p] = PropertyDef(DATA + p, RESOURCE if seen and seen.domain != DATA + cls else DATA + cls, rng, single=True, parents=(RDFS + "label",) if p == "name" else (), fulltext=p in ("text", "content"), weight=2.0 if p == "content" else 1.0)
    return Ontology.of(classes, properties.values())


def dataset(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> Dataset:
    """The tables under ``sf_dir``; timestamps become (UTC, offset) structs in the plan."""
    tables = []
    for name, (cls, k, columns, graph) in MAPPING.items():
        if names is not None and name not in names:
            continue
        df: DataFrame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "conversations":
            at = Window.partitionBy("conv_id").orderBy("turn")
            df = df.withColumn("next_key", F.when(F.lead("turn").over(at) == F.col("turn") + 1, F.concat("conv_id", F.lit("-"), F.lead("turn").over(at))))
        own = {DATA + p: (f"if({e[1:]} is null, null, named_struct('ts', cast({e[1:]} as timestamp_ntz), 'off', 0))" if e[0] == "@" else e, t) for p, (e, t) in columns.items()}
        tables.append(ClassTable(DATA + cls, df, f"{BASE}{_CLASSES[cls]}/", k, own, graph))
    return Dataset(spark, ontology(), tuple(tables))
