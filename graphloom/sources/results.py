"""Result documents in the standard JSON and XML forms, written and read.

A document is a text on the driver, or lies in a folder: the lines of its files
in the order of their paths, a row a line, written and read where the rows are.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParseError
from ..vocab import XSD

_NS = "http://www.w3.org/2005/sparql-results#"
_XML_TEXT = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;"), ("\r", "&#13;"))
_JSON_TAIL = "]}}"
_KINDS = {"bigint": "integer", "int": "integer", "double": "double", "boolean": "boolean", "date": "date"}


def _datatype(kind: str) -> str | None:
    return XSD + _KINDS[kind] if kind in _KINDS else None


def _bindings(df: DataFrame) -> list[tuple[str, Column, Column, Column, str | None]]:
    """Each column's name, value, kind of node, lexical form and datatype."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        lex = c.cast("string")
        uri = F.rlike(lex, F.lit(r"^(?:https?|urn|file):\S*$")) if kind == "string" else F.lit(False)
        node = F.when(uri & F.startswith(lex, F.lit("urn:bnode:")), "bnode").when(uri, "uri").otherwise("literal")
        out.append((name, c, node, lex, _datatype(kind)))
    return out


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON binding object a row, made where the rows are."""
    cols = [F.when(c.isNotNull(), F.struct(node.alias("type"), lex.alias("value"), F.lit(dt).cast("string").alias("datatype"))).alias(name) for name, c, node, lex, dt in _bindings(df)]
    return df.select(F.to_json(F.struct(*cols)).alias("value"))


def xml_rows(df: DataFrame) -> DataFrame:
    """One XML result element a row."""
    cols = []
    for name, c, node, lex, dt in _bindings(df):
        for raw, told in _XML_TEXT:
            lex = F.replace(lex, F.lit(raw), F.lit(told))
        attr = f" datatype={quoteattr(dt)}" if dt else ""
        cols.append(F.when(c.isNotNull(), F.concat(F.lit(f"<binding name={quoteattr(name)}><"), node, F.lit(f"{attr}>"), lex, F.lit("</"), node, F.lit("></binding>"))))
    return df.select(F.concat(F.lit("<result>"), F.concat_ws("", *cols), F.lit("</result>")).alias("value"))


def _boolean(df: DataFrame) -> bool:
    return df.columns == ["result"] and [r[0] for r in df.limit(2).collect()] in (["true"], ["false"])


def to_json(df: DataFrame) -> str:
    if _boolean(df):
        return json.dumps({"head": {}, "boolean": df.first()[0] == "true"})
    return json.dumps({"head": {"vars": df.columns}, "results": {"bindings": [json.loads(r[0]) for r in json_rows(df).collect()]}})


def _xml_head(names: list[str]) -> list[str]:
    return ['<?xml version="1.0"?>', f'<sparql xmlns="{_NS}">', "<head>", *(f"<variable name={quoteattr(v)}/>" for v in names), "</head>", "<results>"]


def to_xml(df: DataFrame) -> str:
    out = _xml_head(df.columns)
    for r in json_rows(df).collect():
        out.append("<result>")
        for name, b in json.loads(r[0]).items():
            tag = b["type"]
            attr = f" datatype={quoteattr(b['datatype'])}" if b.get("datatype") else ""
            out.append(f"<binding name={quoteattr(name)}><{tag}{attr}>{escape(b['value'], {chr(13): '&#13;'})}</{tag}></binding>")
        out.append("</result>")
    return "\n".join([*out, "</results>", "</sparql>"])


def write(df: DataFrame, path: str, fmt: str) -> None:
    """``df`` as one document in a folder; no row comes to the driver."""
    spark = df.sparkSession
    tell = lambda lines, k: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/{k}")
    if fmt == "json" and _boolean(df):
        return tell([to_json(df)], 0)
    if fmt == "json":
        tell([json.dumps({"head": {"vars": df.columns}, "results": {"bindings": []}})[: -len(_JSON_TAIL)]], 0)
        json_rows(df).select(F.concat(F.lit(","), "value")).write.text(f"{path}/1")
        _without_first_comma(spark, f"{path}/1")
        return tell([_JSON_TAIL], 2)
    tell(_xml_head(df.columns), 0)
    xml_rows(df).write.text(f"{path}/1")
    return tell(["</results>", "</sparql>"], 2)


def _without_first_comma(spark: SparkSession, path: str) -> None:
    """The first of some lines loses its comma: its file is streamed to a new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    full = sorted((str(f.getPath().getName()) for f in fs.listStatus(at) if f.getLen() > 0 and str(f.getPath().getName()).startswith("part-")))
    if full:
        old, new = jvm.org.apache.hadoop.fs.Path(at, full[0]), jvm.org.apache.hadoop.fs.Path(at, "_first")
        source = fs.open(old)
        source.seek(1)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, fs.create(new), conf, True)
        fs.delete(old, False)
        fs.rename(new, old)


def read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Lexical forms of a document that ``write`` left in a folder."""
    head = [r[0] for r in spark.read.text(f"{path}/0").collect()]
    if fmt == "json":
        head = "\n".join(head)
        if not head.endswith("["):  # a truth value
            return from_json(spark, head)
        names = json.loads(head + _JSON_TAIL)["head"]["vars"]
        row = F.from_json(F.ltrim("value", F.lit(",")), "map<string,struct<value:string>>", {"mode": "FAILFAST"})
        rows = spark.read.text(f"{path}/1").select(row.alias("row"))
        return rows.select(*(F.col("row")[n]["value"].alias(n) for n in names))
    names = [v.get("name") for v in ET.fromstring("\n".join([*head, "</results>", "</sparql>"])).findall("r:head/r:variable", {"r": _NS})]
    cols = []
    for n in names:
        start = f"<binding name={quoteattr(n)}><"
        text = F.regexp_extract("value", rf"\Q{start}\E[^>]*>([^<]*)<", 1)
        for raw, told in reversed(_XML_TEXT):
            text = F.replace(text, F.lit(told), F.lit(raw))
        cols.append(F.when(F.contains("value", F.lit(start)), text).alias(n))
    return spark.read.text(f"{path}/1").select(*cols)


def _frame(spark: SparkSession, names: list[str], rows: list[dict]) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def from_json(spark: SparkSession, text: str) -> DataFrame:
    """Lexical forms of a JSON result document."""
    try:
        doc = json.loads(text)
        if "boolean" in doc:
            return _frame(spark, ["result"], [{"result": str(doc["boolean"]).lower()}])
        return _frame(spark, doc["head"]["vars"], [{k: v["value"] for k, v in b.items()} for b in doc["results"]["bindings"]])
    except (ValueError, KeyError, TypeError) as e:
        raise ParseError(f"no result document: {e}") from None


def from_xml(spark: SparkSession, text: str) -> DataFrame:
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ParseError(f"no result document: {e}") from None
    ns = {"r": _NS}
    names = [v.get("name") for v in root.findall("r:head/r:variable", ns)]
    rows = [{b.get("name"): (b[0].text or "") for b in r.findall("r:binding", ns)} for r in root.findall("r:results/r:result", ns)]
    return _frame(spark, names, rows)
