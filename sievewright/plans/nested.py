"""Queries over nested records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators import nested
from sievewright.session import table

KINDS = ("message", "content_part", "tool_call", "image", "query_image", "wiki_pair")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.node_table(table(spark, sf_dir, "raw_records"), "record_id", "payload")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the six flat tables, which one labelling pass emits."""
    tables = nested.flat_tables(_nodes(spark, sf_dir), "record_id", KINDS)
    return reduce(DataFrame.unionAll, [t.select("record_id", F.lit(k).alias("kind"), "parent_no", "child_no") for k, t in tables.items()])


def _flat(kind: str):
    return lambda spark, sf_dir: nested.flat_table(_nodes(spark, sf_dir), "record_id", kind)


def p2_message_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls joined to their messages by interval containment."""
    nodes = _nodes(spark, sf_dir)
    messages, calls = (nested.flat_table(nodes, "record_id", k) for k in ("message", "tool_call"))
    return nested.contained(messages, calls, "record_id")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and records of each table."""
    tables = nested.flat_tables(_nodes(spark, sf_dir), "record_id", KINDS)
    every = reduce(DataFrame.unionAll, [t.select("record_id", F.lit(k).alias("kind")) for k, t in tables.items()])
    return every.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("records"))


def p2_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flat_table(_nodes(spark, sf_dir), "record_id", "message").select("record_id", "child_no", "role")


def p2_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flat_table(_nodes(spark, sf_dir), "record_id", "record").select("record_id", "status")


QUERIES = {
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p2_roles": p2_roles,
    "p2_status": p2_status,
    "p2_records": _flat("record"),
    "p2_extra_info": _flat("extra_info"),
    "p2_messages": _flat("message"),
    "p2_content_parts": _flat("content_part"),
    "p2_tool_calls": _flat("tool_call"),
    "p2_images": _flat("image"),
    "p2_query_images": _flat("query_image"),
    "p2_wiki_pairs": _flat("wiki_pair"),
    "p2_message_children": p2_message_children,
}


def _decoded(columns: dict[str, str], source: str, keep: str, layers: int = 4) -> str:
    """CTEs that replace JSON texts in the columns by what they encode, layer by layer; the last is named like the first with `_d`."""
    out, at = [], source
    for i in range(layers):
        step = {c: f"CASE WHEN json_type({c}) = 'VARCHAR' THEN CASE WHEN json_valid({c} ->> '$') THEN ({c} ->> '$')::JSON END ELSE {c} END AS {c}" for c in columns.values()}
        name = f"{source}_d" if i == layers - 1 else f"{source}_{i}"
        out.append(f"{name} AS (SELECT {keep}, {', '.join(step.values())} FROM {at})")
        at = name
    return ",\n    ".join(out)


def _items(name: str, source: str, column: str, keep: str) -> str:
    """A CTE with a row per element of a list, or of a lone object, and its place, and the CTEs that decode it."""
    listed = f"CASE json_type({column}) WHEN 'ARRAY' THEN json_extract({column}, '$[*]') WHEN 'OBJECT' THEN [{column}] END"
    return f"{name} AS (SELECT {keep}, unnest({listed}) AS x, generate_subscripts({listed}, 1) AS i FROM {source}),\n    {_decoded({'x': 'x'}, name, keep + ', i')}"


_JSON = f"""WITH r AS (SELECT record_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM raw_records),
    {_decoded({"p": "p"}, "r", "record_id")},
    o AS (SELECT record_id, row_number() OVER () AS u, p -> '$.messages' AS m, p -> '$.images' AS g, p -> '$.extra_info' AS e FROM r_d WHERE json_type(p) = 'OBJECT'),
    {_decoded({"m": "m", "g": "g", "e": "e"}, "o", "record_id, u")},
    q AS (SELECT record_id, u, CASE WHEN json_type(e) = 'OBJECT' THEN e -> '$.query_images' END AS y, CASE WHEN json_type(e) = 'OBJECT' THEN e -> '$.wiki_pairs' END AS w FROM o_d),
    {_decoded({"y": "y", "w": "w"}, "q", "record_id, u")},
    {_items("ms", "o_d", "m", "record_id, u")},
    {_items("im", "o_d", "g", "record_id, u")},
    {_items("qi", "q_d", "y", "record_id, u")},
    {_items("wp", "q_d", "w", "record_id, u")},
    mo AS (SELECT record_id, u, i AS parent, CASE WHEN json_type(x -> '$.content') <> 'VARCHAR' THEN x -> '$.content' END AS c, x -> '$.tool_calls' AS t FROM ms_d WHERE json_type(x) = 'OBJECT'),
    {_decoded({"t": "t"}, "mo", "record_id, u, parent, c")},
    {_items("cp", "mo_d", "c", "record_id, u, parent")},
    {_items("tc", "mo_d", "t", "record_id, u, parent")}"""


def _children(kind: str, source: str, parent: str) -> str:
    return f"SELECT record_id, '{kind}' AS kind, CAST({parent} AS INTEGER) AS parent_no, CAST(i AS INTEGER) AS child_no FROM {source}_d WHERE json_type(x) = 'OBJECT'"


_SOURCES = {"message": ("ms", "0"), "content_part": ("cp", "parent"), "tool_call": ("tc", "parent"), "image": ("im", "0"), "query_image": ("qi", "0"), "wiki_pair": ("wp", "0")}
SQL: dict[str, str] = {
    "p2_found": f"{_JSON}\n    " + " UNION ALL ".join(_children(k, *v) for k, v in _SOURCES.items()),
    "p2_counts": f"{_JSON}, a AS ({' UNION ALL '.join(_children(k, *v) for k, v in _SOURCES.items())}) SELECT kind, count(*) AS n, count(DISTINCT record_id) AS records FROM a GROUP BY 1",
    "p2_roles": f"{_JSON} SELECT record_id, CAST(i AS INTEGER) AS child_no, x ->> '$.role' AS role FROM ms_d WHERE json_type(x) = 'OBJECT'",
    "p2_status": f"{_JSON} SELECT r.record_id, CASE WHEN o.record_id IS NULL THEN 'broken' ELSE 'ok' END AS status FROM raw_records r LEFT JOIN o ON r.record_id = o.record_id",
}
