"""Deeply nested JSON records to related flat tables, linked by interval labels.

Every node of a record gets a pre-order and a post-order number from one depth-first traversal. Node a contains node b
exactly when pre(a) < pre(b) and post(a) > post(b), so any pair of the flat tables can be joined on the record's key and
these four numbers, whatever lies between the two levels.

Defined cases: a payload that is NULL, empty, broken or not one JSON object gives a record row with status `broken` and no
children; members that are missing, null or of another kind than expected give no children; a null element keeps its
position but is no child; text stands for the JSON it encodes, however often, and a lone object for a list of one; members
may be nested to any depth; repeated deliveries each count; extra columns of the input are ignored, so their names can't clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.session import cut_lineage

#: Kinds of nodes by path. A member maps to (kind, its own members); kind "" is an object that is only passed through.
TRAJECTORY: dict[str, tuple[str, dict]] = {
    "messages": ("message", {"content": ("content_part", {}), "tool_calls": ("tool_call", {})}),
    "images": ("image", {}),
    "extra_info": ("", {"query_images": ("query_image", {}), "wiki_pairs": ("wiki_pair", {})}),
}
#: Members that hold text or a list; their text is never read as JSON.
TEXT_OR_LIST = frozenset({"content"})


def _reject(text: str) -> Any:
    raise ValueError(f"{text} is not JSON")


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null', re.S)


def _read_deep(text: str) -> Any:
    """JSON nested too deeply for the recursive reader, read with a stack of its own; ValueError where it is no JSON."""
    top: list = []
    stack: list[tuple[Any, str | None]] = [(top, None)]  # container and, in an object, the member being read
    at, wants = _SPACE.match(text).end(), True  # wants: a value must come next

    def name_at(at: int) -> tuple[str, int]:
        m = _SCALAR.match(text, at)
        if m is None or text[at : at + 1] != '"':
            raise ValueError("a member's name is missing")
        colon = _SPACE.match(text, m.end()).end()
        if text[colon : colon + 1] != ":":
            raise ValueError("a colon is missing")
        return json.loads(m[0]), colon + 1

    def put(value: Any) -> None:
        holder, name = stack[-1]
        if name is None:
            holder.append(value)
        else:
            holder[name] = value

    while at < len(text):
        ch = text[at]
        if wants and ch in "[{":
            inner: Any = [] if ch == "[" else {}
            put(inner)
            ahead = _SPACE.match(text, at + 1).end()
            if text[ahead : ahead + 1] == ("]" if ch == "[" else "}"):
                at, wants = ahead + 1, False
            elif ch == "[":
                stack.append((inner, None))
                at = ahead
            else:
                name, at = name_at(ahead)
                stack.append((inner, name))
        elif wants:
            m = _SCALAR.match(text, at)
            if m is None:
                raise ValueError("a value is missing")
            put(json.loads(m[0]))
            at, wants = m.end(), False
        elif len(stack) == 1:
            raise ValueError("text after the value")
        elif ch == ",":
            at, wants = _SPACE.match(text, at + 1).end(), True
            if stack[-1][1] is not None:
                name, at = name_at(at)
                stack[-1] = (stack[-1][0], name)
        elif ch == ("]" if stack[-1][1] is None else "}"):
            stack.pop()
            at += 1
        else:
            raise ValueError("a comma or an end is missing")
        at = _SPACE.match(text, at).end()
    if len(stack) > 1 or wants or not top:
        raise ValueError("the value isn't complete")
    return top[0]


def _write_deep(value: Any) -> str:
    """Compact JSON with sorted members, without recursion."""
    out: list[str] = []
    stack: list[Any] = [(value,)]  # a tuple of one holds a value still to be written, a string is written as it is
    while stack:
        step = stack.pop()
        if isinstance(step, str):
            out.append(step)
            continue
        x = step[0]
        if isinstance(x, dict) and x:
            parts: list[Any] = ["{"]
            for i, k in enumerate(sorted(x)):
                parts += [("," if i else "") + json.dumps(k, ensure_ascii=False) + ":", (x[k],)]
            stack += reversed([*parts, "}"])
        elif isinstance(x, list) and x:
            parts = ["["]
            for i, y in enumerate(x):
                parts += [",", (y,)] if i else [(y,)]
            stack += reversed([*parts, "]"])
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def decode(value: Any) -> Any:
    """What a text encodes, however often it was encoded; None for text that is no JSON. Other values as they are.

    Every layer of encoding takes at least two characters away, so this ends.
    """
    while isinstance(value, str):
        try:
            value = json.loads(value, parse_constant=_reject)
        except RecursionError:
            try:
                value = _read_deep(value)
            except ValueError:
                return None
        except ValueError:
            return None
    return value


def _elements(value: Any, text_or_list: bool) -> list:
    if isinstance(value, str):
        value = None if text_or_list else decode(value)
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else []


def _text(value: Any) -> str | None:
    if value is None:
        return None
    if not isinstance(value, str):
        try:
            value = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except RecursionError:
            value = _write_deep(value)
    return value.encode("utf-8", "replace").decode("utf-8")


def label_tree(payload: str | None, members: dict, with_attributes: bool) -> list[list]:
    """Nodes [kind, pre, post, child_no, attributes] of one record in pre-order; the first is the record itself."""
    root = decode(payload)
    nodes: list[list] = []
    ended = 0

    def visit(kind: str, value: dict, below: dict, child_no: int) -> None:
        nonlocal ended
        node = [kind, len(nodes) + 1, 0, child_no, None]
        nodes.append(node)
        if with_attributes:
            taken = {k for k, (_, inner) in below.items() if k not in TEXT_OR_LIST or not isinstance(value.get(k), str)}
            node[4] = [(_text(k), _text(v)) for k, v in value.items() if k not in taken]
        for member, (inner_kind, inner) in below.items():
            if inner_kind:
                for i, x in enumerate(_elements(value.get(member), member in TEXT_OR_LIST), 1):
                    if isinstance(x := decode(x), dict):
                        visit(inner_kind, x, inner, i)
            elif isinstance(x := decode(value.get(member)), dict):
                visit(member, x, inner, 1)
        ended += 1
        node[2] = ended

    if isinstance(root, dict):
        visit("record", root, members, 1)
    else:
        nodes.append(["broken", 1, 1, 1, [] if with_attributes else None])
    return nodes


def link_by_intervals(nodes: list[list]) -> list[int]:
    """pre of each node's parent: the nearest earlier node whose interval contains it; 0 for the record."""
    open_nodes: list[list] = []
    parents = []
    for node in nodes:
        while open_nodes and open_nodes[-1][2] < node[2]:
            open_nodes.pop()
        parents.append(open_nodes[-1][1] if open_nodes else 0)
        open_nodes.append(node)
    return parents


def node_table(df: DataFrame, key: str, payload: str, members: dict = TRAJECTORY, with_attributes: bool = True) -> DataFrame:
    """One row per node: key, kind, pre, post, parent_pre, parent_no, child_no, attributes. No shuffle.

    parent_no is the parent's position in its own list, 0 where the parent is the record or an object below it.
    """
    key_type = df.schema[key].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds, numbers, attributes = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                nodes = label_tree(text, members, with_attributes)
                at = {n[1]: n for n in nodes}
                for node, parent in zip(nodes, link_by_intervals(nodes), strict=True):
                    above = at.get(parent)
                    listed = above is not None and above[0] not in ("record", "broken") and above[0] not in members
                    keys.append(row)
                    kinds.append(node[0])
                    numbers.append((node[1], node[2], parent, above[3] if listed else 0, node[3]))
                    attributes.append(node[4])
            columns = [pa.array([n[i] for n in numbers], pa.int32()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(kinds, pa.string()), *columns, pa.array(attributes, pa.map_(pa.string(), pa.string()))],
                ["node_key", "kind", "pre", "post", "parent_pre", "parent_no", "child_no", "attributes"],
            )

    schema = f"node_key {key_type}, kind string, pre int, post int, parent_pre int, parent_no int, child_no int, attributes map<string,string>"
    return df.select(F.col(key).alias("node_key"), F.col(payload).cast("string").alias("payload")).mapInArrow(label, schema).withColumnRenamed("node_key", key)


#: Columns of each flat table taken from the node's members; NULL where a record lacks them.
ATTRIBUTES = {
    "record": ("schema_version", "sample_id", "parent_sample_id", "data_source", "category_key", "coarse_taxon", "question_type"),
    "extra_info": ("question_id", "official_split", "answers", "evidence", "category", "positive_candidate_count"),
    "message": ("role", "name", "content"),
    "content_part": ("type", "text", "image"),
    "tool_call": ("type", "id", "function"),
    "image": ("image",),
    "query_image": ("image_index", "dataset_image_id", "image_key", "image", "source_file_name", "source_split"),
    "wiki_pair": ("title", "url", "normalized_url"),
}


def flat_table(nodes: DataFrame, key: str, kind: str) -> DataFrame:
    """The table of one kind, each row with its own interval and the key of its parent."""
    wanted = nodes.where(F.col("kind").isin("record", "broken") if kind == "record" else F.col("kind") == kind)
    columns: list[Column] = [F.col("attributes")[a].alias(a) for a in ATTRIBUTES[kind]]
    if kind == "tool_call":
        function = F.col("attributes")["function"]
        arguments = F.get_json_object(function, "$.arguments")
        columns = [c for c, a in zip(columns, ATTRIBUTES[kind], strict=True) if a != "function"]
        columns += [F.get_json_object(function, "$.name").alias("function_name"), arguments.alias("arguments")]
    if kind == "record":
        columns.append(F.when(F.col("kind") == "record", "ok").otherwise("broken").alias("status"))
    return wanted.select(key, "pre", "post", "parent_pre", "parent_no", "child_no", *columns)


def contained(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Joins two node tables on interval containment within the record: all descendants, at any depth, of each parent."""
    above = parents.select(key, F.col("pre").alias("above_pre"), F.col("post").alias("above_post"))
    return above.join(children, key).where("above_pre < pre and above_post > post")


def flat_tables(nodes: DataFrame, key: str, kinds: Sequence[str] = tuple(ATTRIBUTES)) -> dict[str, DataFrame]:
    """The tables of several kinds from one labelling pass: the nodes are written once and every table reads its rows of them."""
    kept = cut_lineage(nodes)
    return {kind: flat_table(kept, key, kind) for kind in kinds}


def write_tables(nodes: DataFrame, key: str, path: str, kinds: Sequence[str] = tuple(ATTRIBUTES)) -> None:
    """Writes `path`/<kind> for every kind; payloads are parsed once."""
    for kind, rows in flat_tables(nodes, key, kinds).items():
        rows.write.mode("overwrite").parquet(f"{path}/{kind}")
