"""Row, conversation and manifest checks as expressions: each names its first fault, or lists all of them.

Checks are columns, so a table is validated in the pass that reads it; only checks across rows (uniqueness, conflicts) shuffle,
and they combine before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import clean_text


def filled(c: Column | str) -> Column:
    """True where a text is neither NULL, blank nor `nan`."""
    return clean_text(c) != ""


def first_fault(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule whose condition isn't true, NULL where all hold. An unknown condition doesn't hold."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(name)
    return out


def all_faults(*rules: tuple[str, Column]) -> Column:
    """Names of all rules whose condition isn't true, in order."""
    named = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])
    return F.filter(named, lambda x: x.isNotNull())


def size_of(c: Column | str) -> Column:
    """Length of an array, 0 where it is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), 0).otherwise(F.size(c))


def image_list_fault(images: Column, texts: Sequence[str], index: str, unique: Sequence[str]) -> Column:
    """First fault of a list of images: empty, a null item, an index that isn't its place from 1, an empty text, a repeated value."""
    rules = [("empty", size_of(images) > 0), ("null_item", F.forall(images, lambda x: x.isNotNull()))]
    places = F.transform(images, lambda x, i: F.coalesce(x[index] == i + 1, F.lit(False)))
    rules += [("index", F.forall(places, lambda ok: ok))]
    for t in texts:
        rules.append((f"text:{t}", F.forall(images.getField(t), lambda v: F.coalesce(filled(v), F.lit(False)))))
    for u in unique:
        rules.append((f"unique:{u}", F.size(F.array_distinct(images.getField(u))) == F.size(images)))
    return first_fault(*rules)


def conversation_fault(messages: Column, roles: Sequence[str], tools: Column) -> Column:
    """First fault of a conversation: its roles, then turn by turn the calls.

    An assistant's turn before a tool's has exactly one call, of a tool that `tools` (JSON) names and of the tool that answers;
    the last turn has text and no call.
    """
    said = F.transform(messages, lambda m: m["role"])
    known = F.from_json(tools, "array<struct<function:struct<name:string>>>")
    names = F.transform(known, lambda t: t["function"]["name"])
    calls = F.transform(messages, lambda m: F.filter(m["tool_calls"], lambda c: c.isNotNull()))
    rules: list[tuple[str, Column]] = [("roles", said == F.array(*map(F.lit, roles))), ("tools", size_of(names) > 0)]
    for i, role in enumerate(roles):
        own = F.get(calls, F.lit(i))
        if role == "assistant" and i + 1 < len(roles):
            name = F.get(own, F.lit(0))["function"]["name"]
            rules += [(f"one_call:{i}", size_of(own) == 1), (f"known_tool:{i}", F.array_contains(names, name)), (f"answered:{i}", F.get(messages, F.lit(i + 1))["name"] == name)]
        elif role == "assistant":
            rules += [(f"text:{i}", filled(F.get(messages, F.lit(i))["content"])), (f"no_call:{i}", size_of(own) == 0)]
        elif role == "tool":
            rules.append((f"text:{i}", filled(F.get(messages, F.lit(i))["content"])))
    return first_fault(*rules)


def search_fault(found: DataFrame, k: int) -> DataFrame:
    """(query_id, fault) of every query: more than k hits, a score that isn't finite, a repeated document, ranks that aren't 1..n, scores out of order."""
    g = found.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count_distinct("rank").alias("ranks"),
        F.bool_and(F.coalesce(~F.isnan("score") & (F.abs("score") < float("inf")), F.lit(False))).alias("finite"),
        F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s"),  # at most the hits of one query
    )
    falls = F.forall(F.transform("s", lambda x, i: (i == 0) | (x["score"] <= F.get("s", F.greatest(F.lit(0), i - 1))["score"])), lambda ok: ok)
    fault = first_fault(("count", F.col("n") <= k), ("finite", F.col("finite")), ("unique", F.col("docs") == F.col("n")), ("ranks", (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("ranks") == F.col("n"))), ("order", falls))
    return g.select("query_id", fault.alias("fault"))


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, conflicts): incoming rows of unknown keys, each key once, and the keys whose values differ within or against the table."""
    rest = [c for c in existing.columns if c not in keys]
    every = existing.select(*keys, *rest).withColumn("__old", F.lit(True)).unionByName(incoming.select(*keys, *rest).withColumn("__old", F.lit(False)))
    g = every.groupBy(*keys).agg(F.bool_or("__old").alias("__known"), F.min(F.struct(*rest)).alias("__lo"), F.max(F.struct(*rest)).alias("__hi"))
    differs = ~F.col("__lo").eqNullSafe(F.col("__hi"))
    fresh = g.where(~F.col("__known") & ~differs).select(*keys, *[F.col(f"__lo.{c}").alias(c) for c in rest])
    return fresh, g.where(differs).select(*keys)


def json_fault(text: Column, members: Mapping[str, str]) -> Column:
    """First fault of a JSON text that must be an object with exactly these members; a kind is `string` (not blank), `number`, `array` or `object`."""
    keys = F.json_object_keys(text)
    rules = [("not_object", keys.isNotNull()), ("keys", F.sort_array(keys) == F.array(*[F.lit(k) for k in sorted(members)]))]
    for name, kind in members.items():
        v = F.get_json_object(text, f"$.{name}")
        ok = {"string": filled(v), "number": v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "array": v.startswith("["), "object": v.startswith("{")}[kind]
        rules.append((f"{kind}:{name}", ok))
    return first_fault(*rules)


def pool_faults(weights: Mapping[str, float], counts: Mapping[str, int], categories: Sequence[str]) -> list[str]:
    """What is wrong with a selection's settings: weights that aren't finite, negative or all 0, counts below 0, repeated or blank categories."""
    out = [f"weight:{k}" for k, w in weights.items() if isinstance(w, bool) or not isinstance(w, int | float) or not math.isfinite(w) or w < 0]
    if not weights or (not out and sum(weights.values()) <= 0):
        out.append("weights")
    out += [f"count:{k}" for k, n in counts.items() if isinstance(n, bool) or not isinstance(n, int) or n < 0]
    if len(set(categories)) != len(categories) or not categories or any(not c.strip() for c in categories):
        out.append("categories")
    return out


def manifest_faults(wanted: Mapping, found: Mapping, keys: Sequence[str] = ("sha256", "order_sha256", "rows")) -> list[str]:
    """Names of the entries (`artifact.key`) in which two manifests disagree, or that one of them lacks."""
    out = []
    for artifact in sorted({*wanted, *found}):
        if artifact not in wanted or artifact not in found:
            out.append(artifact)
            continue
        out += [f"{artifact}.{k}" for k in keys if (k in wanted[artifact] or k in found[artifact]) and wanted[artifact].get(k) != found[artifact].get(k)]
    return out


def zip_lists(value: Column, names: Sequence[str]) -> Column:
    """A struct of lists as a list of structs; shorter lists are filled with NULL, a NULL struct stays NULL."""
    return F.when(value.isNotNull(), F.arrays_zip(*[value.getField(n).alias(n) for n in names]))


def flag_of(c: Column) -> Column:
    """A flag from text or number: true, 1, yes are true, false, 0, no false, anything else unknown."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("true", "1", "yes", "1.0"), True).when(low.isin("false", "0", "no", "0.0"), False)
