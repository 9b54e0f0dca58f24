"""Tool-call linking: calls meet results by identifier, in topological order, as canonical JSON.

Calls are (call_id, name, arguments as JSON, depends array, ord), results (call_id, content, ord). The join on the
identifier is a shuffled hash join of calls with the first result of each identifier, which map-side
aggregation has made one row, so a hot identifier costs no more than its calls. Levels come by rounds over the calls
that depend on others: by pointer doubling where each depends on one at most, else by peeling.

Defined results: a null call_id links with nothing and is flagged (such calls go round the joins, as they would all meet
in one task); of repeated identifiers, every call is
flagged "duplicate id" and gets the first result (ties: the smaller content); results without a call are
dropped here and listed by ``orphans``; a cycle's calls have a null level and are flagged; unknown dependencies
are flagged and count as met, null ones among them are passed over; null arguments are flagged, and so are those that JSON
has no form for (NaN, infinity); kept columns named as the result's own get ``kept_`` before them; empty tables give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise

_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int,
}


def canonical(value: object) -> str:
    """Sorted keys, no white space, text as it is. An error for what JSON has no form for."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_number(text: str) -> object:
    raise ValueError(text)


def read(arguments: str) -> object:
    """JSON as the standard has it; an error else, also for numbers that are too large for a double."""
    value = json.loads(arguments, parse_constant=_no_number)
    canonical(value)
    return value


def errors(value: object, schema: dict, at: str = "$") -> list[str]:
    """What breaks a JSON-schema subset: type, properties, required, additionalProperties, items, enum, lengths, ranges."""
    out: list[str] = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("number", "integer")) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the allowed values")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            out.append(f"{at}: too large")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += errors(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties", True) is False:
            out += [f"{at}.{k}: not allowed" for k in sorted(value) if k not in known]
        for k in sorted(known):
            if k in value:
                out += errors(value[k], known[k], f"{at}.{k}")
    return out


RESULT = ("call_id", "level", "valid", "errors", "json")


def _finish(schemas: dict[str, dict], rest: list[str], has_rest: pa.Schema | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, problems, texts = [], [], []
            for r in b.select(["call_id", "name", "arguments", "level", "content", "linked", "flags", "depends"]).to_pylist():
                found = [f for f in r["flags"] if f]
                try:
                    args = read(r["arguments"]) if r["arguments"] is not None else None
                except (ValueError, RecursionError):
                    args = r["arguments"]
                    found.append("arguments: not JSON")
                if r["arguments"] is None:
                    found.append("arguments: missing")
                elif r["name"] not in schemas:
                    found.append("name: no such tool")
                elif not found or found[-1] != "arguments: not JSON":
                    found += errors(args, schemas[r["name"]])
                if not r["linked"]:
                    found.append("result: missing")
                valid.append(not found)
                problems.append(found)
                texts.append(canonical({"arguments": args, "depends_on": sorted(d for d in r["depends"] or [] if d is not None), "id": r["call_id"], "level": r["level"], "name": r["name"], "result": r["content"]}))
            cols = [b.column(c) for c in rest] + [b.column(c) for c in ("call_id", "level")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(valid, pa.bool_()), pa.array(problems, pa.list_(pa.string())), pa.array(texts, pa.string())], names=[*rest, "call_id", "level", "valid", "errors", "json"])

    return run


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level, cycle) of calls that depend on known others; the rest are of level 0."""
    ids = calls.filter("call_id is not null").select("call_id").distinct()
    edges = calls.filter("call_id is not null and size(depends) > 0").select("call_id", F.explode("depends").alias("on")).filter("on is not null").distinct()
    edges = materialise(edges.join(ids.withColumnRenamed("call_id", "on"), "on", "left_semi"), "edges")
    most = edges.groupBy("call_id").count().agg(F.max("count")).first()[0]
    if most is None:
        return calls.sparkSession.createDataFrame([], "call_id string, level int, cycle boolean")
    if most == 1:  # chains: each round doubles how far a pointer reaches
        far = materialise(edges.select("call_id", "on", F.lit(1).cast("bigint").alias("level")), "chain")
        limit = 2 * max(1, far.count())
        reach = 1
        while reach <= limit:
            step = far.select(F.col("call_id").alias("on"), F.col("on").alias("next"), F.col("level").alias("more"))
            far2 = far.join(step, "on", "left").select("call_id", F.when(F.col("more").isNull(), F.col("on")).otherwise(F.col("next")).alias("on"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), F.col("more").isNotNull().alias("moved"))
            far2 = materialise(far2, "chain")
            reach *= 2
            moved = far2.filter("moved").limit(1).count()
            far = far2.drop("moved")
            if not moved:
                return far.select("call_id", F.col("level").cast("int").alias("level"), F.lit(False).alias("cycle"))
        # what still moves runs in a circle or into one
        return far2.select("call_id", F.when(~F.col("moved"), F.col("level").cast("int")).alias("level"), F.col("moved").alias("cycle"))
    left, level = edges, 0
    done = materialise(ids.join(edges.select("call_id").distinct(), "call_id", "left_anti").select("call_id", F.lit(0).alias("level")), "done")
    fresh = done
    while True:
        left = materialise(left.join(fresh.select(F.col("call_id").alias("on")), "on", "left_anti"), "left")
        waiting = materialise(left.select("call_id").distinct(), "waiting")
        fresh = edges.select("call_id").distinct().join(done, "call_id", "left_anti").join(waiting, "call_id", "left_anti")
        level += 1
        fresh = materialise(fresh.select("call_id", F.lit(level).alias("level")), "fresh")
        if not fresh.limit(1).count():
            stuck = waiting.select("call_id", F.lit(None).cast("int").alias("level"), F.lit(True).alias("cycle"))
            return done.filter("level > 0").select("call_id", "level", F.lit(False).alias("cycle")).unionByName(stuck)
        done = materialise(done.unionByName(fresh), "done")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], keep: list[str] | None = None) -> DataFrame:
    """(kept columns, call_id, level, valid, errors, json) of every call; calls in order are by level, then ord."""
    names = [f"kept_{c}" if c in RESULT else c for c in keep or []]
    calls = calls.select("call_id", "name", "arguments", "depends", *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep or [])])
    kept = [c for c in calls.columns if c.startswith("_")]
    some = calls.filter("call_id is not null")
    first = results.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct("ord", "content")).alias("r")).select("call_id", F.col("r.content").alias("content"), F.lit(True).alias("linked"))
    twice = some.groupBy("call_id").count().filter("count > 1").select("call_id", F.lit(True).alias("twice"))
    known = some.select(F.col("call_id").alias("on")).distinct()
    asked = some.filter("size(depends) > 0").select("call_id", F.explode("depends").alias("on")).filter("on is not null").distinct()
    unknown = asked.join(known, "on", "left_anti").select("call_id").distinct().withColumn("unknown", F.lit(True))
    # flags of an identifier come as one small table, so that calls meet results and flags in a join each
    marks = twice.join(levels(some), "call_id", "full_outer").join(unknown, "call_id", "full_outer")
    out = some.join(first.hint("shuffle_hash"), "call_id", "left").join(marks, "call_id", "left")
    none = lambda t: F.lit(None).cast(t)
    lost = calls.filter("call_id is null").select("*", none("string").alias("content"), none("boolean").alias("linked"), none("boolean").alias("twice"), none("int").alias("level"), none("boolean").alias("cycle"), none("boolean").alias("unknown"))
    out = out.unionByName(lost)
    flags = F.array(
        F.when(F.col("call_id").isNull(), "id: missing"), F.when(F.col("twice"), "id: duplicate"),
        F.when(F.col("cycle"), "depends: cycle"), F.when(F.col("unknown"), "depends: unknown id"),
    )
    level = F.when(F.col("cycle"), None).otherwise(F.coalesce("level", F.lit(0)))
    ready = out.select(*kept, "call_id", "name", "arguments", "depends", level.cast("int").alias("level"), "content", F.coalesce("linked", F.lit(False)).alias("linked"), flags.alias("flags"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ready.select(*kept).schema.fields) if kept else ""
    done = ready.mapInArrow(lean(_finish(schemas, kept)), schema + "call_id string, level int, valid boolean, errors array<string>, json string")
    return done.toDF(*names, *RESULT)


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    return results.join(calls.filter("call_id is not null").select("call_id").distinct(), "call_id", "left_anti")


_TEXT = {"type": "string", "minLength": 1, "maxLength": 1000}
#: Of the calls that users' turns make: the first opens a conversation, the others reply, in texts of bounded length.
TURN_SCHEMA = {
    "open": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": _TEXT, "turn": {"type": "integer", "minimum": 0, "maximum": 0}}},
    "reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": _TEXT, "turn": {"type": "integer", "minimum": 1}}},
}


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as tool traffic: a user's turn calls ``open`` or ``reply`` under the identifier conv:turn and depends on the user's turn two
    before, if any; an assistant's turn is the result of the call one turn before. Without conv_id or turn, the identifier is
    null: such a user's turn is a call that links with nothing, such an assistant's turn a result that ``orphans`` lists."""
    base = conversations.select("conv_id", "turn", "role", "text")
    ident = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    users = base.filter("role = 'user'")
    ids = users.select(ident(0).alias("on")).filter("on is not null").distinct()
    calls = users.select("conv_id", "turn", ident(0).alias("call_id"), F.when(F.col("turn") == 0, "open").otherwise("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), ident(2).alias("on"), F.col("turn").alias("ord"))
    none = F.array().cast("array<string>")
    lost = calls.filter("on is null").withColumn("depends", none).drop("on")  # they would all meet in one task of the join
    calls = calls.filter("on is not null").join(ids.withColumn("_there", F.lit(True)), "on", "left").withColumn("depends", F.when(F.col("_there"), F.array("on")).otherwise(none)).drop("on", "_there")
    calls = calls.unionByName(lost)
    return calls, base.filter("role = 'assistant'").select(ident(1).alias("call_id"), F.col("text").alias("content"), F.col("turn").alias("ord"))
