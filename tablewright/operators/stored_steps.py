"""Fitted steps on disk, and back in any session.

A folder holds a versioned head (one line of JSON: what each step found in the training part) and, beside it, the tables of large
dictionaries as Parquet. The head is written last, so a folder with a head is whole. Expressions are not stored: they are built
from what was found by the function that ``fit`` uses as well, so a step does the same before and after. Text whose dictionary is
small stays a literal; large dictionaries are never read by the driver.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from decimal import Decimal
from typing import Any

from pyspark.ml.feature import OneHotEncoderModel
from pyspark.sql import SparkSession

from tablewright.functions.stats import local_frame
from tablewright.operators.dates import FittedDates, date_parts
from tablewright.operators.encode import Dictionary, FittedEncoder
from tablewright.operators.fitted import Fitted, Projection
from tablewright.operators.impute import fill_nulls
from tablewright.operators.interact import combine_pairs
from tablewright.operators.logs import take_logs
from tablewright.operators.scale import rescale

FORMAT, VERSION = "tablewright-steps", 1
DICTIONARY = "value string, code long"
#: How a stored projection is built again, by the kind in its recipe.
BUILDERS = {"fill": fill_nulls, "rescale": rescale, "logs": take_logs, "pairs": combine_pairs}


def save_steps(spark: SparkSession, steps: Sequence[Fitted], path: str) -> None:
    """Write fitted steps, in order, to a folder that does not exist yet."""
    path = path.rstrip("/")
    lines = [_line(step, f"{path}/step-{i}") for i, step in enumerate(steps)]
    for line, tables in lines:  # all steps can be stored, or nothing is written
        for place, write in tables:
            write(place)
    head = json.dumps({"format": FORMAT, "version": VERSION, "steps": [line for line, _ in lines]}, default=_tagged)
    local_frame(spark, [(head,)], "value string").coalesce(1).write.mode("error").text(f"{path}/head")


def load_steps(spark: SparkSession, path: str) -> list[Fitted]:
    """The steps of a folder, ready for tables and streams."""
    path = path.rstrip("/")
    head = json.loads(spark.read.text(f"{path}/head").where("value != ''").first()["value"], object_hook=_plain)
    if head.get("format") != FORMAT or head.get("version") != VERSION:
        raise ValueError(f"{path} holds {head.get('format')} version {head.get('version')}, not {FORMAT} version {VERSION}")
    return [_step(spark, line, f"{path}/step-{i}") for i, line in enumerate(head["steps"])]


def _line(step: Fitted, place: str) -> tuple[dict, list]:
    """What the head says of a step, and the tables to be written for it: (folder, writer)."""
    if isinstance(step, FittedEncoder):
        tables, large = [], {}
        for i, (name, table) in enumerate(step.large.items()):
            large[name] = {"folder": f"dictionary-{i}", "size": table.size, "hot": name in step.hot}
            tables.append((f"{place}/dictionary-{i}", table.table.write.mode("error").parquet))
            if name in step.hot:
                tables.append((f"{place}/one-hot-{i}", step.hot[name].save))
        args = {"method": step.method, "handle_unknown": step.handle_unknown, "names": list(step.names), "small": step.small}
        return {"kind": "encode", "args": args, "large": large}, tables
    if isinstance(step, FittedDates):
        return {"kind": "dates", "args": step.recipe}, []
    if isinstance(step, Projection):
        if step.recipe is not None:
            kind, args = step.recipe
            return {"kind": kind, "args": args}, []
        if not step.replaced and not step.added:
            return {"kind": "drop", "dropped": list(step.dropped), "rows": [list(r) for r in step.rows], "schema": step.schema}, []
    raise ValueError(f"{type(step).__name__} holds expressions of its own and cannot be stored")


def _step(spark: SparkSession, line: dict, place: str) -> Fitted:
    kind = line["kind"]
    if kind == "encode":
        args, large, hot = line["args"], {}, {}
        for name, found in line["large"].items():
            large[name] = Dictionary(spark.read.schema(DICTIONARY).parquet(f"{place}/{found['folder']}"), found["size"])
            if found["hot"]:
                hot[name] = OneHotEncoderModel.load(f"{place}/{found['folder'].replace('dictionary', 'one-hot')}")
        return FittedEncoder(args["method"], args["handle_unknown"], tuple(args["names"]), args["small"], large, hot)
    if kind == "dates":
        return date_parts(**line["args"])
    if kind == "drop":
        return Projection(dropped=tuple(line["dropped"]), rows=tuple(tuple(r) for r in line["rows"]), schema=line["schema"])
    if kind not in BUILDERS:
        raise ValueError(f"unknown kind of step {kind!r}")
    return BUILDERS[kind](**line["args"])


# --- values that JSON has no type for --------------------------------------------------


def _tagged(value: Any) -> dict:
    if isinstance(value, Decimal):
        return {"$decimal": str(value)}
    if isinstance(value, dt.datetime):
        return {"$datetime": value.isoformat()}
    if isinstance(value, dt.date):
        return {"$date": value.isoformat()}
    if isinstance(value, (bytes, bytearray)):
        return {"$bytes": value.hex()}
    raise ValueError(f"a {type(value).__name__} cannot be stored")


_READ = {
    "$decimal": Decimal, "$datetime": dt.datetime.fromisoformat, "$date": dt.date.fromisoformat, "$bytes": lambda x: bytearray.fromhex(x),
}


def _plain(found: dict) -> Any:
    if len(found) == 1:
        (tag, value), = found.items()
        if tag in _READ and isinstance(value, str):
            return _READ[tag](value)
    return found
