"""Output paths of partitions: templates, Hive escaping, value formats, listings."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import re
from dataclasses import dataclass

from ..errors import OptionError

DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"
#: Characters that a path value escapes besides controls and non-ASCII ones.
ESCAPED = set("\"#%'*/:=?\\{[]^\x7f")
_FIELD = re.compile(r"\{\{\s*([^{}|]*?)\s*(?:\|\s*([^{}]*?)\s*)?\}\}")


def escape(text: str) -> str:
    """Percent-escapes, upper-case hex, of each byte of a special character."""
    return "".join(c if " " <= c <= "~" and c not in ESCAPED else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def value_text(value: object) -> str:
    """ISO dates and times, plain numbers and text; empty for null."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date | dt.time):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    return str(value)


class Template:
    """{{column}} (escaped) and {{column | raw}} in a path."""

    def __init__(self, text: str, columns: list[str]):
        self.text = text
        rest = _FIELD.sub("", text)
        if "{{" in rest or "}}" in rest or "{%" in text or "{#" in text:
            raise OptionError(f"malformed path template '{text}'")
        for name, how in _FIELD.findall(text):
            if name not in columns:
                raise OptionError(f"path template names '{name}', which is not a partition column ({', '.join(columns)})")
            if how not in ("", "raw"):
                raise OptionError(f"unknown filter '{how}' in path template")

    def resolve(self, values: dict[str, object]) -> str:
        def one(m: re.Match) -> str:
            text = value_text(values[m[1]])
            if not text:
                return DEFAULT_PARTITION
            if m[2] != "raw":
                return escape(text)
            if ".." in text.split("/"):
                raise OptionError(f"the raw value '{text}' would leave the output folder")
            return text

        return _FIELD.sub(one, self.text)

    def numbered(self, values: dict[str, object], index: int) -> str:
        """The path of a partition's file number `index`: from 1 on, _1, _2, ... before the file name's extension."""
        path = self.resolve(values)
        if not index:
            return path
        folder, slash, name = path.rpartition("/")
        stem, dot, extension = name.rpartition(".")
        name = f"{stem}_{index}.{extension}" if dot and stem else f"{name}_{index}"
        return f"{folder}{slash}{name}"


def partition_key(values: list[object]) -> str:
    """A text that only equal lists of values share: null is '!', others carry their length."""
    return "".join("!" if v is None else f"{len(t)}:{t}" for v in values for t in [value_text(v)])


@dataclass(frozen=True)
class OutputFile:
    path: str
    row_count: int
    partition_values: tuple[tuple[str, object], ...] = ()


def json_value(value: object) -> object:
    """Numbers, booleans and text as they are, dates as days, NaN and infinities as null, the rest as text."""
    if value is None or isinstance(value, bool | int | str):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return (value - dt.date(1970, 1, 1)).days
    return value_text(value)


def listing_json(files: list[OutputFile]) -> str:
    """The files in the order they were made."""
    return json.dumps([{"path": f.path, "row_count": f.row_count, "partition_values": [{"column": c, "value": json_value(v)} for c, v in f.partition_values]} for f in files], indent=2, ensure_ascii=False)


def listing_text(files: list[OutputFile]) -> str:
    """A table of the files by path; empty if there are none."""
    if not files:
        return ""
    names = [c for c, _ in files[0].partition_values]
    head = [*(n.replace("_", " ").title() for n in names), "Path", "Row Count"]
    rows = [[*(value_text(v) if v is not None else "NULL" for _, v in f.partition_values), f.path, f"{f.row_count:,}"] for f in sorted(files, key=lambda f: f.path)]
    width = [max(len(r[k]) for r in [head, *rows]) for k in range(len(head))]
    line = lambda r: "  ".join(x.rjust(w) if k == len(head) - 1 else x.ljust(w) for k, (x, w) in enumerate(zip(r, width, strict=True))).rstrip()
    return "\n".join([line(head), "  ".join("-" * w for w in width), *map(line, rows)])
