"""Column types that several operators share, as DDL, and functions of rows over Arrow columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Results of this many rows are Python objects at a time.
ROWS = 256


def struct(**fields: str) -> str:
    return "struct<" + ",".join(f"{name}:{kind}" for name, kind in fields.items()) + ">"


def array(kind: str) -> str:
    return f"array<{kind}>"


def ints(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "int")


OFFSETS = ints("begin2", "end2", "begin", "end")
ANCHORS = array(struct(**ints("pos2", "pos")))
SPAN = struct(uid="bigint", **OFFSETS, anchors=ANCHORS)
EXTENT = struct(**OFFSETS, text2="string", text="string", anchors=ANCHORS)


@cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Freed memory goes back to the system, as a worker lives on when its task is over and others share its executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def by_row(function: Callable, kind: str) -> Callable:
    """A column function from one of rows: a row's arguments become Python objects while it is computed, and no other's."""

    def run(*columns):  # noqa: ANN002, ANN202
        out, done = [], []
        for k in range(len(columns[0])):
            done.append(function(*[c[k].as_py() for c in columns]))
            if len(done) == ROWS:
                out.append(pa.array(done, arrow))
                done = []
        out = pa.concat_arrays([*out, pa.array(done, arrow)])
        give_back()
        return out

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    arrow = to_arrow_type(DataType.fromDDL(kind))
    return F.arrow_udf(run, kind)
