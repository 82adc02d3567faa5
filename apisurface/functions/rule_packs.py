"""Rule packs: names of C functions, objects and converters and the Python types they imply."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from apisurface.functions.types import type_imports

TYPE_OBJECT = "type_object"
CONVERTER = "converter"
OBJECT = "object"
OBJECT_USE = "object_use"
CALL = "call"

# The packs in ascending priority; each is a table of (category, name, type) in ``rules``.
PACKS = ["cpython", "numpy", "pillow", "psycopg2", "pytorch"]
RULES = Path(__file__).parent / "rules"

# Fixed value: calls whose type follows from the call itself; see ``apply_rules(computed=...)``.
COMPUTED_CALLS = ["wrap"]
# Fixed value: calls that create an object of the type object they are given.
OBJECT_CREATION = ["PyObject_New", "PyObject_GC_New"]

# Keywords that show how a package builds its extension modules.
EXTENSION_KEYWORDS = {
    "PyMODINIT_FUNC": "C/C++ Extensions",
    "PyInit_": "C/C++ Extensions",
    "PyModuleDef": "C/C++ Extensions",
    "PYBIND11_MODULE": "PyBind11",
    "pybind11/pybind11.h": "PyBind11",
    "BOOST_PYTHON_MODULE": "Boost.Python",
    "boost/python.hpp": "Boost.Python",
    "cpdef": "Cython",
    "cimport": "Cython",
    "ctypedef": "Cython",
    "#[pymodule]": "Rust",
    "#[pyfunction]": "Rust",
    "#[pyclass]": "Rust",
    "%module": "SWIG",
    "%include": "SWIG",
    "%typemap": "SWIG",
    "CDLL(": "ctypes",
    "WinDLL(": "ctypes",
    "FFI(": "CFFI",
    "ffi.cdef(": "CFFI",
    "ffi.new(": "CFFI",
    "ffi.dlopen(": "CFFI",
}


def pack_rows(pack: str) -> list[tuple[str, str, str, int]]:
    """(category, name, type, priority) of one pack."""
    with (RULES / f"{pack}.csv").open(newline="", encoding="utf-8") as file:
        return [(row["category"], row["name"], row["type"], PACKS.index(pack)) for row in csv.DictReader(file)]


def rule_table(spark: SparkSession, packs: Iterable[str] = PACKS) -> DataFrame:
    """Rows of the named packs as rules(category, name, type, imports, priority)."""
    rows = [row for pack in packs for row in pack_rows(pack)]
    table = spark.createDataFrame(rows, "category string, name string, type string, priority int")
    return table.select("category", "name", "type", type_imports("type").alias("imports"), "priority")


def default_packs(spark: SparkSession) -> list[DataFrame]:
    """All packs apart, later ones win when they are merged."""
    return [rule_table(spark, [pack]) for pack in PACKS]
