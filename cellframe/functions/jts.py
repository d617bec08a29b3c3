"""Geometry operations that need a geometry engine: the JTS library that Spark ships, called by small Java functions.

The functions' source is compiled once a session inside the driver's JVM, by the compiler that Spark itself generates code with, and sent to executors as a jar: no JDK
is needed, and no path of Spark's own files.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import TYPE

SOURCE = Path(__file__).with_name("GeometryFunctions.java")
NAMES = {"buffer": "Buffer", "difference": "Difference", "intersection": "Intersection", "simplify": "Simplify"}
_ready: set[str] = set()


def function(spark, name: str):
    """The operation as a function of columns."""
    _install(spark)
    return lambda *cols: F.call_function(f"cellframe_{name}", *(c if isinstance(c, Column) else F.lit(c) for c in cols))


def compiled(spark) -> dict[str, bytes]:
    """The classes of the functions' source, by name."""
    jvm = spark.sparkContext._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(SOURCE.read_text())
    return {str(name): bytes(code) for name, code in dict(compiler.getBytecodes()).items()}


def _install(spark) -> None:
    session = spark.sparkContext.applicationId
    if session not in _ready:
        jar = Path(tempfile.mkdtemp(prefix="cellframe-jts-")) / "cellframe-geometry.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in compiled(spark).items():
                z.writestr(f"{name.replace('.', '/')}.class", code)
        spark.sql(f"ADD JAR '{jar}'")
        _ready.add(session)
    from pyspark.sql.types import _parse_datatype_string

    jvm, of = spark.sparkContext._jvm, spark._jsparkSession
    kind = of.parseDataType(_parse_datatype_string(TYPE).json())
    loader = of.sharedState().jarClassLoader()
    for name, cls in NAMES.items():
        # registered as an instance: the compiler writes no signatures that a look-up by name could read
        made = jvm.java.lang.Class.forName(f"cellframe.GeometryFunctions${cls}", True, loader).newInstance()
        of.udf().register(f"cellframe_{name}", made, kind)
