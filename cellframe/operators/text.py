"""Properties written as text: lines of key=value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.geometry import GeometryBlock

#: Fixed format: a key is printable ASCII without '='; the value is the rest of the line.
LINE = r"(?m)^\s*([\x20-\x3C\x3E-\x7E]+?)\s*=[ \t]*(.*?)[ \t]*$"


class ParseTextColumn(GeometryBlock):
    """Columns from key=value lines of a text column; key_mapping gives key -> column. The last of equal keys counts. A column is text; <column>_num has its number and <column>_bool its truth value where it is one."""

    def __init__(self, source, source_column, key_mapping):
        if not isinstance(source, GeometryBlock):
            raise TypeError("features are needed")
        if source_column not in source.columns:
            raise KeyError(f"column {source_column!r} isn't there")
        super().__init__(source, source_column, dict(key_mapping))

    columns = property(lambda self: self.args[0].columns | {c + s for c in self.args[2].values() for s in ("", "_num", "_bool")})

    def plan(self, ctx, request):
        source, column, keys = self.args
        df = ctx.features(source, request)
        text = F.col(f"`{column}`")
        found = F.arrays_zip(F.regexp_extract_all(text, F.lit(LINE), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(LINE), F.lit(2)).alias("v"))
        df = df.withColumn("_pairs", found)
        fresh = {}
        for key, name in keys.items():
            mine = F.filter("_pairs", _with_key(key))
            value = F.get(mine, F.size(mine) - 1)["v"]
            value = F.when(F.lower(value) != "null", value)
            fresh[name] = value
            fresh[f"{name}_num"] = value.try_cast("double")
            fresh[f"{name}_bool"] = F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)
        return df.withColumns(fresh).drop("_pairs")


def _with_key(key):
    return lambda p: p["k"] == key
