"""Frontmatter as data: the stored JSON text as a VARIANT, its fields, and predicates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelattice.errors import InvalidInput

#: Types that a field may be asked for as.
TYPES = ("string", "bigint", "double", "boolean", "date", "timestamp", "array<string>")


def fields(text: Column) -> Column:
    """The fields as a VARIANT object. What is no JSON, or no object, has none."""
    parsed = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), parsed).otherwise(F.parse_json(F.lit("{}")))


def safe_json(text: Column) -> Column:
    """The JSON text of an object as it is, '{}' for anything else."""
    return F.when(F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT")), text).otherwise("{}")


def path_of(*names: str) -> str:
    """The JSON path of a field in a field; names may hold dots, spaces and quotes of one sort."""
    out = "$"
    for name in names:
        quote = "'" if "'" not in name else '"'
        if quote in name or not name:
            raise InvalidInput(f"no path to a field called {name!r}")
        out += f"[{quote}{name}{quote}]"
    return out


def field(of: Column, names: str | tuple[str, ...], kind: str = "string") -> Column:
    """One field of a VARIANT, null where it is missing or no value of that type."""
    if kind not in TYPES:
        raise InvalidInput(f"fields are read as {', '.join(TYPES)}")
    return F.try_variant_get(of, path_of(*((names,) if isinstance(names, str) else names)), kind)


def has(of: Column, names: str | tuple[str, ...]) -> Column:
    """Whether a field is there, a null one included."""
    return F.variant_get(of, path_of(*((names,) if isinstance(names, str) else names)), "variant").isNotNull()


def where_field(chunks: DataFrame, names: str | tuple[str, ...], value: str | int | float | bool) -> DataFrame:
    """Chunks whose field equals a value, or is a list that holds it as text."""
    of = fields(F.col("frontmatter"))
    kind = "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
    same = field(of, names, kind) == F.lit(value)
    listed = F.array_contains(field(of, names, "array<string>"), str(value).lower() if isinstance(value, bool) else str(value))
    return chunks.where(F.coalesce(same, F.lit(False)) | F.coalesce(listed, F.lit(False)))
