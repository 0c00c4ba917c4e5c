"""Schema families: versions in JSON payloads, migration plans and migration in columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = Callable[[Column], Column]


@dataclass
class Family:
    """A payload type's versions: a struct type for each, and the steps between them.

    steps[v] takes version v to v + 1: a function of the struct column, None for the default
    (drop unknown fields, null or default for new ones), or INCOMPATIBLE.
    """

    name: str
    versions: dict[int, T.StructType]
    steps: dict[int, Step | str | None] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    path: str = "$.version"

    @property
    def current(self) -> int:
        return max(self.versions)


INCOMPATIBLE = "incompatible"


def version_of(payload: Column, path: str = "$.version") -> Column:
    """The version in a JSON payload: an integer at path (not a boolean, a text or a fraction), else null."""
    parsed = F.try_parse_json(payload)
    whole = F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "BIGINT"
    return F.when(whole, F.try_variant_get(parsed, path, "bigint"))


def plan(family: Family, version: Column) -> Column:
    """Whether a row of a version can run: runnable:<steps>, newer, incompatible or unknown."""
    out = F.when(version.isNull() | (version < min(family.versions)), "unknown").when(version > family.current, "newer")
    for v in sorted(family.versions):
        barred = any(family.steps.get(k) == INCOMPATIBLE for k in range(v, family.current))
        out = out.when(version == v, "incompatible" if barred else f"runnable:{family.current - v}")
    return out.otherwise("unknown")


def conform(value: Column, have: T.StructType, want: T.StructType, defaults: dict[str, object]) -> Column:
    """value with exactly the fields of want: unknown ones dropped, new ones defaulted, structs inside lists, maps and structs alike."""
    known = {f.name: f.dataType for f in have.fields}
    out = []
    for f in want.fields:
        new = F.lit(defaults.get(f.name)).cast(f.dataType) if f.name not in known else _conformed(value[f.name], known[f.name], f.dataType, defaults)
        out.append(new.alias(f.name))
    return F.struct(*out)


def _conformed(value: Column, have: T.DataType, want: T.DataType, defaults: dict[str, object]) -> Column:
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        return F.when(value.isNotNull(), conform(value, have, want, defaults))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(value, lambda x: _conformed(x, have.elementType, want.elementType, defaults))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        return F.transform_values(value, lambda _, x: _conformed(x, have.valueType, want.valueType, defaults))
    return value.cast(want)


def migrate(family: Family, payload: Column, version: Column) -> Column:
    """The payload as a struct of the current version, one step at a time; null where it can't run."""
    out = None
    for v in sorted(family.versions):
        if any(family.steps.get(k) == INCOMPATIBLE for k in range(v, family.current)):
            continue
        value = F.from_json(payload, family.versions[v])
        for k in range(v, family.current):
            step = family.steps.get(k)
            value = step(value) if callable(step) else conform(value, family.versions[k], family.versions[k + 1], family.defaults)
        value = conform(value, family.versions[family.current], family.versions[family.current], family.defaults)
        out = F.when(version == v, value) if out is None else out.when(version == v, value)
    return out


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys and no white space, nulls kept; NaN and infinities are refused."""
    checked = [fields[k].alias(k) for k in sorted(fields)]
    return F.to_json(F.struct(*checked), {"ignoreNullFields": "false"})


def canonical(value: Column, kind: T.DataType) -> Column:
    """A value whose JSON is canonical: fields and map keys sorted at every depth, numbers finite."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(canonical(value[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.struct(k.alias("key"), canonical(value[k], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    return finite(value) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else value


def canonical_text(value: Column, kind: T.StructType) -> Column:
    """canonical_json() of a struct column of a known type."""
    return F.to_json(canonical(value, kind), {"ignoreNullFields": "false"})


def finite(value: Column) -> Column:
    """value, or an error where it is NaN or infinite."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("not finite")).cast("double")).otherwise(value)


_JSON_KINDS = {T.LongType: "BIGINT", T.IntegerType: "BIGINT", T.BooleanType: "BOOLEAN", T.StringType: "STRING", T.DoubleType: "BIGINT|DECIMAL.*|DOUBLE", T.StructType: "OBJECT.*", T.ArrayType: "ARRAY.*", T.MapType: "OBJECT.*"}


def problems(payload: Column, want: T.StructType, at: str = "") -> Column:
    """What is wrong with a JSON object for a type: unknown field counts, missing fields, wrong types, in structs at every depth. null fits any type."""
    names = [f.name for f in want.fields]
    keys = F.json_object_keys(payload)
    unknown = F.size(F.array_except(keys, F.array(*map(F.lit, names))))
    parsed = F.try_parse_json(payload)
    label = f"unknown:{at[:-1]}:" if at else "unknown:"
    out = [F.when(unknown > 0, F.array(F.concat(F.lit(label), unknown.cast("string"))))]
    for f in want.fields:
        own = F.schema_of_variant(F.try_variant_get(parsed, f"$.{f.name}", "variant"))
        kind = next((k for t, k in _JSON_KINDS.items() if isinstance(f.dataType, t)), ".*")
        wrong = F.array_contains(keys, f.name) & ~F.coalesce(own.rlike(f"^(?:{kind}|VOID)$"), F.lit(True))
        out.append(F.when(~F.array_contains(keys, f.name), F.array(F.lit(f"missing:{at}{f.name}"))))
        out.append(F.when(wrong, F.array(F.lit(f"type:{at}{f.name}"))))
        if isinstance(f.dataType, T.StructType):
            inner = F.get_json_object(payload, f"$.{f.name}")
            out.append(F.when(own.rlike("^OBJECT"), problems(inner, f.dataType, f"{at}{f.name}.")))
    found = F.flatten(F.array_compact(F.array(*out)))
    return F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(found)
