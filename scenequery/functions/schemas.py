"""JSON schemas compiled to column expressions over VARIANT: what is wrong with each document, as an array of messages.

A schema becomes one expression, so documents are checked where they are, without Python. ``$ref`` reaches into ``$defs`` of the same
schema and into others by name; a reference that leads back to itself is followed ``DEEPEST`` times.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DEEPEST = 6
#: How the types of JSON schemas begin in the text of a VARIANT's type.
KINDS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "number": "BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT"}


@dataclass(frozen=True)
class Value:
    """A VARIANT and the text of its type, both taken out once and then read by all checks of it."""

    v: Column
    kind: Column

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.v, "$", kind)


def _none() -> Column:
    return F.array().cast("array<string>")


def _once(v: Column, told: Callable[[Value], Column]) -> Column:
    """Messages ``told`` of a value that is worked out once, however often they read it."""
    each = F.transform(F.array(v), lambda x: F.struct(x.alias("v"), F.schema_of_variant(x).alias("k")))
    return F.flatten(F.transform(each, lambda s: told(Value(s["v"], s["k"]))))


class Compiler:
    def __init__(self, schemas: dict[str, dict]):
        self.schemas = schemas

    def problems(self, name: str, document: Column) -> Column:
        """Messages for a VARIANT column; one for a document that is no JSON (null after try_parse_json)."""
        return _once(document, lambda x: F.when(x.v.isNull(), F.array(F.lit("$: not JSON"))).otherwise(self._check(self.schemas[name], name, x, F.lit("$"), ())))

    def _resolve(self, ref: str, file: str) -> tuple[dict, str]:
        place, _, inner = ref.partition("#")
        file = place.removeprefix("./") or file
        found = self.schemas[file]
        for part in filter(None, inner.split("/")):
            if part not in found:
                raise ValueError(f"{ref} of {file} leads nowhere")
            found = found[part]
        return found, file

    def _check(self, schema: dict, file: str, v: Value, at: Column, seen: tuple) -> Column:
        if "$ref" in schema:
            target, file = self._resolve(schema["$ref"], file)
            if seen.count((file, schema["$ref"])) >= DEEPEST:
                return self._say(~F.is_variant_null(v.v), at, F.lit("nested too deep"))
            return self._check(target, file, v, at, (*seen, (file, schema["$ref"])))
        first = []
        if "const" in schema:
            first.append((~self._equals(v, schema["const"]), F.lit(f"not {json.dumps(schema['const'])}")))
        if "enum" in schema:
            same = F.lit(False)
            for e in schema["enum"]:
                same = same | self._equals(v, e)
            first.append((~same, F.lit(f"not one of {json.dumps(schema['enum'])}")))
        if "type" in schema:
            kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            fits = F.lit(False)
            for kind in kinds:
                fits = fits | self._is(v, kind)
            first.append((~fits, F.lit(f"not of type {' or '.join(kinds)}")))
        rest = [*self._numbers(schema, v, at), *self._texts(schema, v, at), *self._arrays(schema, file, v, at, seen), *self._objects(schema, file, v, at, seen)]
        if "anyOf" in schema:
            branches = [self._check(s, file, v, at, seen) for s in schema["anyOf"]]
            none = F.lit(True)
            for b in branches:
                none = none & (F.size(b) > 0)
            rest.append(self._say(none, at, F.lit("fits no branch")))
        out = F.concat(*rest) if rest else _none()
        for bad, text in reversed(first):
            out = F.when(bad, F.array(F.concat(at, F.lit(": "), text))).otherwise(out)
        return out

    @staticmethod
    def _say(bad: Column, at: Column, text: Column) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(at, F.lit(": "), text))).otherwise(_none())

    @staticmethod
    def _is(v: Value, kind: str) -> Column:
        if kind == "integer":
            number = v.get("double")
            return v.kind.rlike(f"^({KINDS['number']})") & (number == F.floor(number))
        return v.kind.rlike(f"^({KINDS[kind]})")

    def _equals(self, v: Value, value) -> Column:
        if value is None:
            return F.is_variant_null(v.v)
        if isinstance(value, bool):
            return self._is(v, "boolean") & F.coalesce(v.get("boolean") == value, F.lit(False))
        if isinstance(value, (int, float)):
            return self._is(v, "number") & F.coalesce(v.get("double") == float(value), F.lit(False))
        if isinstance(value, str):
            return self._is(v, "string") & F.coalesce(v.get("string") == value, F.lit(False))
        return F.to_json(v.v) == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def _numbers(self, schema: dict, v: Value, at: Column) -> list[Column]:
        number = F.when(self._is(v, "number"), v.get("double"))
        out = [self._say(number < float(schema["minimum"]), at, F.lit(f"below {schema['minimum']}"))] if "minimum" in schema else []
        return out + ([self._say(number > float(schema["maximum"]), at, F.lit(f"above {schema['maximum']}"))] if "maximum" in schema else [])

    def _texts(self, schema: dict, v: Value, at: Column) -> list[Column]:
        text = F.when(self._is(v, "string"), v.get("string"))
        out = [self._say(F.char_length(text) < schema["minLength"], at, F.lit(f"shorter than {schema['minLength']}"))] if "minLength" in schema else []
        return out + ([self._say(~text.rlike(schema["pattern"]), at, F.lit(f"not of the form {schema['pattern']}"))] if "pattern" in schema else [])

    def _arrays(self, schema: dict, file: str, v: Value, at: Column, seen: tuple) -> list[Column]:
        items = F.when(self._is(v, "array"), v.get("array<variant>"))
        out = []
        if "minItems" in schema:
            out.append(self._say(F.size(items) < schema["minItems"], at, F.lit(f"fewer than {schema['minItems']} items")))
        if "maxItems" in schema:
            out.append(self._say(F.size(items) > schema["maxItems"], at, F.lit(f"more than {schema['maxItems']} items")))
        if isinstance(schema.get("items"), dict):
            each = F.transform(items, lambda x, i: _once(x, lambda e: self._check(schema["items"], file, e, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), seen)))
            out.append(F.coalesce(F.flatten(each), _none()))
        return out

    def _objects(self, schema: dict, file: str, v: Value, at: Column, seen: tuple) -> list[Column]:
        here, out = self._is(v, "object"), []
        member = lambda name: F.try_variant_get(v.v, f"$['{name}']", "variant")
        for name in schema.get("required", []):
            out.append(self._say(here & member(name).isNull(), at, F.lit(f"{name} is missing")))
        for name, inner in schema.get("properties", {}).items():
            told = _once(member(name), lambda m, inner=inner, place=f".{name}": F.when(m.v.isNotNull(), self._check(inner, file, m, F.concat(at, F.lit(place)), seen)).otherwise(_none()))
            out.append(F.when(here, told).otherwise(_none()))
        if schema.get("additionalProperties") is False:
            names = F.when(here, F.json_object_keys(F.to_json(v.v)))
            unknown = F.filter(names, lambda n: ~n.isin(*(schema.get("properties") or [""])))
            out.append(F.coalesce(F.transform(unknown, lambda n: F.concat(at, F.lit("."), n, F.lit(": unknown"))), _none()))
        return out


def problems(text: Column, name: str, schemas: dict[str, dict]) -> Column:
    """What is wrong with JSON texts by the schema called ``name``: an array of messages, empty where they are valid."""
    return Compiler(schemas).problems(name, F.try_parse_json(text))
