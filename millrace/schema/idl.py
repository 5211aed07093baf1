"""Interface definitions: text to struct types, nested, flat or flattened."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of base types.
BASE = {
    "void": "void", "bool": "bool", "byte": "byte", "i8": "byte", "char": "byte", "i16": "i16", "i32": "i32", "int": "i32", "i64": "i64", "long": "i64",
    "double": "double", "float": "double", "string": "string", "binary": "binary",
}
SPARK = {"void": T.NullType(), "bool": T.BooleanType(), "byte": T.ByteType(), "i16": T.IntegerType(), "i32": T.IntegerType(), "i64": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType()}


class Kind(NamedTuple):
    """A wire type: a base name, or list, set, map or struct with its parts."""

    name: str
    args: tuple = ()  # kinds of a container
    fields: tuple = ()  # (id, name, kind) of a struct


def strip_comments(text: str) -> str:
    return re.sub(r"/\*.*?\*/|//[^\n]*|#[^\n]*", " ", text, flags=re.S)


def base_type(token: str) -> str | None:
    return BASE.get(token.lower())


def _tokens(text: str) -> list[str]:
    return re.findall(r"[A-Za-z_][\w.]*|-?\d+|[{}<>,;:()=]|\"[^\"]*\"|'[^']*'|\S", strip_comments(text))


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str = "") -> str:
        token = self.peek()
        if want and token != want or not token:
            raise ValueError(f"expected {want or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def kind(self) -> tuple:
        name = self.take()
        if name.lower() in ("list", "set", "map") and self.peek() == "<":
            self.take("<")
            args = [self.kind()]
            while self.peek() == ",":
                self.take()
                args.append(self.kind())
            self.take(">")
            if len(args) != (2 if name.lower() == "map" else 1):
                raise ValueError(f"{name} of {len(args)} types")
            return (name.lower(), *args)
        return (name,)

    def structs(self) -> dict[str, list[tuple[int, str, tuple]]]:
        found: dict[str, list] = {}
        while self.peek():
            if self.take() not in ("struct", "exception", "union"):
                continue
            name, fields, number = self.take(), [], 0
            self.take("{")
            while self.peek() != "}":
                number += 1
                if re.fullmatch(r"-?\d+", self.peek()):
                    number = int(self.take())
                    self.take(":")
                if self.peek() in ("required", "optional"):
                    self.take()
                kind = self.kind()
                fields.append((number, self.take(), kind))
                if self.peek() == "=":  # a default
                    self.take()
                    self.take()
                if self.peek() in (",", ";"):
                    self.take()
            self.take("}")
            found[name] = fields
        return found


def parse_structs(text: str) -> dict[str, list[tuple[int, str, tuple]]]:
    """name -> [(field id, name, type expression)]; fields without an id count from 1."""
    return _Parser(text).structs()


def kind_of(text: str, struct: str) -> Kind:
    """The struct with all types resolved. Unknown structs, struct keys and recursion are errors."""
    structs = parse_structs(text)

    def resolve(expr: tuple, open_: tuple) -> Kind:
        if expr[0] in ("list", "set", "map"):
            args = tuple(resolve(a, open_) for a in expr[1:])
            if expr[0] == "map" and args[0].name in ("list", "set", "map", "struct"):
                raise ValueError("map keys must be primitive")
            return Kind(expr[0], args)
        if base := base_type(expr[0]):
            return Kind(base)
        if expr[0] not in structs:
            raise ValueError(f"unknown struct {expr[0]}")
        if expr[0] in open_:
            raise ValueError(f"struct {expr[0]} holds itself")
        return Kind("struct", (), tuple((n, name, resolve(k, (*open_, expr[0]))) for n, name, k in structs[expr[0]]))

    return resolve((struct,), ())


def spark_type(kind: Kind) -> T.DataType:
    if kind.name in ("list", "set"):
        return T.ArrayType(spark_type(kind.args[0]))
    if kind.name == "map":
        return T.MapType(spark_type(kind.args[0]), spark_type(kind.args[1]))
    if kind.name == "struct":
        return T.StructType([T.StructField(name, spark_type(k), True, {"thrift_id": n}) for n, name, k in kind.fields])
    return SPARK[kind.name]


def schema_of(text: str, struct: str) -> T.StructType:
    return spark_type(kind_of(text, struct))


def id_map(schema: T.StructType) -> dict[int, int]:
    """Field id -> index."""
    return {f.metadata["thrift_id"]: i for i, f in enumerate(schema.fields)}


def _flat(t: T.DataType) -> bool:
    return not isinstance(t, (T.ArrayType, T.MapType, T.StructType))


def flat_schema(schema: T.StructType, sep: str = "_") -> T.StructType:
    """Struct fields become parent_child; collections may hold primitives only."""
    out = T.StructType()
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            for inner in flat_schema(f.dataType, sep).fields:
                out.add(f"{f.name}{sep}{inner.name}", inner.dataType)
            continue
        parts = [f.dataType.elementType] if isinstance(f.dataType, T.ArrayType) else [f.dataType.keyType, f.dataType.valueType] if isinstance(f.dataType, T.MapType) else []
        if not all(map(_flat, parts)):
            raise ValueError(f"{f.name}: collections of a flat schema hold primitives only")
        out.add(f.name, f.dataType)
    return out


def _of_each(items: Column, name: str) -> Column:
    return F.transform(items, lambda x: x[name])


def _of_values(items: Column, name: str) -> Column:
    return F.transform_values(items, lambda _, x: x[name])


def flatten(schema: T.StructType, *, sep: str = "_", flatten_list: bool = False, flatten_map: bool = False) -> list[Column]:
    """Columns that take structs apart; on request lists and maps of structs become parallel lists and maps (one level)."""
    out: list[Column] = []

    def walk(fields, column: Column | None, name: str) -> None:
        for f in fields:
            own, label, t = (column[f.name] if column is not None else F.col(f.name)), f"{name}{sep}{f.name}" if name else f.name, f.dataType
            if isinstance(t, T.StructType):
                walk(t.fields, own, label)
            elif flatten_list and isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
                out.extend(_of_each(own, g.name).alias(f"{label}{sep}{g.name}") for g in t.elementType.fields)
            elif flatten_map and isinstance(t, T.MapType) and isinstance(t.valueType, T.StructType):
                out.extend(_of_values(own, g.name).alias(f"{label}{sep}{g.name}") for g in t.valueType.fields)
            else:
                out.append(own.alias(label))

    walk(schema.fields, None, "")
    return out


def describe(schema: T.StructType, raw: bool = False) -> str:
    """The schema as a tree, or as JSON."""
    return schema.json() if raw else schema.treeString()


def pick_idl(texts: dict[str, str], struct: str) -> str:
    """The name of the text that defines the struct."""
    for name in sorted(texts):
        if struct in parse_structs(texts[name]):
            return name
    raise ValueError(f"no definition of {struct}")
