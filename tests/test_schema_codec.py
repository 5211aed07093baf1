import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from millrace.codec import binary
from millrace.schema import idl

TEXT = """
/* block */ namespace java x // line
# hash
enum Color { RED = 1 }
struct Inner { 1: i32 a; 2: list<string> notes }
struct All {
  1: required BOOL flag, 2: byte b, 3: i16 s, 4: i32 i, 5: i64 l = 7, 6: double d, 7: string t,
  8: list<list<i32>> ll, 9: set<i64> ids, 10: map<string, list<Inner>> m, 11: Inner inner, 12: list<double> ds
  13: binary raw
}
struct Flat { i64 id; map<string, i64> m; Inner inner }
struct Maps { 1: map<string, Inner> m, 2: list<Inner> l }
struct Loop { 1: Loop next }
struct Bad { 1: Missing x }
struct Empty {}
"""


def test_types_and_ids():
    schema = idl.schema_of(TEXT, "All")
    assert [f.dataType for f in schema.fields][:7] == [T.BooleanType(), T.ByteType(), T.IntegerType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()]
    assert schema["ll"].dataType == T.ArrayType(T.ArrayType(T.IntegerType()))
    assert schema["m"].dataType.valueType.elementType.names == ["a", "notes"]
    assert idl.id_map(schema)[12] == schema.names.index("ds")
    assert idl.schema_of(TEXT, "Empty").fields == [] and "flag" in idl.describe(schema)
    assert idl.pick_idl({"a": "struct X {}", "b": TEXT}, "Flat") == "b"


@pytest.mark.parametrize("struct", ["Loop", "Bad", "Nowhere"])
def test_errors(struct):
    with pytest.raises(ValueError):
        idl.schema_of(TEXT, struct)


def test_map_keys_must_be_primitive():
    with pytest.raises(ValueError):
        idl.schema_of("struct K { 1: i32 a } struct M { 1: map<K, i32> m }", "M")


def test_flat_schema():
    assert idl.flat_schema(idl.schema_of("struct I { 1: i32 a } struct F { 1: I i, 2: list<i32> l }", "F")).names == ["i_a", "l"]
    with pytest.raises(ValueError):
        idl.flat_schema(idl.schema_of(TEXT, "All"))


def test_flatten_columns(spark):
    schema = idl.schema_of(TEXT, "Maps")
    df = spark.createDataFrame([({"x": Row(a=1, notes=["n"])}, [Row(a=2, notes=[])])], schema)
    out = df.select(*idl.flatten(schema, sep="__", flatten_list=True, flatten_map=True))
    assert out.columns == ["m__a", "m__notes", "l__a", "l__notes"] and out.first()["m__a"] == {"x": 1} and out.first()["l__a"] == [2]


FULL = {"flag": True, "b": -3, "s": 300, "i": -5, "l": 1 << 40, "d": 2.5, "t": "ünï", "ll": [[1, 2], []], "ids": [4, 4, 5], "m": {"k": [{"a": 1, "notes": ["x", "y"]}], "e": []}, "inner": {"a": 9}, "ds": [0.5, -1.0]}


def test_codec_roundtrip():
    kind = idl.kind_of(TEXT, "All")
    got = binary.decode_value(kind, binary.encode_value(kind, FULL))
    assert got["ids"] == [4, 5] and dict(got["m"]) == FULL["m"] and got["inner"] == {"a": 9} and "raw" not in got
    assert {k: got[k] for k in ("flag", "b", "s", "i", "l", "d", "t", "ll", "ds")} == {k: FULL[k] for k in ("flag", "b", "s", "i", "l", "d", "t", "ll", "ds")}


def test_unknown_fields_are_skipped():
    wide, narrow = idl.kind_of(TEXT, "All"), idl.kind_of("struct All { 7: string t, 99: i32 z }", "All")
    assert binary.decode_value(narrow, binary.encode_value(wide, FULL)) == {"t": "ünï"}
    assert binary.decode_value(idl.kind_of("struct All { 7: i64 t }", "All"), binary.encode_value(wide, FULL)) == {}


def test_decode_frame(spark):
    kind = idl.kind_of(TEXT, "All")
    rows = [(1, binary.encode_value(kind, FULL)), (2, None), (3, b"\x0b\x00\x07\x00"), (4, binary.encode_value(kind, {"t": "x"}))]
    df = spark.createDataFrame(rows, "id long, payload binary")
    out = {r["id"]: r for r in binary.decode(df, kind, keep=["id"]).collect()}
    assert out[1]["inner"]["a"] == 9 and out[1]["inner"]["notes"] is None and out[2]["t"] is None and out[3]["t"] is None and out[4]["ll"] is None
    assert binary.decode(df, kind, fields=["t"]).columns == ["t"]
    with pytest.raises(ValueError):
        binary.decode(df, kind, strategy="x")
