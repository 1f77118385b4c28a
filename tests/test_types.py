import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.types import Schema, parse_type


@pytest.mark.parametrize("text,good", [("int", True), ("byte", True), ("char(10)", True), ("text(5)", True), ("char", False), ("int(4)", False), ("number", False), ("double", True), ("", False), ("date", True)])
def test_grammar(text, good):
    assert (parse_type(text) is not None) == good
    if good:
        assert str(parse_type(text)) == text


def test_schema_operations():
    s = Schema("employee", [("id", "int"), ("dob", "char(10)"), ("salary", "int")])
    assert str(s) == "employee[(id,int),(dob,char(10)),(salary,int)]"
    assert s.match(Schema.from_json(s.to_json())) and s.match(s.rename("e2", {f: f for f in s.fields}))
    assert s.rename("e2", {"id": "id2", "dob": "dob2", "salary": "salary2"}).fields == ["id2", "dob2", "salary2"]
    with pytest.raises(KeyError):
        s.rename("e2", {"id": "id2"})
    with pytest.raises(ValueError):
        s.project("p", ["nope"])
    with pytest.raises(ValueError):
        Schema("bad", [("a", "char")])
    assert s.defaults() == {"id": 0, "dob": "", "salary": 0}
    assert not s.match(Schema("x", [("dob", "char(10)"), ("id", "int"), ("salary", "int")]))


def test_casts(spark):
    s = Schema("t", [("a", "int"), ("b", "char(3)"), ("c", "byte")])
    df = spark.createDataFrame([("1", "abcdef", "200"), ("2", "a  ", "0")], "x string, y string, z string")
    assert [tuple(r) for r in s.from_strings(df).collect()] == [(1, "abc", 200), (2, "a", 0)]
    assert s.from_strings(df).schema["a"].dataType == T.IntegerType()
    with pytest.raises(PySparkException):
        s.from_strings(df.withColumn("z", F.lit("300"))).collect()
