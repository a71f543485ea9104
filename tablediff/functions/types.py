"""Common types: names, how five systems call theirs, and what Spark has for them."""

from __future__ import annotations

from pyspark.sql import types as T

# The common type names and each system's own names for them.
COMMON_TYPES = ("string", "text", "uuid", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "decimal", "boolean", "date", "datetime", "timestamp", "time", "binary", "json", "array", "object")
SNOWFLAKE = {"VARCHAR": "string", "CHAR": "string", "TEXT": "text", "STRING": "string", "NUMBER": "decimal", "DECIMAL": "decimal", "NUMERIC": "decimal", "INT": "int64", "INTEGER": "int64", "BIGINT": "int64", "SMALLINT": "int16", "TINYINT": "int8", "FLOAT": "float64", "FLOAT4": "float32", "FLOAT8": "float64", "DOUBLE": "float64", "REAL": "float32", "BOOLEAN": "boolean", "DATE": "date", "DATETIME": "datetime", "TIME": "time", "TIMESTAMP": "timestamp", "TIMESTAMP_LTZ": "timestamp", "TIMESTAMP_NTZ": "timestamp", "TIMESTAMP_TZ": "timestamp", "VARIANT": "json", "OBJECT": "object", "ARRAY": "array", "GEOGRAPHY": "string", "GEOMETRY": "string", "BINARY": "binary", "VARBINARY": "binary"}
POSTGRESQL = {"varchar": "string", "char": "string", "text": "text", "character": "string", "character varying": "string", "int2": "int16", "int4": "int32", "int8": "int64", "smallint": "int16", "integer": "int32", "bigint": "int64", "decimal": "decimal", "numeric": "decimal", "real": "float32", "float4": "float32", "double precision": "float64", "float8": "float64", "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "timestamp", "timestamptz": "timestamp", "timestamp with time zone": "timestamp", "timestamp without time zone": "timestamp", "time": "time", "timetz": "time", "json": "json", "jsonb": "json", "uuid": "uuid", "bytea": "binary", "array": "array", "point": "string", "line": "string", "lseg": "string", "box": "string", "path": "string", "polygon": "string", "circle": "string"}
MYSQL = {"VARCHAR": "string", "CHAR": "string", "TEXT": "text", "TINYTEXT": "string", "MEDIUMTEXT": "text", "LONGTEXT": "text", "TINYINT": "int8", "SMALLINT": "int16", "MEDIUMINT": "int32", "INT": "int32", "INTEGER": "int32", "BIGINT": "int64", "DECIMAL": "decimal", "NUMERIC": "decimal", "FLOAT": "float32", "DOUBLE": "float64", "REAL": "float64", "BIT": "boolean", "BOOLEAN": "boolean", "DATE": "date", "DATETIME": "datetime", "TIMESTAMP": "timestamp", "TIME": "time", "YEAR": "int16", "JSON": "json", "BINARY": "binary", "VARBINARY": "binary", "BLOB": "binary", "TINYBLOB": "binary", "MEDIUMBLOB": "binary", "LONGBLOB": "binary", "ENUM": "string", "SET": "string"}
BIGQUERY = {"STRING": "string", "BYTES": "binary", "INTEGER": "int64", "INT64": "int64", "FLOAT": "float64", "FLOAT64": "float64", "NUMERIC": "decimal", "BIGNUMERIC": "decimal", "BOOLEAN": "boolean", "BOOL": "boolean", "TIMESTAMP": "timestamp", "DATE": "date", "TIME": "time", "DATETIME": "datetime", "JSON": "json", "ARRAY": "array", "STRUCT": "object", "GEOGRAPHY": "string"}
DATABRICKS = {"STRING": "string", "BINARY": "binary", "BOOLEAN": "boolean", "BYTE": "int8", "SHORT": "int16", "INT": "int32", "LONG": "int64", "FLOAT": "float32", "DOUBLE": "float64", "DECIMAL": "decimal", "DATE": "date", "TIMESTAMP": "timestamp", "ARRAY": "array", "MAP": "object", "STRUCT": "object", "VOID": "string"}
SYSTEMS = {"snowflake": SNOWFLAKE, "postgresql": POSTGRESQL, "mysql": MYSQL, "bigquery": BIGQUERY, "databricks": DATABRICKS}

_TO_SPARK = {"int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float32": T.FloatType(), "float64": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "array": T.ArrayType(T.StringType()), "object": T.MapType(T.StringType(), T.StringType())}
_FROM_SPARK = ((T.ByteType, "int8"), (T.ShortType, "int16"), (T.IntegerType, "int32"), (T.LongType, "int64"), (T.FloatType, "float32"), (T.DoubleType, "float64"), (T.DecimalType, "decimal"), (T.BooleanType, "boolean"), (T.DateType, "date"), (T.TimestampNTZType, "datetime"), (T.TimestampType, "timestamp"), (T.BinaryType, "binary"), (T.ArrayType, "array"), (T.StructType, "object"), (T.MapType, "object"))


def systems() -> list[str]:
    return list(SYSTEMS)


def common_types() -> list[str]:
    return list(COMMON_TYPES)


def native_types(system: str) -> list[str]:
    return list(_table(system))


def _table(system: str) -> dict[str, str]:
    if system.lower() not in SYSTEMS:
        raise ValueError(f"Unsupported data source: {system}")
    return SYSTEMS[system.lower()]


def map_type(system: str, native: str) -> str:
    """The common type of a system's own type: by name, then without parameters, then as Spark would read it, else string."""
    table = {k.upper(): v for k, v in _table(system).items()}
    name = native.strip().upper()
    for known in (name, name.split("(")[0].strip(), name.split("<")[0].strip()):
        if known in table:
            return table[known]
    if system.lower() == "databricks":
        return next((c for k, c in {"BIGINT": "int64", "SMALLINT": "int16", "TINYINT": "int8", "INTEGER": "int32", "TIMESTAMP_NTZ": "datetime"}.items() if k == name), "string")
    return "string"


def to_spark(common: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    if common not in COMMON_TYPES:
        raise ValueError(f"Unknown common type: {common}")
    if common == "decimal":
        return T.DecimalType(38 if precision is None else precision, (18 if precision is None else 0) if scale is None else scale)
    return _TO_SPARK.get(common, T.StringType())


def from_spark(kind: T.DataType) -> str:
    """The common type of a Spark type; also what file sources report."""
    return next((name for cls, name in _FROM_SPARK if isinstance(kind, cls)), "string")
