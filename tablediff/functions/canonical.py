"""Canonical text of values in SQL: the same text from every system for the same value, so that hashes made by unlike systems agree.

Whole numbers are plain digits, decimals have as many digits after the point as both sides need, booleans are true or false, dates
and timestamps ISO with six digits of a second (those with a zone in UTC), binary values lower-case hexadecimal. A type without such a text in a system
(floating point numbers, nested values) has none here: its values have to be read themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

WHOLE = ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64")


@dataclass(frozen=True)
class Dialect:
    """How a system writes what is needed here; {0} is the value, {p} and {s} are precision and scale."""

    text: str
    digest: str
    number: str
    decimal: str
    date: str
    timestamp: str
    binary: str | None = None
    zoned: str | None = None
    length: str = "char_length({0})"
    concat: bool = False
    divide: str = "({0}) / {1}"
    day: str = "date '{0}'"
    moment: str = "timestamp '{0}'"
    quote: str = '"'
    digits: int = 38
    whole: str | None = None
    types: dict = field(default_factory=dict)

    def joined(self, parts: list[str]) -> str:
        return f"concat({', '.join(parts)})" if self.concat and len(parts) > 1 else " || ".join(parts)

    def named(self, name: str) -> str:
        return self.quote + name.replace(self.quote, self.quote * 2) + self.quote


_DERBY_MOMENT = "substr(rtrim(cast({0} as char(29))) || case when locate('.', cast({0} as char(29))) = 0 then '.000000' else '000000' end, 1, 26)"
DIALECTS = {
    "postgresql": Dialect("cast({0} as text)", "md5({0})", "cast(cast('x' || substr({0}, 1, 15) as bit(60)) as bigint)", "cast(cast({0} as numeric({p}, {s})) as text)", "to_char({0}, 'YYYY-MM-DD')", "to_char({0}, 'YYYY-MM-DD HH24:MI:SS.US')", "encode({0}, 'hex')", "to_char({0} at time zone 'UTC', 'YYYY-MM-DD HH24:MI:SS.US')"),
    "mysql": Dialect("cast({0} as char)", "md5({0})", "cast(conv(substr({0}, 1, 15), 16, 10) as signed)", "cast(cast({0} as decimal({p}, {s})) as char)", "date_format({0}, '%Y-%m-%d')", "date_format({0}, '%Y-%m-%d %H:%i:%s.%f')", "lower(hex({0}))", concat=True, divide="({0}) div {1}", quote="`"),
    "snowflake": Dialect("cast({0} as varchar)", "md5({0})", "to_number(substr({0}, 1, 15), 'XXXXXXXXXXXXXXX')", "to_varchar(cast({0} as number({p}, {s})))", "to_char({0}, 'YYYY-MM-DD')", "to_char({0}, 'YYYY-MM-DD HH24:MI:SS.FF6')", "lower(hex_encode({0}))", "to_char(convert_timezone('UTC', {0}), 'YYYY-MM-DD HH24:MI:SS.FF6')", length="length({0})", divide="floor(({0}) / {1})"),
    "bigquery": Dialect("cast({0} as string)", "to_hex(md5({0}))", "cast(concat('0x', substr({0}, 1, 15)) as int64)", "format('%.{s}f', cast({0} as bignumeric))", "format_date('%Y-%m-%d', {0})", "format_datetime('%Y-%m-%d %H:%M:%E6S', {0})", "to_hex({0})", "format_timestamp('%Y-%m-%d %H:%M:%E6S', {0}, 'UTC')", concat=True, divide="div({0}, {1})", quote="`", whole="bignumeric"),
    "databricks": Dialect("cast({0} as string)", "md5({0})", "cast(conv(substr({0}, 1, 15), 16, 10) as bigint)", "cast(cast({0} as decimal({p}, {s})) as string)", "date_format({0}, 'yyyy-MM-dd')", "date_format({0}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", "lower(hex({0}))", "date_format({0}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", divide="({0}) div {1}", quote="`"),
    # Derby has no digest of its own: DERBY_FUNCTIONS make two of Java's known to it
    "derby": Dialect("rtrim(cast({0} as char(40)))", "md5_hex({0})", "hex_number(substr({0}, 1, 15), 16)", "rtrim(cast(cast({0} as decimal({p}, {s})) as char(40)))", "cast({0} as char(10))", _DERBY_MOMENT, length="length({0})", day="date('{0}')", moment="timestamp('{0}')", digits=31),
}
DERBY_FUNCTIONS = (
    "create function md5_hex(v varchar(32672)) returns varchar(32) language java parameter style java no sql external name 'org.apache.commons.codec.digest.DigestUtils.md5Hex'",
    "create function hex_number(v varchar(16), radix int) returns bigint language java parameter style java no sql external name 'java.lang.Long.parseLong'",
)


def dialect(system: str) -> Dialect:
    if system not in DIALECTS:
        raise ValueError(f"{system} has no canonical text here")
    return DIALECTS[system]


def canonical(system: str, kind: str, value: str, scale: int = 0) -> str | None:
    """SQL for the canonical text of a value (SQL itself) of a common type, or None where the system has none."""
    d = dialect(system)
    if kind in ("string", "text"):
        return value if system == "derby" else d.text.format(value)
    if kind in WHOLE:
        return d.text.format(value)
    if kind == "decimal":
        return d.decimal.format(value, p=d.digits, s=scale)
    if kind == "boolean":
        text = f"case when {value} then 'true' when not {value} then 'false' end"
        return f"rtrim({text})" if system == "derby" else text  # Derby makes both as long as the longer one
    if kind == "date":
        return d.date.format(value)
    if kind == "datetime":
        return d.timestamp.format(value)
    if kind == "timestamp":
        return (d.zoned or d.timestamp).format(value)
    if kind == "uuid":
        return f"lower({d.text.format(value)})"
    if kind == "binary" and d.binary:
        return d.binary.format(value)
    return None


def row_digest(system: str, texts: list[str]) -> str:
    """SQL for the digest of canonical texts in a row; null and empty differ and values cannot run together."""
    d = dialect(system)
    parts = [f"coalesce({d.joined([chr(39) + 'V' + chr(39), d.text.format(d.length.format(t)), chr(39) + ':' + chr(39), t])}, 'N')" for t in texts]
    return d.digest.format(d.joined(parts) if parts else "''")


def hashes_sql(system: str, named, keys: list[str], kinds: dict[str, str], table: str) -> str:
    """SQL for keys and a digest of the columns in kinds, which are of these common types; named quotes a name."""
    texts = {c: canonical(system, kind, named(c)) for c, kind in kinds.items()}
    if gone := [c for c, t in texts.items() if t is None]:
        raise ValueError(f"{system} has no canonical text for {', '.join(gone)}")
    return f"select {', '.join(map(named, keys))}, {row_digest(system, list(texts.values()))} as row_hash from {table}"


def digest_number(system: str, digest: str) -> str:
    """SQL for the first 15 hexadecimal digits of a digest as a whole number."""
    return dialect(system).number.format(digest)


def literal(system: str, value) -> str:
    """A key's value as SQL."""
    from datetime import date, datetime

    from .names import sql_literal

    d = dialect(system)
    if isinstance(value, datetime):
        return d.moment.format(value.strftime("%Y-%m-%d %H:%M:%S.%f"))
    if isinstance(value, date):
        return d.day.format(value.isoformat())
    if type(value).__name__ == "Decimal":
        return str(value)
    return sql_literal(value)
