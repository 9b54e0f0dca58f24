"""Typed values, dates and value tests. The three value tests differ on purpose: each belongs to another stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_NULL = lambda c: F.coalesce(c, F.lit(""))


def xsd_type_of(kind: T.DataType) -> str:
    """Of a column, from its declared type: no data is read."""
    if isinstance(kind, T.BooleanType):
        return "xsd:boolean"
    if isinstance(kind, T.IntegralType):
        return "xsd:integer"
    if isinstance(kind, (T.DecimalType, T.FractionalType)):
        return "xsd:decimal"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "xsd:dateTime"
    return "xsd:date" if isinstance(kind, T.DateType) else "xsd:string"


def value_text(c: Column, kind: T.DataType) -> Column:
    """Null is empty; dates in ISO form; nested values as JSON."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micro = F.date_format(c, "SSSSSS")
        text = F.when(micro == "000000", whole).otherwise(F.concat(whole, F.lit("."), micro))
    elif isinstance(kind, T.BinaryType):
        text = F.decode(c, "UTF-8")
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def is_value(s: Column) -> Column:
    """For cells: empty, a date, without letters, or a number with a short unit and perhaps a short word."""
    t = F.trim(NOT_NULL(s))
    return (t == "") | t.rlike("^\\d{4}[-./]\\d{1,2}") | ~t.rlike("\\p{L}") | t.rlike("^[+\\-]?[\\d,.]+\\s*[^\\d\\s]{0,4}(\\s+\\S{1,3})?$")


def is_value_like(s: Column) -> Column:
    """For graph nodes: without letters (not empty), or a number with up to four other characters."""
    t = F.trim(NOT_NULL(s))
    return (t != "") & (~t.rlike("\\p{L}") | t.rlike("^[\\s(\\[]*[+\\-]?[\\d,.]+\\s*[^\\d]{0,4}[)\\]]*$"))


def is_value_label(s: Column) -> Column:
    """For quality reports: digits and separators alone, or a single character."""
    t = F.trim(NOT_NULL(s))
    return (t != "") & (t.rlike("^[\\d\\-./\\s,]+$") | (F.length(t) < 2))


def is_entity_shape(s: Column, longest: int = 80) -> Column:
    n = NOT_NULL(s)
    return (n != "") & (F.length(n) <= longest) & n.rlike("\\p{L}") & ~is_value_like(n)


def is_class_name(s: Column) -> Column:
    """Two characters at least, six words at most, shaped like a header."""
    t = F.trim(NOT_NULL(s))
    return (F.length(t) >= 2) & (F.size(F.split(t, "\\s+")) <= 6) & (F.length(t) <= 40) & ~is_value(t) & t.rlike("^[\\p{L}\\p{N}\"\\p{Ps}\\p{Pi}]") & ~t.rlike("[.!?。！？,;:\\p{S}]$")


def looks_like_header(s: Column) -> Column:
    t = F.trim(NOT_NULL(s))
    return (t == "") | (~is_value(t) & (F.length(t) <= 40) & t.rlike("^[\\p{L}\\p{N}\"\\p{Ps}\\p{Pi}]") & ~t.rlike("[.!?。！？,;:]$"))


def is_code_value(s: Column) -> Column:
    t = F.trim(NOT_NULL(s))
    return t.rlike("\\d") & (F.length(F.regexp_replace(t, "[^\\p{L}]", "")) <= 1)


def looks_like_date(s: Column) -> Column:
    t = F.trim(NOT_NULL(s))
    packed = t.rlike("^(19|20)\\d{2}(0[1-9]|1[0-2])\\d{2}$")
    return packed | t.rlike("^\\d{4}[-./]\\d{1,2}[-./]\\d{1,2}$") | t.rlike("^\\d{4}년\\s*\\d{1,2}월\\s*\\d{1,2}일$") | t.rlike("^\\d{4}[-./]\\d{1,2}$")


def normalize_date(s: Column) -> Column:
    """To YYYY-MM-DD, or YYYY-MM; else as it is."""
    t = F.trim(NOT_NULL(s))
    parts = F.regexp_extract_all(t, F.lit("(\\d+)"), F.lit(1))
    two = lambda i: F.lpad(F.get(parts, F.lit(i)), 2, "0")
    packed = F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))
    joined = F.when(F.size(parts) >= 3, F.concat_ws("-", F.get(parts, F.lit(0)), two(1), two(2))).otherwise(F.concat_ws("-", F.get(parts, F.lit(0)), two(1)))
    return F.when(t.rlike("^\\d{8}$") & looks_like_date(t), packed).when(looks_like_date(t), joined).otherwise(s)


def auto_xsd_type(s: Column) -> Column:
    t = F.trim(NOT_NULL(s))
    return F.when(t.rlike("^[+\\-]?\\d+$"), "xsd:integer").when(t.rlike("^[+\\-]?\\d+\\.\\d+$"), "xsd:decimal").when(t.rlike("^\\d{4}-\\d{2}-\\d{2}"), "xsd:date").otherwise("xsd:string")


def clean_value(s: Column) -> Column:
    """Without a parenthesis after a number or a date."""
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(NOT_NULL(s)), "^([+\\-]?[\\d][\\d,.\\-/]*[^\\s(]{0,4})\\s*\\([^()]*\\)$", 1), F.lit("")), s)


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def schema_max_items(max_tokens: int, per_item: float = 0.0) -> int:
    """How many items a model's answer can hold."""
    return max(8, min(60, int(max_tokens * 0.8 / (per_item or 45))))
