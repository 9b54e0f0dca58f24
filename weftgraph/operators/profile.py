"""Schema inference over tables: column types, key candidates, foreign keys, label columns.

A profile reads a bounded head of each table in the order of its key (20 rows for types, 30 for keys and
samples, as the rules say); label columns and row counts are aggregates over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.functions import values as V

TYPE_ROWS, KEY_ROWS = 20, 30
KEY_ENDINGS = ("_id", "_code", "_no", "id")


def cells(df: DataFrame, order: list[str], rows: int | None = None, table: str = "t") -> DataFrame:
    """(table, ordinal, column, row, value as trimmed text): unpivoted, of the first ``rows`` rows where that is given.

    ``row`` numbers the head alone; over all rows it is 0, for which no order is needed.
    """
    schema = {f.name: f.dataType for f in df.schema.fields}
    if rows is not None:
        df = df.orderBy(*order).limit(rows)
        df = df.withColumn("_row", F.row_number().over(W.orderBy(*order)))  # of at most ``rows`` rows
    else:
        df = df.withColumn("_row", F.lit(0))
    pairs = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.trim(V.value_text(F.col(c), t)).alias("value")) for i, (c, t) in enumerate(schema.items())])
    return df.select(F.lit(table).alias("table"), "_row", F.explode(pairs).alias("x")).select("table", "x.ordinal", "x.column", F.col("_row").alias("row"), "x.value")


def value_type(value: Column) -> Column:
    """Aggregate: xsd type of a column's values (blanks don't count)."""
    v = F.trim(value)
    some = v != ""
    n = F.count_if(some)
    whole, dec = v.rlike("^-?\\d+$"), v.rlike("^-?\\d+\\.\\d+$")
    date = ~whole & ~dec & v.rlike("^\\d{4}[-/]\\d{2}[-/]\\d{2}")
    flag = ~whole & ~dec & ~date & F.lower(v).isin("true", "false", "yes", "no")
    share = lambda c: F.count_if(some & c) / F.greatest(n, F.lit(1)) >= 0.7
    number = F.when(F.count_if(some & dec) > 0, "xsd:decimal").otherwise("xsd:integer")
    return F.when(n == 0, "xsd:string").when(share(whole | dec), number).when(share(date), "xsd:date").when(share(flag), "xsd:boolean").otherwise("xsd:string")


def column_types(head: DataFrame) -> DataFrame:
    """(table, ordinal, column, xsd_type) of cells()."""
    few = head.filter(F.col("row") <= TYPE_ROWS)
    return few.groupBy("table", "ordinal", "column").agg(value_type(F.col("value")).alias("xsd_type"))


def key_like(column: Column) -> Column:
    c = F.lower(column)
    ends = F.lit(False)
    for e in KEY_ENDINGS:
        ends = ends | F.endswith(c, F.lit(e))
    return ends | F.startswith(c, F.lit("id")) | c.isin("id", "code", "no")


def pk_candidates(head: DataFrame) -> DataFrame:
    """(table, ordinal, column): named like a key and distinct for 80 %; the first column where there is none."""
    few = head.filter(F.col("row") <= KEY_ROWS)
    per = few.groupBy("table", "ordinal", "column").agg((F.countDistinct("value") / F.count("*")).alias("distinct"))
    marked = per.withColumn("good", key_like(F.col("column")) & (F.col("distinct") >= 0.8))
    any_ = F.max("good").over(W.partitionBy("table"))
    return marked.withColumn("any", any_).filter("good or (not any and ordinal = 0)").select("table", "ordinal", "column")


def sample_values(head: DataFrame) -> DataFrame:
    """(table, ordinal, column, value): distinct, not blank, of the first rows."""
    return head.filter((F.col("row") <= KEY_ROWS) & (F.col("value") != "")).select("table", "ordinal", "column", "value").distinct()


def norm_column(c: Column) -> Column:
    """Without separators and one ending that says key."""
    n = F.regexp_replace(F.lower(c), "[_\\- ]", "")
    out = n
    for e in reversed(("id", "code", "no", "key", "num", "number")):
        out = F.when(F.endswith(n, F.lit(e)) & (F.length(n) > len(e)), F.substr(n, F.lit(1), F.length(n) - len(e))).otherwise(out)
    return out


def fk_relations(samples: DataFrame, types: DataFrame, keys: DataFrame, order: dict[str, int] | None = None) -> DataFrame:
    """(from_table, from_column, to_table, to_column) from shared names or shared values.

    ``order``: places of tables, for ties; else by name.
    """
    place = F.create_map(*[F.lit(x) for kv in (order or {"": 0}).items() for x in kv])
    tables = types.groupBy("table").agg(F.count("*").alias("width")).withColumn("place", F.coalesce(F.try_element_at(place, F.col("table")), F.lit(0)))
    sizes = samples.groupBy("table", "column").agg(F.countDistinct("value").alias("n"))
    cols = types.join(sizes, ["table", "column"], "left").join(tables, "table").join(keys.select("table", "column", F.lit(True).alias("key")), ["table", "column"], "left")
    named = F.lit(False)
    for e in KEY_ENDINGS:
        named = named | F.endswith(F.lower("column"), F.lit(e))
    # distinct samples are all different, so any filled numeric column without a key's name is data
    numeric = F.col("xsd_type").isin("xsd:integer", "xsd:decimal") & ~named & (F.coalesce("n", F.lit(0)) > 0)
    cols = cols.filter(~numeric).select("table", "column", "width", "place", F.coalesce("key", F.lit(False)).alias("key"), F.coalesce("n", F.lit(0)).alias("n"), norm_column(F.col("column")).alias("norm"))
    left = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])
    a, b = left(cols, "a"), left(cols, "b")
    va, vb = left(samples.select("table", "column", "value"), "a"), left(samples.select("table", "column", "value"), "b")
    shared = va.join(vb, (F.col("value_a") == F.col("value_b")) & (F.col("table_a") != F.col("table_b")))
    number = F.col("value_a").rlike("^[+\\-]*\\d*\\.?\\d+$|^[+\\-]*\\d+\\.$")
    overlap = shared.groupBy("table_a", "column_a", "table_b", "column_b").agg(F.count("*").alias("both"), F.min(number).alias("numbers"))
    # one name in several tables: the best key table is meant
    target = cols.filter("key").withColumn("match", (F.col("norm") != "") & (F.contains(F.lower("table"), F.col("norm")) | F.contains(F.col("norm"), F.lower("table"))))
    best = target.withColumn("_n", F.row_number().over(W.partitionBy("column").orderBy(F.desc("match"), "width", "place", "table"))).filter("_n = 1").select("column", F.col("table").alias("to_table"), F.col("n").alias("to_n"))
    same = cols.join(best, "column").filter("table <> to_table").join(overlap.select(F.col("table_a").alias("table"), F.col("column_a").alias("column"), F.col("table_b").alias("to_table"), F.col("column_b").alias("_c"), "both").filter("column = _c").drop("_c"), ["table", "column", "to_table"], "left")
    enough = (F.col("n") == 0) | (F.col("to_n") == 0) | (F.coalesce("both", F.lit(0)) / F.greatest("n", F.lit(1)) >= 0.3)
    same = same.filter(enough).select(F.col("table").alias("from_table"), F.col("column").alias("from_column"), "to_table", F.col("column").alias("to_column"))
    pairs = overlap.filter("column_a <> column_b").join(a, ["table_a", "column_a"]).join(b, ["table_b", "column_b"]).filter("n_a >= 2 and n_b >= 2 and key_b and not key_a")
    near = (F.col("norm_a") != "") & (F.col("norm_b") != "") & (F.contains(F.col("norm_b"), F.col("norm_a")) | F.contains(F.col("norm_a"), F.col("norm_b")))
    least = F.when(near, 0.3).otherwise(0.8)
    fits = (near | ~F.col("numbers")) & ((F.col("both") / F.col("n_a") >= least) | (F.col("both") / F.col("n_b") >= least))
    other = pairs.filter(fits).select(F.col("table_a").alias("from_table"), F.col("column_a").alias("from_column"), F.col("table_b").alias("to_table"), F.col("column_b").alias("to_column"))
    return same.unionByName(other).distinct()


def label_columns(all_cells: DataFrame) -> DataFrame:
    """(table, column): the first that names rows: texts, mostly distinct, better no codes."""
    v = all_cells.filter("value <> ''")
    per = v.groupBy("table", "ordinal", "column").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("d"),
        F.count_if(~V.is_value(F.col("value")) & (F.length("value") <= 40)).alias("texts"), F.count_if(V.is_code_value(F.col("value"))).alias("codes"),
    )
    good = per.filter("n >= 2 and texts / n >= 0.7 and d / n >= 0.6").withColumn("code", F.col("codes") * 2 > F.col("n"))
    return good.groupBy("table").agg(F.min_by("column", F.struct("code", "ordinal")).alias("column"))


def normalize_fk_relations(fks: list[dict], table: str, columns: list[str]) -> list[dict]:
    """Declared foreign keys, checked."""
    out = []
    for i, fk in enumerate(fks):
        fk = {"from_table": table, **fk}
        for need in ("from_column", "to_table", "to_column", "to_pk_column"):
            if not fk.get(need):
                raise ValueError(f"foreign key {i}: no {need}")
        if fk["from_table"] != table or fk["from_column"] not in columns:
            raise ValueError(f"foreign key {i}: {fk['from_table']}.{fk['from_column']} is not of {table}")
        if fk["to_column"] != fk["to_pk_column"]:
            raise ValueError(f"foreign key {i}: it must point at the target's key")
        out.append(fk)
    return out


def analyze(tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """types, keys, samples, fks and row counts of named (frame, order) tables."""
    head = None
    counts = None
    for name, (df, order) in tables.items():
        part = cells(df, order, KEY_ROWS, name)
        size = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        head = part if head is None else head.unionByName(part)
        counts = size if counts is None else counts.unionByName(size)
    types, keys, samples = column_types(head), pk_candidates(head), sample_values(head)
    return {"types": types, "keys": keys, "samples": samples, "rows": counts, "fks": fk_relations(samples, types, keys, {t: i for i, t in enumerate(tables)})}
