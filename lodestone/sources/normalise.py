"""Normal forms of sources: tables as typed CSV that reads back equal, documents as texts
of a topic and sections that are cut into the same sections again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators.query import missing_free, q

#: How values are written: quotes double inside quotes, a null is nothing, an empty text is
#: a pair of quotes, times keep microseconds.
OPTIONS = {"header": True, "escape": '"', "quote": '"', "nullValue": "", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "dateFormat": "yyyy-MM-dd", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: What an empty text is read as before it's empty again; a text can't be this mark.
EMPTY = "\u0001"
FLAT = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def write_table(df: DataFrame, path: str) -> dict:
    """The manifest of a table written as CSV: row_count, columns, types, missing_values
    (of columns that have any), issues.  Doubles are written so that they read back
    equal; NaN is a missing value.  Nested columns are an error."""
    nested = [f.name for f in df.schema if not isinstance(f.dataType, FLAT)]
    if nested:
        raise ValueError(f"Nested values in: {', '.join(nested)}")
    df = missing_free(df)
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if texts and not df.where(F.greatest(F.lit(False), *(F.coalesce(q(c) == EMPTY, F.lit(False)) for c in texts))).isEmpty():
        raise ValueError("A text is the mark that stands for an empty one.")
    df.write.mode("errorifexists").options(**OPTIONS, emptyValue='""').csv(path)
    back = read_table(df.sparkSession, path, {"types": dict(df.dtypes)})
    counts = back.agg(F.count("*").alias("rows"), *(F.count_if(q(c).isNull()).alias(f"g{i}") for i, c in enumerate(df.columns))).head()
    gaps = {c: counts[f"g{i}"] for i, c in enumerate(df.columns) if counts[f"g{i}"]}
    return {
        "row_count": counts.rows, "column_count": len(df.columns), "columns": df.columns, "types": dict(df.dtypes), "missing_value_counts": gaps, "normalized_format": "csv",
        "issues": [f"{n} missing value(s) were retained in column '{c}'." for c, n in gaps.items()],
    }


def read_table(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """A normalised table with the types of its manifest."""
    schema = T.StructType([T.StructField(c, T.DataType.fromDDL(kind)) for c, kind in manifest["types"].items()])
    found = spark.read.schema(schema).options(**OPTIONS, emptyValue=EMPTY, multiLine=True, mode="FAILFAST").csv(path)
    return found.select(*(F.when(q(c) == EMPTY, "").otherwise(q(c)).alias(c) if kind == "string" else q(c) for c, kind in manifest["types"].items()))


def document_of(topic: Column, parts: Column) -> Column:
    """The text of a topic and of its sections, an array of (section, content)."""
    named = F.transform(parts, lambda s: F.concat(F.lit("\nSECTION: "), s["section"], F.lit("\n"), s["content"]))
    return F.array_join(F.concat(F.array(F.concat(F.lit("TOPIC: "), topic)), named), "\n")


def documents_of(chunks: DataFrame) -> DataFrame:
    """source, text: the normal form of each document from its chunks (of
    ``text.chunks``); cutting it gives the same topic, sections and contents."""
    parts = F.sort_array(F.collect_list(F.struct("position", "section", "content")))
    rows = chunks.groupBy("source").agg(F.first("topic").alias("topic"), parts.alias("parts"))
    return rows.select("source", document_of(F.col("topic"), F.col("parts")).alias("text"))


def write_documents(documents: DataFrame, path: str) -> dict:
    """The manifest of documents (source, text) written in their normal form: chunk_count,
    sections, document_count.  Documents without a section are an error."""
    cut = text.chunks(documents)
    normal = documents_of(cut)
    normal.write.mode("errorifexists").parquet(path)
    back = documents.sparkSession.read.parquet(path)
    counts = text.chunks(back).agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("documents"), F.sort_array(F.collect_set("section")).alias("sections")).head()
    if not counts.chunks:
        raise ValueError("Text source contains no indexable sections")
    return {"chunk_count": counts.chunks, "document_count": counts.documents, "sections": counts.sections, "normalized_format": "txt"}
