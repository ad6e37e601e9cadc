"""Loaders of the known datasets, and sinks."""

from __future__ import annotations

import json
import math
import os
import tempfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain
from ..operators.query import q
from .readers import read_csv

SINTER_ID = "Sample No"
# Names of the experiments' columns, in the file and in the table.
EXPERIMENT_COLUMNS = {
    "Sinter": "sinter_pct", "Ore": "ore_pct", "Pellet": "pellet_pct", "T_Fe_%": "T_Fe_pct", "FeO_%": "FeO_pct", "SiO2_%": "SiO2_pct", "CaO_%": "CaO_pct", "Al2O3_%": "Al2O3_pct",
    "MgO%": "MgO_pct", "Basicity": "Basicity", "Ts": "Ts", "Td": "Td", "Tm": "Tm", "Tm-Ts": "Tm_Ts", "DelP": "DelP", "NDM": "NDM",
}


def with_time(df: DataFrame, text: str = "date", time: str = "datetime", form: str = "dd/MM/yyyy HH:mm") -> DataFrame:
    """``df`` in order of a time read from a text column."""
    return df.withColumn(time, F.try_to_timestamp(q(text), F.lit(form))).orderBy(time)


def read_energy(spark: SparkSession, path: str) -> DataFrame:
    return with_time(read_csv(spark, path))


def read_sinter(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The table, and its columns that may be features: all but the sample's number."""
    df = read_csv(spark, path)
    return df, [c for c in df.columns if c != SINTER_ID]


def complete(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows whose required columns read as numbers; a missing column is an error."""
    gone = [c for c in required if c not in df.columns]
    if gone:
        raise ValueError(f"Missing columns: {', '.join(gone)}")
    return domain.complete_rows(df, required)


def read_experiments(spark: SparkSession, path: str, repair: bool = True) -> tuple[DataFrame, list[str]]:
    """The experiments with ``row_index`` from 1 in file order, and what is wrong with
    them: texts that aren't numbers, gaps.  Differences that are off are repaired."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.strip().replace(" ", "_") for c in raw.columns))
    gone = [c for c in EXPERIMENT_COLUMNS if c not in raw.columns]
    if gone:
        raise ValueError(f"Missing columns: {', '.join(gone)}")
    numbered = raw.withColumn("_at", F.monotonically_increasing_id())
    from ..operators import order

    numbered = order.running(numbered.withColumn("_one", F.lit(1).cast("long")), "_at", "_one").withColumnRenamed("upto__one", "row_index").drop("_at", "_one")
    names = EXPERIMENT_COLUMNS.items()
    odd = numbered.agg(*(F.count_if(q(a).isNotNull() & q(a).try_cast("double").isNull()).alias(f"x{i}") for i, (a, _) in enumerate(names)), *(F.count_if(q(a).isNull()).alias(f"g{i}") for i, (a, _) in enumerate(names))).head()
    issues = [f"{b}: {odd[f'x{i}']} non-numeric value(s)" for i, (_, b) in enumerate(names) if odd[f"x{i}"]] + [f"{b}: {odd[f'g{i}']} missing value(s)" for i, (_, b) in enumerate(names) if odd[f"g{i}"]]
    df = numbered.select(*(q(a).try_cast("double").alias(b) for a, b in names), *(q(c) for c in raw.columns if c not in EXPERIMENT_COLUMNS), F.col("row_index").cast("long").alias("row_index"))
    return (domain.repaired(df) if repair else df).orderBy("row_index"), issues


def read_registered(spark: SparkSession, dataset_id: str, path: str) -> DataFrame:
    """A known dataset by its id, from a file or folder; an id that isn't known is an
    error."""
    readers = {"steel_energy": read_energy, "sinter_productivity": lambda s, p: read_sinter(s, p)[0], "blast_furnace": lambda s, p: read_experiments(s, p)[0]}
    if dataset_id not in readers:
        raise ValueError(f"Unknown dataset: {dataset_id}")
    return readers[dataset_id](spark, path)


def promoted(df: DataFrame, header: int = 1, unnamed: str = "Test Type") -> DataFrame:
    """A table whose names stand in one of its rows (from 0, in ``row``), which many
    exports have: the names are taken from it, that and the rows before it go, and a
    column without a name gets one.  ``row`` numbers the rows and goes too."""
    names = df.where(q("row") == header).drop("row").head()
    if names is None:
        raise ValueError("The row of names isn't there.")
    found = [str(n).strip() if n is not None and str(n).strip() else unnamed for n in names]
    if len(set(found)) != len(found):
        raise ValueError("Duplicate column names.")
    return df.where(q("row") > header).drop("row").toDF(*found)


# --- sinks ----------------------------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; a folder that is there already isn't touched."""
    df.write.mode("errorifexists").csv(path, header=True, lineSep="\n")


def write_matrix(df: DataFrame, features: list[str], path: str) -> None:
    """Feature vectors as Parquet, their names beside them."""
    df.select(F.array(*(q(c).cast("double") for c in features)).alias("features")).write.mode("errorifexists").parquet(f"{path}/matrix")
    df.sparkSession.createDataFrame(list(enumerate(features)), "place int, name string").coalesce(1).write.mode("errorifexists").json(f"{path}/names")


def write_once(path: str, content: bytes) -> bool:
    """Writes a file whole or not at all; false if it's there with these bytes, an error
    if with others."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            if f.read() != content:
                raise FileExistsError(f"{path} holds other content")
        return False
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)
    return True


def to_json(value: Any) -> str:
    """JSON of results; numbers that aren't finite become null."""

    def plain(x: Any) -> Any:
        if isinstance(x, float):
            return x if math.isfinite(x) else None
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple, set, frozenset)):
            return [plain(v) for v in x]
        return x if x is None or isinstance(x, (str, int, bool)) else str(x)

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True)
