"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt
from ..storage import discard, materialise, new_path, qualified

#: ASCII white space that separates words; everything else is part of a word.
WORD_SPACE = r"[\x20\x09-\x0D]+"

#: Rows up to which ``join_frequent`` broadcasts its right side (some tens of bytes each); beyond, a salted join.
BROADCAST_ROWS = 300_000
#: Tasks that the rows of one key are dealt to at least in a salted join.
JOIN_SALTS = 32


def join_frequent(rows: DataFrame, keys: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """``rows`` joined with ``keys``, a materialised table with one row for each value of ``on`` (nulls equal each other).

    A few keys may hold most rows. A small counted ``keys`` is broadcast;
    a larger one is repeated for each salt, and the rows of a key are dealt
    over the salts by ``spread``, a hash that tells them apart.
    """
    named = keys.select(*[F.col(c).alias(f"__k_{c}") for c in on], *[c for c in keys.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in on]
    if keys.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(named), same)
    else:
        salted = named.withColumn("__k_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
        joined = rows.withColumn("__salt", F.pmod(spread, F.lit(JOIN_SALTS)).cast("int")).join(salted, [*same, F.col("__salt") == F.col("__k_salt")]).drop("__salt", "__k_salt")
    return joined.drop(*[f"__k_{c}" for c in on])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas.

    A higher-order function evaluates what its lambda closes over again for
    each element; binding the value to a lambda variable avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of ``text``, split at ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPACE), lambda w: w != "")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(rows) if name == "documents" else rows
