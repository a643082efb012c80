"""Raw catalogue dumps (gzip TSV, one header line, ``\\N`` = NULL, no
quoting, all-string columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column order of the four dumps (only the order is fixed by
# the format; the names are ours).
DUMP_COLUMNS = {
    "title_basics": ["tconst", "title_type", "primary_title", "original_title", "is_adult",
                     "start_year", "end_year", "runtime_minutes", "genres"],
    "title_ratings": ["tconst", "average_rating", "num_votes"],
    "name_basics": ["nconst", "primary_name", "birth_year", "death_year",
                    "primary_profession", "known_for_titles"],
    "title_principals": ["tconst", "ordering", "nconst", "category", "job", "characters"],
}

def dump_schema(kind: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in DUMP_COLUMNS[kind]])


def decode_copy_escapes(c: F.Column) -> F.Column:
    """Undo the text-format backslash escapes (``\\\\``, ``\\t``, ``\\n``, ``\\r``):
    the parts between escaped backslashes are decoded, then joined by one."""
    def part(x):
        for letter, char in (("t", "\t"), ("n", "\n"), ("r", "\r")):
            x = F.replace(x, F.lit("\\" + letter), F.lit(char))
        return x
    whole = F.array_join(F.transform(F.split(c, r"\\\\"), part), "\\")
    return F.when(F.contains(c, F.lit("\\")), whole).otherwise(c)


def read_dump(spark: SparkSession, path: str, kind: str,
              partitions: int | None = None) -> DataFrame:
    """Read one dump with an explicit all-string schema (no inference).

    Quotes are kept literally (quoting is disabled), only ``\\N`` becomes NULL
    (an empty field, or one that a short line lacks, is an empty text) and
    backslash escapes are decoded. A gzip file is one unsplittable input
    split, so the result is repartitioned right after the scan to spread the
    typing work; pass ``partitions=0`` to keep the scan partitioning.
    """
    df = (spark.read.schema(dump_schema(kind))
          .option("sep", "\t").option("header", "true")
          .option("quote", "\u0000").option("escape", "\u0000")
          .option("mode", "PERMISSIVE").csv(path))
    # The reader gives NULL for an empty field; the NULL of the format is a text to it.
    df = df.select(*[F.when(F.coalesce(F.col(c), F.lit("")) != "\\N",
                            F.coalesce(decode_copy_escapes(F.col(c)), F.lit(""))).alias(c) for c in df.columns])
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions) if partitions else df


def write_dump(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write a DataFrame in the dump format (used to derive fixtures)."""
    (df.write.mode("overwrite").option("sep", "\t").option("header", "true")
     .option("quote", "\u0000").option("nullValue", "\\N").option("emptyValue", "")
     .option("compression", compression).csv(path))
