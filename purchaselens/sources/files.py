"""Import of CSV, TSV, JSON and Parquet."""

from __future__ import annotations

import posixpath
import re
import uuid

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import InvalidInput, check_table_name
from ..schema import conform

SUFFIXES = (".csv", ".tsv", ".json", ".parquet")


def check_path(path: str, root: str | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> str:
    """Refuse a foreign suffix and, if a root is given, anything outside it.

    Works on the text of the path, so it holds for object stores as for local folders.
    """
    if not isinstance(path, str):
        raise InvalidInput(f"path must be text, got {type(path).__name__}")

    def parts(p: str) -> tuple[str, str]:
        scheme, sep, rest = p.partition("://")
        if not sep:
            scheme, rest = "", p
        return ("" if scheme == "file" else scheme), posixpath.normpath(rest)

    scheme, clean = parts(path)
    suffix = posixpath.splitext(clean)[1].lower()
    if suffix not in suffixes:
        raise InvalidInput(f"unsupported suffix {suffix!r}; allowed: {', '.join(suffixes)}")
    if root is not None:
        root_scheme, base = parts(root)
        if scheme != root_scheme or not clean.startswith(base.rstrip("/") + "/"):
            raise InvalidInput(f"{path} lies outside {root}")
    return path


def _typed(df: DataFrame, schema: T.StructType | None, corrupt: str | None = None) -> DataFrame:
    if schema is None:
        return df
    if corrupt is None:
        return conform(df, schema)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema], corrupt)


def _tolerant(reader: DataFrameReader, corrupt: str | None) -> DataFrameReader:
    """Stop at a line that cannot be read, or keep its raw text in a column of its own."""
    if corrupt is None:
        return reader.option("mode", "FAILFAST")
    # Without the last option a line would be judged by the columns that are asked for only.
    return (
        reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
        .option("columnPruning", False)
    )


def _texts(names: list[str], corrupt: str) -> T.StructType:
    if corrupt in names:
        raise InvalidInput(f"the input has a column {corrupt!r} of its own")
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, corrupt]])


def import_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    sep: str = ",",
    multiline: bool = False,
    corrupt: str | None = None,
) -> DataFrame:
    """CSV with a header line. Give a schema where you can: inference reads the file twice.

    ``multiline`` allows line breaks inside quoted values, at the price that one file is
    read by one task. An empty field is NULL; a value that does not fit the schema stops the
    job.

    With a schema, columns are found by their name in the header, in any order, and cast; a
    missing one is refused, one that the schema does not name is left out.

    ``corrupt`` names a column to add: the raw text of a line with too few or too many fields, NULL
    for all others. Such a line then stops nothing; what it has of the other columns is kept (Spark
    refuses queries that ask for this column alone: name another one too). Without
    a schema all columns are text then.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        # Without a full pattern, inference takes texts like T1 for a time.
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
    )
    reader = _tolerant(reader, corrupt)
    if corrupt is not None:
        texts = reader.schema(_texts(reader.csv(path).columns, corrupt)).csv(path)
        return _typed(texts, schema, corrupt)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return _typed(reader.csv(path), schema)


def import_tsv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = False,
    corrupt: str | None = None,
) -> DataFrame:
    return import_csv(spark, path, schema, "\t", multiline, corrupt)


def import_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multiline: bool = False,
    corrupt: str | None = None,
) -> DataFrame:
    """JSON lines, or with ``multiline`` a pretty-printed array per file.

    A schema is read as it is; dates in JSON are text and are cast to it. ``corrupt`` names a column to
    add: the raw text of what is no JSON or does not fit the schema, NULL for all others.
    """
    reader = _tolerant(spark.read.option("multiLine", multiline), corrupt)
    if schema is None:
        df = reader.json(path)
        if corrupt is None or corrupt in df.columns:
            return df
        return df.withColumn(corrupt, F.lit(None).cast("string"))
    loose = T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.DateType) else f.dataType)
            for f in schema
        ]
    )
    if corrupt is not None:
        _texts(loose.names, corrupt)
        loose = T.StructType([*loose, T.StructField(corrupt, T.StringType())])
    return _typed(reader.schema(loose).json(path), schema, corrupt)


def import_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None, corrupt: str | None = None
) -> DataFrame:
    """Parquet has no lines to be corrupt; ``corrupt`` is a column of NULLs."""
    df = spark.read.parquet(path)
    if corrupt is not None:
        _texts(df.columns, corrupt)
        df = df.withColumn(corrupt, F.lit(None).cast("string"))
    return _typed(df, schema, corrupt)


def import_file(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    root: str | None = None,
    multiline: bool = False,
    corrupt: str | None = None,
) -> DataFrame:
    """Read by suffix; ``corrupt`` names a column for what cannot be read, else that stops the job."""
    suffix = posixpath.splitext(check_path(path, root))[1].lower()
    if suffix == ".csv":
        return import_csv(spark, path, schema, multiline=multiline, corrupt=corrupt)
    if suffix == ".tsv":
        return import_tsv(spark, path, schema, multiline, corrupt)
    if suffix == ".json":
        return import_json(spark, path, schema, multiline, corrupt)
    return import_parquet(spark, path, schema, corrupt)


def table_name_of(path: str) -> str:
    """File stem, lower-cased, blanks and dashes as underscores."""
    stem = posixpath.splitext(posixpath.basename(path.rstrip("/")))[0]
    return check_table_name(re.sub("[ -]", "_", stem.lower()))


def save_table(df: DataFrame, name: str, location: str | None = None) -> DataFrame:
    """Create or replace a table and return it.

    Rows are written to a new folder below ``location`` (or below the warehouse), and only then does the
    catalog's entry point there: until that one step, and if the job dies before it, the table has its
    old rows. A job that still reads the old folder is not disturbed; ``drop_old_rows`` removes such folders.
    A table whose columns change is dropped and created in the catalog, which readers may notice.
    """
    spark, name = df.sparkSession, check_table_name(name)
    root = (location or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}").rstrip("/")
    path = f"{root}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    quoted = path.replace("\\", "\\\\").replace("'", "\\'")
    if spark.catalog.tableExists(name):
        if spark.table(name).schema == spark.read.parquet(path).schema and _is_external(spark, name):
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{quoted}'")
            spark.catalog.refreshTable(name)
            return spark.table(name)
        spark.sql(f"DROP TABLE {name}")
    spark.catalog.createTable(name, path, "parquet")
    return spark.table(name)


def _is_external(spark: SparkSession, name: str) -> bool:
    return spark.catalog.getTable(name).tableType == "EXTERNAL"


def drop_old_rows(spark: SparkSession, name: str) -> list[str]:
    """Remove the folders of a table that a replacement has left behind; for when no job reads them."""
    name = check_table_name(name)
    current = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first().data_type
    path = spark._jvm.org.apache.hadoop.fs.Path(current)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in system.listStatus(path.getParent()):
        other = status.getPath()
        if other.getName().startswith("rows-") and other.getName() != path.getName():
            system.delete(other, True)
            gone.append(other.toString())
    return gone
