"""Tables in files: format by ending or by name, schema as given or read."""

from pyspark.sql import DataFrame, SparkSession

#: Formats by ending, and what each needs to give typed columns back.
FORMATS = {"parquet": {}, "orc": {}, "json": {}, "csv": {"header": "true", "inferSchema": "true"}, "txt": {}}
_READERS = {"txt": "text"}


def read_files(spark: SparkSession, path: str, format: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """A table of files of one format. With a schema nothing is inferred, so a table is read once only."""
    kind = (format or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind not in FORMATS:
        raise ValueError(f"format is one of {sorted(FORMATS)}")
    settings = FORMATS[kind] | {k: str(v) for k, v in options.items()}
    reader = spark.read.format(_READERS.get(kind, kind)).options(**settings)
    if schema:
        reader = reader.schema(schema).option("inferSchema", "false")
    return reader.load(path)


def write_files(rows: DataFrame, path: str, format: str | None = None, **options) -> None:
    """Writes a table so that read_files gives it back."""
    kind = (format or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind not in FORMATS:
        raise ValueError(f"format is one of {sorted(FORMATS)}")
    settings = {"header": "true"} if kind == "csv" else {}
    rows.write.format(_READERS.get(kind, kind)).options(**settings | {k: str(v) for k, v in options.items()}).save(path)
