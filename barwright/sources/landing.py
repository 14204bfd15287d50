"""Landed JSON: endpoint envelopes and symbol-keyed stock documents.

A landed file holds one document or several, on a line each or indented; where one begins is seen
from the text, so that no caller can get it wrong and lose all but the first. What does not parse
stops the job that reads it and can be listed beforehand.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from barwright.schemas import ENDPOINT_RESULTS, STOCK_DOCUMENT, landing_schema

#: Fixed: the folder of a run date that files of a document per line go to.
LINES = "shape=lines"
_CORRUPT = "_corrupt"


def landing_path(base: str, endpoint: str, execution_date: str) -> str:
    return f"{base}/{endpoint}/ingestion_date={execution_date}"


def read_landing(
    spark: SparkSession,
    base: str,
    endpoint: str,
    execution_date: str,
    *,
    required: bool = True,
) -> DataFrame:
    """Envelopes of one endpoint and run date.

    Documents lie in the date's folder as a fetcher drops them, lines in a folder below it as
    :func:`barwright.sinks.land_envelopes` writes them; either or both may be there. None at all is
    an error unless ``required`` is off. A document that does not parse fails the reading job.
    """
    schema = landing_schema(ENDPOINT_RESULTS[endpoint])
    documents = _landed_texts(spark, base, endpoint, execution_date)
    if documents is None:
        if required:
            spark.read.text(landing_path(base, endpoint, execution_date))  # raises
        return spark.createDataFrame([], schema)
    # one check of a document, whatever number of its fields is read
    checked = _parsed(documents, schema).select(_or_stop(F.col("document")).alias("document"))
    return checked.select(*[F.col(f"document.{name}") for name in schema.names])


def parse_landing(spark: SparkSession, base: str, endpoint: str, execution_date: str) -> DataFrame:
    """``file, record, document`` for everything landed of one endpoint and run date, each document
    parsed once: ``document`` is the envelope of a good one, ``record`` the text of a bad one. Nothing
    landed gives no rows."""
    documents = _landed_texts(spark, base, endpoint, execution_date)
    schema = landing_schema(ENDPOINT_RESULTS[endpoint])
    if documents is None:
        return spark.createDataFrame([], parsed_schema(endpoint))
    parsed = _parsed(documents, schema).withColumn("bad", _rejected())
    envelope = F.struct(*[F.col(f"document.{name}").alias(name) for name in schema.names])
    return parsed.select("file", F.when(F.col("bad"), F.col("value")).alias("record"), F.when(~F.col("bad"), envelope).alias("document"))


def parsed_schema(endpoint: str) -> StructType:
    """The table of :func:`parse_landing`."""
    return StructType([StructField("file", StringType()), StructField("record", StringType()), StructField("document", landing_schema(ENDPOINT_RESULTS[endpoint]))])


def parsed_documents(parsed: DataFrame) -> DataFrame:
    """The envelopes of a table of :func:`parse_landing`; a bad document fails the job that reads them."""
    message = F.raise_error(F.concat(F.lit("not a landing document: "), F.col("file")))
    checked = parsed.select(F.when(F.col("record").isNotNull(), message).otherwise(F.col("document")).alias("document"))
    return checked.select("document.*")


def quarantined(parsed: DataFrame) -> DataFrame:
    """``file, record``: the bad documents of a table of :func:`parse_landing`."""
    return parsed.filter(F.col("record").isNotNull()).select("file", "record")


def rejected_landings(spark: SparkSession, base: str, endpoint: str, execution_date: str) -> DataFrame:
    """``file, record``: what of an endpoint's run date does not parse."""
    return quarantined(parse_landing(spark, base, endpoint, execution_date))


def read_stock_documents(spark: SparkSession, path: str) -> DataFrame:
    """Stock documents as ``map<symbol, prices>``, one row per document.

    ``path`` is a file or a folder of files; large files of a document per line go to a folder
    below it, where they can be split. A map column holds any number of symbols; a column per symbol
    would put them in the plan. A document that does not parse fails the reading job.
    """
    lines = _texts_or_none(spark, f"{path}/{LINES}", wholetext=False)
    documents = _lines(lines) if lines is not None else _documents(spark.read.text(path, wholetext=True))
    stocks = F.from_json("value", STOCK_DOCUMENT)
    bad = F.raise_error(F.concat(F.lit("not a stock document: "), F.col("file")))
    return documents.select(F.when(stocks.isNull(), bad.cast(STOCK_DOCUMENT)).otherwise(stocks).alias("stocks"))


def _landed_texts(spark: SparkSession, base: str, endpoint: str, execution_date: str) -> DataFrame | None:
    folder = landing_path(base, endpoint, execution_date)
    whole = _texts_or_none(spark, f"{folder}/*.*", wholetext=True)
    lines = _texts_or_none(spark, f"{folder}/{LINES}", wholetext=False)
    found = [_documents(whole)] if whole is not None else []
    if lines is not None:
        found.append(_lines(lines))
    return None if not found else found[0] if len(found) == 1 else found[0].union(found[1])


def _texts_or_none(spark: SparkSession, path: str, *, wholetext: bool) -> DataFrame | None:
    try:
        return spark.read.text(path, wholetext=wholetext)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _lines(files: DataFrame) -> DataFrame:
    return files.select(F.input_file_name().alias("file"), "value").filter(F.trim("value") != "")


def _documents(files: DataFrame) -> DataFrame:
    """``file, value``: a row per document of whole files. A document begins with a brace at the
    begin of a line, which holds for one line as for indented ones."""
    each = F.explode(F.split("value", r"(?m)^(?=\{)")).alias("value")
    return files.select(F.input_file_name().alias("file"), "value").select("file", each).filter(F.trim("value") != "")


def _parsed(documents: DataFrame, schema: StructType) -> DataFrame:
    watched = StructType([*schema.fields]).add(_CORRUPT, StringType())
    parsed = F.from_json("value", watched, {"columnNameOfCorruptRecord": _CORRUPT})
    return documents.withColumn("document", parsed)


def _rejected() -> Column:
    # the parser ignores what follows a whole document
    whole = F.rtrim("value", F.lit(" \r\n")).endswith("}")
    return F.col("document").isNull() | F.col(f"document.{_CORRUPT}").isNotNull() | ~whole


def _or_stop(value: Column) -> Column:
    message = F.raise_error(F.concat(F.lit("not a landing document: "), F.col("file")))
    return F.when(_rejected(), message).otherwise(value)
