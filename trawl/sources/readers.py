"""Scans of the JSON files that stages leave behind, with fixed schemas."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

METADATA = [
    "ticker", "company_name", "filing_date", "cik", "accession_number", "source_url", "section",
    "chunk_index", "char_start", "char_end",
]
METADATA_TYPE = ", ".join(f"{f} string" for f in METADATA[:7]) + ", " + ", ".join(
    f"{f} int" for f in METADATA[7:]
)
CHUNK_SCHEMA = (
    "chunk_id string, text string, metadata struct<"
    + METADATA_TYPE.replace(" string", ":string").replace(" int", ":int")
    + ">"
)
FILING_SCHEMA = (
    "ticker string, cik string, company_name string, filing_type string, filing_date string, "
    "accession_number string, primary_doc string, source_url string, "
    "sections array<struct<section:string,text:string>>"
)
PAGE_SCHEMA = "accession_number string, source_url string, html string"
GOLDEN_SCHEMA = (
    "id int, question string, company string, category string, relevant_ids array<string>, "
    "recall_reliable boolean, why string"
)
TICKERS_SCHEMA = "map<string,struct<cik_str:bigint,ticker:string,title:string>>"
SUBMISSIONS_SCHEMA = (
    "cik string, filings struct<recent:struct<form:array<string>,accessionNumber:array<string>,"
    "primaryDocument:array<string>,filingDate:array<string>>>"
)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN_SCHEMA).json(path)


def read_filings(spark: SparkSession, path: str, pretty=False) -> DataFrame:
    """Filings a line each, as ``write_filings`` leaves them; ``pretty`` for files of one filing over many lines."""
    return spark.read.schema(FILING_SCHEMA).option("multiLine", pretty).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files as flat rows: id, text and the ten metadata fields."""
    nested = spark.read.schema(CHUNK_SCHEMA).json(path)
    return nested.select(F.col("chunk_id").alias("id"), "text", "metadata.*")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One chunk per line, metadata nested; replaces what was there."""
    present = [f for f in METADATA if f in chunks.columns]
    nested = chunks.select("chunk_id", "text", F.struct(*present).alias("metadata"))
    nested.write.mode("overwrite").json(path)


def write_filings(filings: DataFrame, path: str) -> None:
    filings.write.mode("overwrite").partitionBy("ticker").json(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """Text files as one value each; no rows where there is no such file."""
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "value string")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The cache of downloaded pages; no rows before the first download."""
    try:
        return spark.read.schema(PAGE_SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], PAGE_SCHEMA)


def read_rewrites(spark: SparkSession, path: str) -> DataFrame:
    """Rewrite cache files, each one JSON object over any number of lines."""
    return parse_rewrites(read_whole(spark, path))


def parse_rewrites(text: DataFrame) -> DataFrame:
    """Caches {model: {question: [rewrite]}} in column value as model, question,
    rewrites. A value that is no such object gives no rows; the older
    flat layout, which names its model under "__model__", is read as well."""
    nested = F.from_json("value", "map<string,map<string,array<string>>>")
    flat = F.map_filter(
        F.from_json("value", "map<string,string>"), lambda question, _: question != "__model__"
    )
    lists = F.transform_values(flat, lambda _, v: F.from_json(v, "array<string>"))
    model = F.get_json_object("value", "$.__model__")
    models = F.when(
        model.isNotNull(), F.map_from_arrays(F.array(model), F.array(lists))
    ).otherwise(nested)
    return text.select(F.explode(models).alias("model", "questions")).select(
        "model", F.explode("questions").alias("question", "rewrites")
    )


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """A judge cache {model#vN: {question: {id: bool}}} as
    namespace, question, id, relevant."""
    nested = F.from_json("value", "map<string,map<string,map<string,boolean>>>")
    return (
        read_whole(spark, path)
        .select(F.explode(nested).alias("namespace", "questions"))
        .select("namespace", F.explode("questions").alias("question", "verdicts"))
        .select("namespace", "question", F.explode("verdicts").alias("id", "relevant"))
    )


SIDECAR_SCHEMA = (
    "query_id int, question string, hand_key array<string>, judged_relevant array<string>, "
    "new_key array<string>, added array<string>, pool_size bigint, model string, pool_depth int"
)


def write_sidecar(rows: DataFrame, path: str, model: str, depth: int) -> None:
    """Completed keys, a line per question; the golden set is left alone."""
    rows.withColumn("model", F.lit(model)).withColumn("pool_depth", F.lit(depth)).write.mode(
        "overwrite"
    ).json(path)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Completed keys that are not empty, one row per question and id."""
    lines = spark.read.schema(SIDECAR_SCHEMA).json(path)
    return lines.select("query_id", F.explode("new_key").alias("id"))


def parse_sidecar(text: DataFrame) -> DataFrame:
    """The same from one JSON object {model, pool_depth, questions: {id: ...}}
    in column value."""
    shape = "questions map<string,struct<new_key:array<string>>>"
    return (
        text.select(F.explode(F.from_json("value", shape).getField("questions")).alias("q", "entry"))
        .select(F.col("q").cast("int").alias("query_id"), F.explode("entry.new_key").alias("id"))
    )
