"""Steps that a hosted model takes: recorded answers first, calls for the rest.

An adapter's ``call(turn)`` is user code around some client. It runs once per
missing prompt inside the tasks, and what it gives is written down before it is
used, so that no later stage calls again. A call that fails leaves the step's
neutral answer for this run and records nothing, so that it is tried again.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

REWRITES = "model string, question string, rewrites array<string>"
VERDICTS = "namespace string, question string, id string, relevant boolean"


def saved(spark, path: str, schema: str) -> DataFrame:
    """What earlier calls recorded under ``path``; empty before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def call_for_each(prompts: DataFrame, call, result_type: str) -> DataFrame:
    """Add ``result``: what ``call`` made of each prompt's turn, null on error."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields]
    schema = ", ".join(fields + [f"result {result_type}"])

    def attempt(turn):
        try:
            return call(turn)
        except Exception:
            return None

    def run(batches):
        for pdf in batches:
            yield pdf.assign(result=[attempt(turn) for turn in pdf["turn"]])

    return prompts.mapInPandas(run, schema)


def clean_list(result, limit=None):
    """Trimmed, blanks dropped, and, of a model's answer, no more than it is asked for."""
    trimmed = F.filter(F.transform(result, lambda r: F.trim(r)), lambda r: r != "")
    return F.slice(trimmed, 1, limit) if limit else trimmed


def each_rewrite(recorded: DataFrame, model: str) -> DataFrame:
    """question, position, rewrite of one model. A question without rows is
    one that retrievers leave as asked."""
    mine = recorded.filter(F.col("model") == model)
    return mine.select("question", F.posexplode("rewrites").alias("position", "rewrite"))


def record_rewrites(prompts, recorded, model, limit, call, path) -> None:
    """Call for questions (question, turn) that ``recorded`` lacks, and append
    the lists, empty ones too, to the table under ``path``."""
    known = recorded.filter(F.col("model") == model).select("question")
    called = call_for_each(prompts.join(known, "question", "left_anti"), call, "array<string>")
    called.filter(F.col("result").isNotNull()).select(
        F.lit(model).alias("model"), "question", clean_list("result", limit).alias("rewrites")
    ).write.mode("append").parquet(path)


def namespace(model: str, version: int) -> str:
    """Verdicts of another rubric version do not count."""
    return f"{model}#v{version}"


def each_verdict(recorded: DataFrame, space: str) -> DataFrame:
    return recorded.filter(F.col("namespace") == space).select("question", "id", "relevant")


def record_verdicts(prompts, recorded, space, call, path) -> None:
    """Call for (question, id, turn) that ``recorded`` lacks and append."""
    known = each_verdict(recorded, space).select("question", "id")
    missing = prompts.select("question", "id", "turn").join(known, ["question", "id"], "left_anti")
    call_for_each(missing, call, "boolean").filter(F.col("result").isNotNull()).select(
        F.lit(space).alias("namespace"), "question", "id", F.col("result").alias("relevant")
    ).write.mode("append").parquet(path)


def answers(prompts: DataFrame, call) -> DataFrame:
    """query_id, answer for prompts that have a turn; refused ones get none.
    Write the result down before using it more than once."""
    asked = prompts.filter(F.col("turn").isNotNull()).select("query_id", "turn")
    return call_for_each(asked, call, "string").select(
        "query_id", F.trim("result").alias("answer")
    )
