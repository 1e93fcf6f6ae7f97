"""Many patterns searched at once: one pass over a text whatever their number.

The patterns make one automaton per worker, in which every state knows the longest pattern part that ends where the
text stands. A plan carries the list of patterns and no expression for each.
"""

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

PIECE = 256  # texts that are searched at a time
QUESTION_BLOCK = 4096  # patterns of whole questions in one automaton


def automaton(patterns):
    """From (pattern, value) pairs; patterns that are equal gather their values. Empty ones match nowhere."""
    held = {}
    for pattern, value in patterns:
        if pattern:
            held.setdefault(pattern, []).append(value)
    machine = ahocorasick.Automaton()
    for pattern, values in held.items():
        machine.add_word(pattern, (len(pattern), values))
    machine.make_automaton()
    return machine


def found_in(machine, text):
    """(start, end, values) of every occurrence, overlapping ones too."""
    if len(machine):
        for last, (size, values) in machine.iter(text):
            yield last + 1 - size, last + 1, values


@lru_cache(maxsize=1 << 16)
def in_word(c):
    """Letters, marks, digits and connectors of any script."""
    return c.isalpha() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Nd", "Pc", "Nl") or c in "‌‍"


def at_edge(text, i):
    """Does a word begin or end between text[i - 1] and text[i]?"""
    return (i > 0 and in_word(text[i - 1])) != (i < len(text) and in_word(text[i]))


def whole_words(machine, text):
    """Values of the patterns that stand in ``text`` as whole words."""
    return {
        v for start, end, values in found_in(machine, text)
        if at_edge(text, start) and at_edge(text, end) for v in values
    }


def named_companies(question, companies):
    """A column: sorted tickers whose symbol (in upper case) or a name (in lower case) stands in the question."""
    symbols = [(ticker.upper(), ticker) for ticker in companies]
    names = [(name.lower(), ticker) for ticker, all_names in companies.items() for name in all_names]

    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        upper, lower = automaton(symbols), automaton(names)
        for shouted, spoken in batches:
            yield pd.Series(
                [
                    None if a is None else sorted(whole_words(upper, a) | whole_words(lower, b))
                    for a, b in zip(shouted, spoken)
                ]
            )

    found = F.pandas_udf(find, T.ArrayType(T.StringType()))(F.upper(question), F.lower(question))
    return F.coalesce(found, F.array().cast("array<string>"))


def containing(texts: DataFrame, questions) -> DataFrame:
    """query_id, id of the texts (id, text) that hold a question word for word.

    One scan of the texts for each block of questions, and only the pairs found leave it. Null texts hold nothing; an empty
    question stands nowhere. ``questions`` is a checked batch, so a block's size is known.
    """
    ids = texts.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("query_id", questions.df.schema["query_id"].dataType), T.StructField("id", ids)]
    )

    def scan(block):
        query_ids, asked = block["query_id"], block["asked"].to_pylist()

        def search(batches):
            machine = automaton((text, i) for i, text in enumerate(asked) if text)
            for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
                row, query = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    hits = {v for _, _, values in found_in(machine, text or "") for v in values}
                    row += [i] * len(hits)
                    query += sorted(hits)
                found = query_ids.combine_chunks().take(pa.array(query, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [found, batch.column(0).take(pa.array(row, pa.int64()))], ["query_id", "id"]
                )

        return texts.select("id", "text").mapInArrow(search, schema)

    return questions.union([scan(b) for b in questions.blocks({"asked": F.col("question")}, QUESTION_BLOCK)], schema)
