"""Source files that don't parse, by generalised parsing with all dialects of a language at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import first_segment
from treeloom.llm.files import whole_files
from treeloom.llm.syntax import languages as grammars

LANGUAGES = ["julia", "cpp", "python", "javascript", "json", "toml"]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = grammars()
    for batch in batches:
        accepted = [sorted(known[language].accepts(text)) for language, text in zip(batch["language"], batch["text"])]
        yield pd.DataFrame({"file": batch["file"], "language": batch["language"], "dialects": accepted})


def parsed_files(code: DataFrame, languages: DataFrame) -> DataFrame:
    """``file, language, dialects``: the dialects that accept the file; none means it isn't valid.

    The language is that of the file's extension, not that of ``code.language``. Files of other languages and files without any text in ``code`` are left out;
    a file whose text is empty or blank is valid. Each file is parsed whole, however long.
    """
    files = whole_files(code, languages, LANGUAGES)
    return files.mapInPandas(_parse, "file string, language string, dialects array<string>")


def invalid_files(code: DataFrame, languages: DataFrame) -> DataFrame:
    return parsed_files(code, languages).where(F.size("dialects") == 0).select("file")


def invalid_rates(code: DataFrame, languages: DataFrame) -> DataFrame:
    """``repository, language, n_files, n_invalid, rate``."""
    bad = F.sum(F.when(F.size("dialects") == 0, 1).otherwise(0))
    return parsed_files(code, languages).groupBy(first_segment(F.col("file")).alias("repository"), "language").agg(
        F.count("*").alias("n_files"), bad.alias("n_invalid"), F.round(bad / F.count("*"), 6).alias("rate"))
