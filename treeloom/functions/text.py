"""Column helpers shared by the operators: JVM-side expressions, and :func:`composed`, which no expression says."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters Unicode calls white space, for a regular expression class.
UNICODE_SPACE = r"\u0009-\u000d\u001c- \u0085   -     　"


def strip_unicode(c: Column) -> Column:
    """``c`` without any Unicode white space at both ends (Spark's ``trim`` takes U+0020 only)."""
    return F.regexp_replace(c, f"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+$", "")


def clean_path(c: Column) -> Column:
    """Backslashes to slashes, repeated slashes to one, a leading ``./`` dropped."""
    p = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/{2,}", "/")
    return F.regexp_replace(p, r"^\./", "")


def extension(c: Column) -> Column:
    """Lower-cased extension of a path with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(c, r"(\.[^./]+)$", 1))


def first_segment(c: Column) -> Column:
    """The first path segment, which names the repository."""
    return F.substring_index(c, "/", 1)


@F.arrow_udf(T.StringType())
def composed(values: pa.Array) -> pa.Array:
    """Without Unicode white space at both ends, in composed form (NFC); a whole batch at once where it is ASCII."""
    values = pc.utf8_trim_whitespace(values.cast(pa.string()))
    if pc.all(pc.string_is_ascii(values)).as_py() is not False:
        return values
    names = pc.dictionary_encode(values)
    return pc.take(pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in names.dictionary.to_pylist()], pa.string()), names.indices)
