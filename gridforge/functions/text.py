"""Text helpers of manifests and boundary names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The accented letters that the pure-SQL form folds.
ACCENTED = "àâäçéèêëîïôöùûüñáíóú"
PLAIN = "aaaceeeeiioouuunaiou"


def fold_accents(c: Column) -> Column:
    """Lower case without the listed accents, trimmed; stays in the JVM."""
    return F.trim(F.translate(F.lower(c), ACCENTED, PLAIN))


@F.pandas_udf(StringType())
def normalise(values: pd.Series) -> pd.Series:
    """NFKD, combining marks dropped, case folded, trimmed."""
    strip = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)).casefold().strip()
    return values.map(strip, na_action="ignore")


def listed(c: Column) -> Column:
    """A comma-joined cell as an array of trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def contains(c: Column, part: str) -> Column:
    """Case-insensitive; false where c is NULL."""
    return F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))


def deterministic_key(seed: int, *parts: Column) -> Column:
    """sha256 hex of seed:part:..., the order of stratified samples."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def as_boolean(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))
