"""Unicode helpers that Spark lacks, Arrow-batched."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Combining marks; only strings that hold one need composition.
MARKS = "[\\u0300-\\u036f\\u0483-\\u0489\\u0591-\\u05bd\\u0610-\\u061a\\u064b-\\u065f\\u1ab0-\\u1aff\\u1dc0-\\u1dff\\u20d0-\\u20ff\\u3099\\u309a\\ufe20-\\ufe2f]"


@F.pandas_udf(T.StringType())
def nfc_always(text: pd.Series) -> pd.Series:
    """Canonical composition (NFC); NULL stays NULL."""
    return text.map(lambda s: unicodedata.normalize("NFC", s) if isinstance(s, str) else None)


@F.pandas_udf(T.StringType())
def nfkd_bare(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; NULL stays NULL."""
    return text.map(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)) if isinstance(s, str) else None)


def nfc(text: Column) -> Column:
    """NFC of a text column. Latin, Greek and Cyrillic letters change by composition only where a combining mark stands."""
    return nfc_always(text)
