"""Unicode normalization, which Spark lacks, by Arrow batches; texts that are ASCII already pass through."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def ascii_form(text: Column) -> Column:
    """NFKD without what isn't ASCII."""
    return F.when(text.rlike(r"^[\x00-\x7F]*\z"), text).otherwise(_nfkd(text))
