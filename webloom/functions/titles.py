"""What a reader sees of a short text."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_HIDDEN = re.compile("[­​-‏⁠﻿]")
_BLANKS = re.compile(r"\s+")


def shown(text: str | None) -> str | None:
    """Entities decoded, hidden characters dropped, one Unicode form, blanks collapsed; null if nothing is left."""
    if text is None:
        return None
    text = unicodedata.normalize("NFC", _HIDDEN.sub("", html.unescape(html.unescape(text))))
    return _BLANKS.sub(" ", text).strip() or None


@F.pandas_udf(StringType())
def shown_text(texts: pd.Series) -> pd.Series:
    return texts.map(shown, na_action="ignore").astype(object).where(texts.notna(), None)
