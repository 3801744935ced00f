"""Column expressions that the SQL-only operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII digits, ASCII lower-case letters and everything beyond ASCII, as SQL has it.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same runs for Java: its positive class is the faster one, and a run needs no way back.
RUN = r"[0-9a-z\x{80}-\x{10FFFF}]++"
#: Runs of anything but white space; in Java patterns \S is this very set.
SPACED = r"[^\x20\x09-\x0D]+"
#: What lower() may change beyond A-Z: capitals, and what is too new for the patterns to know.
RAISED = r"[\x{80}-\x{10FFFF}&&[\p{javaUpperCase}\p{javaTitleCase}\p{Cn}]]"


def lowered(text: Column) -> Column:
    """A-Z in lower case, and no other letter; null is empty. lower() is much the faster, where it does the same."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike(RAISED), F.translate(text, UPPER, LOWERED)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """The text's words in order."""
    return F.regexp_extract_all(lowered(text), F.lit(RUN), F.lit(0))
