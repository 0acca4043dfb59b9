from pyspark.sql import Column
from pyspark.sql import functions as F

from salesflow.schemas import ZIP_DIGITS


def zip_candidate(raw: Column) -> Column:
    """The first five digits found anywhere in the text; empty when there are none.

    Upper-casing first, as the cleaning rule words it, cannot add or remove an
    ASCII digit, so it is left out. Most texts begin with the digits, and nothing is replaced in those.
    """
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]+", "")
    begins = raw.rlike(f"\\A[0-9]{{{ZIP_DIGITS}}}")
    return F.substring(F.when(begins, raw).otherwise(digits), 1, ZIP_DIGITS)


def complete_code(name: str) -> Column:
    """Whether a text is what cleaning leaves of a usable code: five digits and nothing else."""
    return F.col(name).rlike(f"\\A[0-9]{{{ZIP_DIGITS}}}\\z")
