from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: every date is text of the form yyyy-MM-dd
DATE_LENGTH = 10


def lenient_date(text: Column) -> Column:
    """``yyyy-MM-dd`` text as a date; anything else becomes null.

    A cast alone would also take ``2025-1-5``, blanks around it or a time after it, so the dashes must be
    in their places and a digit in the last one: of ten characters that leaves two each for month and day.
    That costs less than a pattern, a parse with a format or the date written out again.
    """
    dashes = (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    return F.when((F.length(text) == DATE_LENGTH) & dashes & F.substring(text, 10, 1).between("0", "9"), text.try_cast("date"))


def strict_date(text: Column, parsed: Column) -> Column:
    """The parsed date; null text stays null, text that did not parse fails the run.

    The failure is explicit, so it does not depend on the session's ANSI setting.
    """
    failure = F.raise_error(F.concat(F.lit("not a yyyy-MM-dd date: "), text)).cast("date")
    return F.when(parsed.isNull() & text.isNotNull(), failure).otherwise(parsed)
