"""Partial dates and years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def partial_date(c: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD: a month or day of zero is left out, an impossible date stays as it is."""
    whole = r"\A([0-9]{4})(?:-([0-9]{1,2})(?:-([0-9]{1,2}))?)?\z"
    y, m, d = (F.regexp_extract(F.trim(c), whole, k) for k in (1, 2, 3))
    month, day = F.lpad(m, 2, "0"), F.lpad(d, 2, "0")
    none = lambda x: (x == "") | (x == "0") | (x == "00")
    full = F.concat_ws("-", y, month, day)
    real = F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).isNotNull()
    return (
        F.when(y == "", c).when(none(m), y).when(~month.between("01", "12"), c)
        .when(none(d), F.concat_ws("-", y, month)).when(real, full).otherwise(c)
    )


def year_in(c: Column) -> Column:
    """The first 19xx or 20xx that is not part of a longer number."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), 1), F.lit(1)).cast("int")
