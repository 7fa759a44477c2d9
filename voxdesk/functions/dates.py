"""Date functions that do not depend on the session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxdesk import fixed_values as V

_CREATED_AT = (
    "^(" + "|".join(V.WEEKDAYS) + ") (" + "|".join(V.MONTHS) + ") "
    r"(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2}) [+-]\d{4} (\d{4})$"
)


def parse_created_at(c: Column) -> Column:
    """Wall-clock time of 'Tue Oct 31 22:10:47 +0000 2017' as TIMESTAMP_NTZ.

    The offset is dropped. Text of another form, and impossible dates, are null.
    """
    # One match rearranges the text; what does not match stays as it is.
    rearranged = F.regexp_replace(c, _CREATED_AT, "$7 $2 $3 $4 $5 $6")
    parts = F.split(rearranged, " ")
    month = F.array_position(F.array(*[F.lit(m) for m in V.MONTHS]), F.get(parts, F.lit(1)))
    year, day, hour, minute, second = (F.get(parts, F.lit(k)).try_cast("int") for k in (0, 2, 3, 4, 5))
    parsed = F.try_make_timestamp_ntz(
        year, month.cast("int"), day, hour, minute, second.cast("decimal(16,6)")
    )
    return F.when(rearranged != c, parsed)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
