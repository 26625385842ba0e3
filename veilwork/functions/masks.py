"""Safe-Harbor masks: year-only dates, three-digit ZIP areas, grouped ages.

Each mask is SQL text over an expression, so that it can stand inside a lambda; the functions
without ``_sql`` wrap it as a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

# --- fixed values: date formats that must parse to keep their year ------------------------------
DATE_FORMATS = ["d/MMM/yyyy", "d/M/yyyy", "yyyy-M-d", "M/d/yyyy"]
DATE_SHAPE = r"^(?:[0-9]{1,2}/(?:[0-9]{1,2}|[A-Za-z]{3})/[0-9]{4}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})$"
# In every other shape a free-standing four-digit number is the year.
YEAR_ANYWHERE = r"(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)"
SLASHED = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$"


def mask_date_sql(v: str) -> str:
    """``XX/XX/<year>``, or ``XX/XX/XXXX`` when no year can be told."""
    parsed = ", ".join(f"try_to_timestamp({v}, '{f}')" for f in DATE_FORMATS)
    loose = f"regexp_extract({v}, r'{YEAR_ANYWHERE}', 1)"
    return (f"concat('XX/XX/', coalesce(CASE WHEN {v} rlike r'{DATE_SHAPE}' THEN "
            f"cast(year(coalesce({parsed})) as string) ELSE nullif({loose}, '') END, "
            f"CASE WHEN {v} IS NOT NULL THEN 'XXXX' END))")


def mask_zip_sql(v: str) -> str:
    """The three-digit area; ``00000`` for areas with few people."""
    areas = ", ".join(f"'{a}'" for a in vocab.RESTRICTED_ZIP3)
    return (f"CASE WHEN substring({v}, 1, 3) IN ({areas}) THEN '00000' "
            f"ELSE concat(substring({v}, 1, 3), '**') END")


def mask_dob_sql(v: str) -> str:
    """A slashed date keeps what follows the last slash; other shapes are masked as dates."""
    return (f"CASE WHEN {v} rlike r'{SLASHED}' THEN concat('XX/XX/', substring_index({v}, '/', -1)) "
            f"ELSE {mask_date_sql(v)} END")


def mask_age_sql(age: str) -> str:
    """Ages at or over the threshold become one group."""
    return (f"CASE WHEN {age} >= {vocab.AGE_THRESHOLD} THEN '{vocab.AGE_GROUP}' "
            f"ELSE cast({age} as string) END")


def mask_date(column: str) -> Column:
    return F.expr(mask_date_sql(column))


def mask_zip(column: str) -> Column:
    return F.expr(mask_zip_sql(column))


def mask_dob(column: str) -> Column:
    return F.expr(mask_dob_sql(column))


def mask_age(column: str) -> Column:
    return F.expr(mask_age_sql(column))
