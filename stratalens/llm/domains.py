"""The production tree for mixing: which domain a source belongs to, and target weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mixing import Targets

DOMAINS = ("web", "books", "forums", "reference")


def domain_of(source: Column) -> Column:
    """Sources are numbered; every four neighbours belong to the four domains.  A
    source without a number has the domain "other"."""
    n = F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), r"(\d{1,9})$", 1)
    return F.when(n == "", "other").otherwise(F.element_at(F.lit(list(DOMAINS)), (F.when(n == "", "0").otherwise(n).cast("int") % 4 + 1)))


TARGETS = Targets(domain={"web": 4.0, "books": 3.0, "forums": 1.0, "reference": 2.0}, lang={"en": 5.0, "de": 2.0, "fr": 2.0}, other=1.0)
