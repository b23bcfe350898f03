"""Which covariance terms a product has, and the composite that suits them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The terms on the diagonal, and those beside it.
LINEAR, COMPACT = ("HHHH", "HVHV", "VHVH", "VVVV"), ("RHRH", "RVRV")
BESIDE = ("HHHV", "HHVH", "HHVV", "HVVH", "HVVV", "VHVV", "RHRV")
#: Composites by what they need, in the order in which they are preferred.
PREFERRED = (("dual-pol-h", ("HHHH", "HVHV")), ("dual-pol-v", ("VVVV", "VHVH")))


def detect(terms: Column, polarizations: Column, paths: Column, prefix: Column) -> Column:
    """The covariance terms of a product: those it lists and that are known; else its two-letter polarizations, doubled; else the names
    of data below ``prefix`` that are terms; else the four linear ones."""
    known = F.array(*map(F.lit, (*LINEAR, *COMPACT, *BESIDE)))
    listed = F.filter(terms, lambda t: F.array_contains(known, t))
    doubled = F.transform(F.filter(F.transform(polarizations, lambda p: F.trim(p)), lambda p: F.length(p) == 2), lambda p: F.concat(p, p))
    tails = F.transform(F.filter(paths, lambda p: p.startswith(prefix)), lambda p: F.substr(p, F.length(prefix) + 2))
    named = F.filter(tails, lambda t: F.array_contains(known, t))
    some = lambda a: F.when(F.size(a) > 0, a)
    return F.coalesce(some(listed), some(doubled), some(named), F.array(*map(F.lit, LINEAR)))


def automatic_composite(terms: Column) -> Column:
    """The composite that shows these terms best; null where there are too few."""
    found = F.lit(None).cast("string")
    for name, needed in reversed(PREFERRED):
        found = F.when(F.size(F.array_except(F.array(*map(F.lit, needed)), terms)) == 0, name).otherwise(found)
    return found
