"""Numeric and temporal information: extraction, ordering and the match of two mentions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from refquarry.functions import rx

SAME, PART, SUPERSET = "same_as_temporal", "part_of_temporal", "superset_of_temporal"


def numbers(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(f"({rx.NUMBER})"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, "[.,]$", ""))


def numeric_info(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(f"({rx.COMPLEX_NUMERIC})"), F.lit(1))
    return F.filter(found, lambda x: ~x.rlike(rx.DOI_JAVA))


def reference_numeric_info(reference: Column, right: Column, left: Column) -> Column:
    return F.concat(numeric_info(reference), numeric_info(right), numeric_info(left))


def sorted_info(info: Column) -> Column:
    """Mentions with four digits, then those with an abbreviated year, then the others; stable."""
    rank = lambda x: F.when(x.rlike(rx.YEAR), 0).when(x.rlike(rx.ABBREVIATED_YEAR), 1).otherwise(2)
    keyed = F.transform(info, lambda x, i: F.struct(rank(x).alias("rank"), i.alias("place"), x.alias("value")))
    return F.transform(F.array_sort(keyed), lambda x: x["value"])


def best_info(info: Column) -> Column:
    return F.coalesce(F.get(sorted_info(info), F.lit(0)), F.lit(""))


def first_doi(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(t, f"({rx.DOI_JAVA})", 1)), F.lit("")) for t in texts])


def first_url(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(t, f"({rx.URL})", 1), F.lit("")) for t in texts])


def is_year(c: Column) -> Column:
    return c.rlike(rx.YEAR)


def is_abbreviated(c: Column) -> Column:
    return c.rlike(r"^\D*?'?\d\d[^\d.]*$")


def is_enumeration(c: Column) -> Column:
    return c.rlike(rf"\d\s*{rx.ENUM}\s*\d")


def is_range(c: Column) -> Column:
    return c.rlike(rf"\d\s*{rx.RANGE}\s*\d")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable instead of a copy at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _described(c: Column) -> Column:
    """A mention with its numbers and what kind it is."""
    return F.struct(c.alias("text"), numbers(c).alias("n"), is_year(c).alias("year"), is_abbreviated(c).alias("short"), is_range(c).alias("range"))


def _f(c: Column) -> Column:
    return c.try_cast("float")


def in_range(low: Column, high: Column, value: Column) -> Column:
    """low <= value <= high as floats; unparsable or turned-round bounds: false."""
    return F.coalesce((_f(low) <= _f(high)) & (_f(value) >= _f(low)) & (_f(value) <= _f(high)), F.lit(False))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column, invert: bool) -> Column:
    """Relations of interval b to interval a; the first case that holds decides, disjoint or unparsable intervals give null."""
    a0, a1, b0, b1 = map(_f, (a0, a1, b0, b1))
    inside, around = (PART, SUPERSET) if invert else (SUPERSET, PART)
    one = lambda *r: F.array(*[F.lit(x) for x in r])
    return (
        F.when((a0 > a1) | (b0 > b1), F.array().cast("array<string>"))
        .when((a0 == b0) & (a1 == b1), one(SAME))
        .when((b0 >= a0) & (b1 <= a1), one(inside))
        .when((b0 < a0) & (b1 <= a1) & (b1 >= a0), F.when(b1 != a1, one(PART, SUPERSET)).otherwise(one(PART)))
        .when((b0 >= a0) & (b1 > a1) & (b0 <= a1), F.when(b0 != a0, one(PART, SUPERSET)).otherwise(one(PART)))
        .when((b0 <= a0) & (b1 >= a1), one(around))
    )


def _full(c: Column) -> tuple[Column, Column]:
    """A number as a year of either century if it is abbreviated, else twice itself."""
    return tuple(F.when(is_abbreviated(c), F.concat(F.lit(century), c)).otherwise(c) for century in ("19", "20"))


def _range_match(a: Column, b: Column, invert: bool) -> Column:
    """Relations of mention b to the range a."""
    first, second = F.get(a["n"], F.lit(0)), F.get(a["n"], F.lit(1))
    point, end = F.get(b["n"], F.lit(0)), F.get(b["n"], F.lit(1))
    held = F.array(F.lit(PART if invert else SUPERSET))
    none = F.array().cast("array<string>")

    def decide(v: Column) -> Column:
        bounds, others = [(v["a19"], v["b19"]), (v["a20"], v["b20"])], [(v["c19"], v["d19"]), (v["c20"], v["d20"])]
        both = F.array_union(*[F.coalesce(overlap(*x, *y, invert), none) for x, y in zip(bounds, others, strict=True)])
        contains = lambda *values: F.reduce(F.array(*[in_range(lo, hi, x) for lo, hi in bounds for x in values]), F.lit(False), lambda x, y: x | y)
        as_it_is = contains(point)
        return (
            F.when(b["range"], let(both, lambda r: F.when(F.size(r) > 0, r)))
            .when(b["year"] & as_it_is, held)
            .when(b["short"], F.when(contains(F.concat(F.lit("19"), point), F.concat(F.lit("20"), point)), held))
            .otherwise(F.when(as_it_is, held))
        )

    named = [c.alias(f"{k}{century}") for k, x in (("a", first), ("b", second), ("c", point), ("d", end)) for century, c in zip(("19", "20"), _full(x), strict=True)]
    return let(F.struct(*named), decide)


def _years_match(n1: Column, n2: Column, abbreviated: Column) -> Column:
    variants = F.flatten(F.transform(n2, lambda x: F.array(*_full(x))))
    return F.when(abbreviated, F.arrays_overlap(n1, variants)).otherwise(F.arrays_overlap(n1, n2))


def _abbreviated_match(n1: Column, n2: Column, abbreviated: Column) -> Column:
    near = F.exists(n2, lambda y: F.exists(n1, lambda x: F.coalesce(F.abs(_f(x) - _f(y)) < F.lit(1e-5).cast("float"), F.lit(False))))
    return F.when(abbreviated, F.arrays_overlap(n1, n2)).otherwise(near)


def _plain(a: Column, b: Column) -> Column:
    """Relations of two described mentions neither of which is an enumeration."""
    n1, n2 = a["n"], b["n"]
    same = F.array(F.lit(SAME))
    equal = F.exists(n1, lambda x: F.exists(n2, lambda y: F.coalesce(_f(x) == _f(y), F.lit(False))))
    yes = lambda c: F.coalesce(c, F.lit(False))
    by_years = (
        F.when(a["year"] & yes(_years_match(n1, n2, b["short"])), same)
        .when(b["year"] & yes(_years_match(n2, n1, a["short"])), same)
        .when(a["short"] & yes(_abbreviated_match(n1, n2, b["short"])), same)
        .when(b["short"], F.when(yes(_abbreviated_match(n2, n1, a["short"])), same))
        .otherwise(F.when(equal, same))
    )
    return F.coalesce(F.when(a["range"], _range_match(a, b, False)), F.when(b["range"], _range_match(b, a, True)), by_years)


def _parts(mention: Column, many: Column) -> Column:
    """The described numbers of an enumeration, or the described mention itself."""
    numbers_ = F.flatten(F.transform(numbers(mention), lambda x: F.split(x, rx.ENUM)))
    return F.transform(F.when(many, numbers_).otherwise(F.array(mention)), _described)


def numeric_match(a: Column, b: Column) -> Column:
    """Sorted relations of mention a to mention b; null where they do not match, superset_of where one is null.

    Enumerations are compared number by number; the first pair that matches decides, and part_of then
    stands for same_as.  If b is one, its numbers are compared to a's and not the other way round.
    """
    many_a, many_b = is_enumeration(a), is_enumeration(b)

    def pairs(x: Column) -> Column:
        def plain(p: Column, q: Column) -> Column:
            ordered = F.struct(F.when(x["mb"], q).otherwise(p).alias("u"), F.when(x["mb"], p).otherwise(q).alias("v"))
            return let(ordered, lambda w: _plain(w["u"], w["v"]))

        return F.flatten(F.transform(x["pa"], lambda p: F.transform(x["pb"], lambda q: plain(p, q))))

    sides = F.struct(many_b.alias("mb"), _parts(a, many_a).alias("pa"), _parts(b, many_b).alias("pb"))
    first = F.get(F.filter(let(sides, pairs), lambda r: r.isNotNull()), F.lit(0))
    listed = lambda r: F.when(many_a | many_b, F.array_union(F.array_remove(r, SAME), F.array(F.lit(PART)))).otherwise(r)
    return F.array_sort(F.when(a.isNull() | b.isNull(), F.array(F.lit(SUPERSET))).otherwise(let(first, listed)))
