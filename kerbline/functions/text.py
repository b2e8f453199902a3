"""Text, number and JSON cleaning as column expressions."""

from pyspark.sql import Column, functions as F

from kerbline.constants import TARGET_ROUTE_NAMES


def present(col: Column) -> Column:
    """Null for a missing or empty text."""
    text = col.cast("string")
    return F.when(F.trim(text) != "", text)


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[present(c) for c in cols])


def first_nonzero_text(*cols: Column) -> Column:
    """First value that is not missing, empty or zero (timetable fields use 0 for "none")."""
    texts = [present(c) for c in cols]
    return F.coalesce(*[F.when(t != "0", t) for t in texts])


def strict_int(col: Column) -> Column:
    """Whole numbers only: '5.7' is null."""
    return F.trim(col.cast("string")).try_cast("bigint")


def loose_int(col: Column) -> Column:
    """Any number, truncated towards zero."""
    return F.trim(col.cast("string")).try_cast("double").try_cast("bigint")


def comma_int(col: Column) -> Column:
    """As ``loose_int`` after dropping thousands commas."""
    return loose_int(F.regexp_replace(col.cast("string"), ",", ""))


def first_int(*cols: Column) -> Column:
    return F.coalesce(*[strict_int(c) for c in cols])


def number_or(col: Column, default: float) -> Column:
    return F.coalesce(F.trim(col.cast("string")).try_cast("double"), F.lit(float(default)))


def int_or(col: Column, default: int) -> Column:
    return F.coalesce(loose_int(col), F.lit(default).cast("bigint"))


def text_or(col: Column, default: str) -> Column:
    text = col.cast("string")
    return F.coalesce(F.when(text != "", text), F.lit(default))


def flag_or(col: Column, default: int) -> Column:
    """0/1 flag from numbers or Y/N marks; zero stays zero, only a missing value takes the default."""
    mark = F.upper(F.trim(col.cast("string")))
    return F.when(mark.isin("Y", "TRUE"), 1).when(mark.isin("N", "FALSE"), 0).otherwise(int_or(col, default).cast("int"))


def canonical_route(col: Column) -> Column:
    """Upper case, without the word for "number", blanks or brackets, and with one kind of dash."""
    bare = F.regexp_replace(F.upper(F.coalesce(col.cast("string"), F.lit(""))), r"[번\s()\[\]]", "")
    return F.translate(bare, "－–—", "---")


def is_target_route(route_name: Column, region_fields: list[Column] | None = None, keyword: str | None = None) -> Column:
    known = canonical_route(route_name).isin(*TARGET_ROUTE_NAMES)
    if not keyword:
        return known
    region = F.concat_ws(" ", *region_fields)
    return known & ((F.trim(region) == "") | region.contains(keyword))


def direction(col: Column) -> Column:
    mark = F.lower(F.trim(col.cast("string")))
    return F.when(mark.isin("up", "u", "상행"), "up").when(mark.isin("down", "d", "하행"), "down")


def camel_case(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part[:1].upper() + part[1:] for part in rest)
