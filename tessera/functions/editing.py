"""Edits of markdown sections, as folds of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.chunking import BLANKS, SPACE, trimmed


def section_name(value: Column) -> Column:
    return F.lower(trimmed(F.regexp_replace(value, f"^#+{SPACE}*", "")))


def section(lines: Column, name: Column) -> Column:
    """(start, end) of the first section of that name: its heading's line and the line after its last; start -1 without it.

    Headings of all levels count, outside fences; a fence ends with as many of its own marks. A section ends at the next
    heading of its level or above.
    """
    zero = F.lit(0)
    state = lambda at, fence, start, level, end: F.struct(at.alias("at"), fence.alias("fence"), start.alias("start"), level.alias("level"), end.alias("end"))

    def step(a: Column, x: Column) -> Column:
        mark = F.regexp_extract(x, f"^{SPACE}*(```+|~~~+)", 1)
        head = F.regexp_extract(x, f"^(#{{1,6}}){SPACE}+(.+?){SPACE}*$", 1)
        level = F.length(head)
        heading = (mark == "") & (a["fence"] == "") & (level > 0)
        found = heading & (a["start"] < 0) & (section_name(F.regexp_extract(x, f"^(#{{1,6}}){SPACE}+(.+?){SPACE}*$", 2)) == section_name(name))
        over = heading & (a["start"] >= 0) & (a["end"] < 0) & (level <= a["level"])
        closes = (F.left(mark, F.lit(1)) == F.left(a["fence"], F.lit(1))) & (F.length(mark) >= F.length(a["fence"]))
        fence = F.when(mark == "", a["fence"]).when(a["fence"] == "", mark).when(closes, "").otherwise(a["fence"])
        return state(a["at"] + 1, fence, F.when(found, a["at"]).otherwise(a["start"]), F.when(found, level).otherwise(a["level"]), F.when(over, a["at"]).otherwise(a["end"]))

    found = F.aggregate(lines, state(zero, F.lit(""), F.lit(-1), zero, F.lit(-1)), step)
    return F.struct(found["start"].alias("start"), F.when(found["end"] >= 0, found["end"]).otherwise(F.size(lines)).alias("end"))


def _end_trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def has_section(body: Column, name: Column) -> Column:
    return F.coalesce((name != "") & (section(F.split(body, "\n"), name)["start"] >= 0), F.lit(False))


def edited(body: Column, operation: Column, name: Column, content: Column) -> Column:
    """The body with a section replaced, with content after a section, or, for other operations, at its end."""
    lines, new = F.split(body, "\n"), F.split(_end_trimmed(content), "\n")
    at = section(lines, F.coalesce(name, F.lit("")))
    before, after = F.slice(lines, F.lit(1), F.greatest(F.lit(0), at["start"])), F.slice(lines, at["end"] + 1, F.size(lines))
    replaced = F.array_join(F.concat(before, new, after), "\n")
    upto = _end_lines(F.slice(lines, F.lit(1), at["end"]))
    inserted = F.array_join(F.concat(upto, F.array(F.lit("")), new, F.array(F.lit("")), after), "\n")
    appended = F.concat(_end_trimmed(body), F.lit("\n\n"), _end_trimmed(content))
    return F.when(operation == "replace_section", replaced).when(operation == "insert_after_section", inserted).otherwise(appended)


def _end_lines(lines: Column) -> Column:
    """Without the blank lines at the end."""
    last = F.aggregate(lines, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), lambda a, x: F.struct((a["at"] + 1).alias("at"), F.when(trimmed(x) == "", a["n"]).otherwise(a["at"] + 1).alias("n")))
    return F.slice(lines, F.lit(1), last["n"])
