"""Where regular expressions match, as column expressions: no code outside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Positions are summed chunk by chunk, so that a text with very many matches costs linear time.
CHUNK = 256
SPAN = "struct<start:bigint,end:bigint,value:string,before:string,after:string>"
CONTEXT = 32


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(text: Column, pattern: str) -> Column:
    """g: what lies between the matches, h: the matches. One pass of the text each."""
    return F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of SPAN: code points, end exclusive, with up to CONTEXT
    characters of the text between the neighbouring matches on either side."""
    empty = F.array().cast(f"array<{SPAN}>")
    zero = F.lit(0).cast("long")

    def place(parts: Column) -> Column:
        def add(state: Column, i: Column) -> Column:
            gap, hit = F.get(parts["g"], i), F.get(parts["h"], i)
            start = state["at"] + F.length(gap)
            end = start + F.length(hit)
            span = F.struct(start.alias("start"), end.alias("end"), hit.alias("value"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(F.get(parts["g"], i + 1), F.lit(CONTEXT)).alias("after"))
            return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

        def chunk(state: Column, c: Column) -> Column:
            last = F.least((c + 1) * CHUNK, F.size(parts["h"])) - 1
            inner = F.aggregate(F.sequence(c * CHUNK, last), F.struct(state["at"].alias("at"), empty.alias("spans")), add)
            return bind(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(state["all"], F.array(x["spans"])).alias("all")))

        start = F.struct(zero.alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("all"))
        chunks = F.sequence(F.lit(0), F.floor((F.size(parts["h"]) - 1) / CHUNK).cast("int"))
        return F.when(F.size(parts["h"]) > 0, F.flatten(F.aggregate(chunks, start, chunk)["all"])).otherwise(empty)

    return bind(_parts(text, pattern), place)


def located_if(condition: Column, text: Column, pattern: str) -> Column:
    """No match is searched where the condition does not hold."""
    return F.when(condition, located(text, pattern)).otherwise(F.array().cast(f"array<{SPAN}>"))


def blanked(text: Column, pattern: str, passes) -> Column:
    """The text with line feeds in place of each character of the matches that pass; all positions stay."""

    def fill(parts: Column) -> Column:
        def piece(gap: Column, i: Column) -> Column:
            return bind(F.coalesce(F.get(parts["h"], i), F.lit("")), lambda h: F.concat(gap, F.when((h != "") & passes(h), F.repeat(F.lit("\n"), F.length(h))).otherwise(h)))

        return F.when(F.size(parts["h"]) > 0, F.array_join(F.transform(parts["g"], piece), "")).otherwise(text)

    return bind(_parts(text, pattern), fill)


def spelled(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined, by start, then kind as listed. Spans are structs of start, end, kind."""
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
