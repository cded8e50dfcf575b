"""What a message holds: words, tool names and named files, out of blocks that may hold blocks to any depth.

A block is looked at by one expression. Rows whose blocks hold no further blocks, which are most, are done with it; the few others are taken
apart level by level, each node carrying its path, and put together again in the order of these paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from .scratch import written

# Kinds of blocks in the three dialects, the argument names that say which file, and how a patch names one.
CALLS = ("tool_use", "function_call", "custom_tool_call")
SHELL = "local_shell_call"
DROPPED = (
    "tool_result", "function_call_output", "custom_tool_call_output", "local_shell_call_output",
    "thinking", "redacted_thinking", "reasoning",
)
FILE_KEYS = ("file_path", "path", "absolute_path", "notebook_path", "filePath")
PATCHED = r"(?m)^\*\*\* (?:Update|Add|Delete) File: (.+)$"
MOST_FILES = 200

def _no_strings() -> Column:
    return F.array().cast("array<string>")



def kind_of(v: Column) -> Column:
    """STRING, ARRAY, OBJECT, VOID and so on."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def string_at(v: Column, name: str) -> Column:
    """The field, if it is a string."""
    return F.when(kind_of(field(v, name)) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def patched_files(text: Column) -> Column:
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit(PATCHED), F.lit(1)), F.trim), _no_strings())


def named_files(call: Column) -> Column:
    """The paths that one tool call's arguments name: an object, or a string that is a patch or holds JSON."""
    is_text = kind_of(call) == "STRING"
    text = F.try_variant_get(call, "$", "string")
    obj = F.when(is_text, F.try_parse_json(text)).otherwise(call)
    fields = F.array(*(F.trim(string_at(obj, k)) for k in FILE_KEYS))
    return F.concat(F.when(is_text, patched_files(text)).otherwise(_no_strings()), F.filter(fields, lambda f: f != ""), *(patched_files(string_at(obj, k)) for k in ("input", "patch")))


def piece(b: Column) -> Column:
    """text, tool, named (files that a call names) and down (what is still to be looked at) of one block; at most one of text, tool and down is there."""
    kind, type_ = kind_of(b), F.coalesce(string_at(b, "type"), F.lit(""))
    is_obj = (kind == "OBJECT") & ~type_.isin(*DROPPED)
    call, shell = is_obj & type_.isin(*CALLS), is_obj & (type_ == SHELL)
    inner_call = field(b, "functionCall")
    inner = is_obj & ~call & ~shell & (F.coalesce(kind_of(inner_call), F.lit("")) == "OBJECT")
    answer = F.coalesce(~kind_of(field(b, "functionResponse")).isin("VOID"), F.lit(False))
    plain = is_obj & ~call & ~shell & ~inner & ~answer
    text, content = string_at(b, "text"), field(b, "content")
    named = lambda v: F.coalesce(F.nullif(string_at(v, "name"), F.lit("")), F.lit("tool"))
    present = lambda v: F.when(kind_of(v) != "VOID", v)
    args = F.when(call, F.coalesce(*(present(field(b, k)) for k in ("input", "arguments", "args")))).otherwise(field(inner_call, "args"))
    return F.struct(
        F.when(kind == "STRING", F.try_variant_get(b, "$", "string")).when(plain, text).alias("text"),
        F.when(call, named(b)).when(shell, F.lit("shell")).when(inner, named(inner_call)).alias("tool"),
        F.when((call | inner) & args.isNotNull(), once(args, named_files)).alias("named"),
        F.when(kind == "ARRAY", b).when(plain & text.isNull() & kind_of(content).isin("STRING", "ARRAY"), content).alias("down"),
    )


def _pieces(node: Column) -> Column:
    """The pieces of a value: of its elements if it is an array, else its own."""
    node = F.coalesce(node, F.parse_json(F.lit("null")))
    return F.transform(F.when(kind_of(node) == "ARRAY", F.try_variant_get(node, "$", "array<variant>")).otherwise(F.array(node)), piece)


def _joined(pieces: Column) -> list[Column]:
    """text, tools, files."""
    kept = lambda name: F.filter(F.transform(pieces, lambda p: p[name]), lambda t: t.isNotNull())
    return [trimmed(F.array_join(kept("text"), "\n")).alias("text"), kept("tool").alias("tools"), F.slice(F.array_distinct(F.flatten(kept("named"))), 1, MOST_FILES).alias("files")]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def with_contents(rows: DataFrame, content: str = "content") -> DataFrame:
    """The rows with text, tools and files in place of the content column (VARIANT). Words of all depths are joined by line ends in order; names of tools stay, what they were told
    and what they answered goes, but for the paths of files that a call names; so does reasoning. A null content is empty."""
    others = [c for c in rows.columns if c != content]
    base = written(rows.select(*others, _pieces(F.col(content)).alias("_pieces"), F.monotonically_increasing_id().alias("_row")))
    deep = F.exists("_pieces", lambda p: p["down"].isNotNull())
    done = base.filter(~deep).select(*others, *_joined(F.col("_pieces")))
    nested = base.filter(deep)
    if nested.isEmpty():
        return done
    parts = nested.select("_row", F.posexplode("_pieces").alias("_n", "p")).select("_row", F.array("_n").alias("_at"), "p.*")
    found = None
    while True:
        ends = parts.filter("down IS NULL").select("_row", F.struct("_at", "text", "tool", "named").alias("p"))
        found = ends if found is None else found.unionByName(ends)
        level = parts.filter("down IS NOT NULL").select("_row", "_at", _pieces(F.col("down")).alias("_pieces"))
        if level.isEmpty():
            break
        parts = written(level.select("_row", "_at", F.posexplode("_pieces").alias("_n", "p")).select("_row", F.concat("_at", F.array("_n")).alias("_at"), "p.*"))
    whole = found.groupBy("_row").agg(F.array_sort(F.collect_list("p")).alias("_pieces"))
    joined = nested.drop("_pieces").join(whole.hint("shuffle_merge"), "_row")
    return done.unionByName(joined.select(*others, *_joined(F.col("_pieces"))))
