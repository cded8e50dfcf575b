"""Secret scans with corpus-wide ownership frequency, in DataFrame functions throughout.

Candidate values, of the base rules and of much wider ones, are hashed; for each hash the distinct repositories and owners that hold
it are counted over the whole corpus. A value is a copied example if many owners hold it, or if some owners hold it in
many repositories; a value of one owner is live, in however many of the owner's repositories it lies. Matches of the base rules
always stay among the spans; a match of the wider rules stays if its value looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_join, stored, with_row_id
from .native_spans import located_if, spelled

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "bearer", "vendor", "mixed", "named", "address")

_WIDE_NAMES = r"(?:[A-Za-z0-9_.-]*(?:key|auth|pwd|pass|pin|credentials?|signature|salt|session|cookie|cert)[A-Za-z0-9_]*)"
#: kind: (where to look at all, pattern, does a match pass). The bounds inside hex and access accept the same
#: runs as a check of their length afterwards.
RULES = {
    "assign": (
        r"(?i)passw|secret|token|api_?key",
        r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+",
        lambda v: F.length(_assigned(v)) >= 8,
    ),
    "access": ("AKIA", r"AKIA[A-Z0-9]{12,}+", None),
    "hex": (r"[0-9a-f]{32}", r"(?<![0-9a-f])[0-9a-f]{32,}+", None),
    "bearer": (r"(?i)bearer ", r"(?i)(?<![A-Za-z0-9])bearer\x20++[A-Za-z0-9+/_.~=-]{16,}+", None),
    "vendor": (r"gh[pousr]_|xox[abp]-|[sr]k_live_|AIza|eyJ|npm_|SG\.", r"(?<![A-Za-z0-9_])(?:gh[pousr]_|xox[abp]-|[sr]k_live_|AIza|eyJ|npm_|SG\.)[A-Za-z0-9_.-]{20,}+", None),
    "mixed": (r"[A-Za-z0-9+/_-]{20}", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+", lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")),
    "named": (r"(?i)[a-z]\"?'?\x20?[:=]", rf"(?i)(?<![A-Za-z0-9_.-]){_WIDE_NAMES}[\"']?\x20?[:=]\x20?[\"'][^\s\"']{{8,}}+", None),
    "address": (r"://[^\s/@]{0,64}:", r"(?<![A-Za-z])[A-Za-z][A-Za-z0-9+.-]{1,15}+://[^\s/:@]{0,64}+:[^\s/@]{3,128}+@", None),
}
#: A value of this many owners or more is an example;
SHARED_BY = 3
#: and so is one of two owners or more that lies in this many repositories.
SPREAD_OVER = 6


def _assigned(value: Column) -> Column:
    """What an assignment assigns: the text after name, quote and sign."""
    return F.regexp_extract(value, r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", 1)


def _secret(kind: str, value: Column) -> Column:
    """The part of a match that is the secret itself."""
    if kind == "assign":
        return _assigned(value)
    if kind == "named":
        return F.regexp_extract(value, r"([^\s\"']+)$", 1)
    if kind == "bearer":
        return F.regexp_extract(value, r"([^\x20]+)$", 1)
    return value


def _of_kind(kind: str) -> Column:
    needed, pattern, passes = RULES[kind]
    spans = located_if(F.col("text").rlike(needed), F.col("text"), pattern)
    if passes:
        spans = F.filter(spans, lambda s: passes(s["value"]))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.sha2(_secret(kind, s["value"]).cast("binary"), 256).alias("hash")))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """row_id, doc_id, owner, repository, found array<struct<start,end,kind,hash>>."""
    df = docs.select(F.col(id_col).alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_row_id(df.select("doc_id", "owner", "repository", F.concat(*(_of_kind(kind) for kind in RULES)).alias("found")))


def ownership(rows: DataFrame) -> DataFrame:
    """hash, repositories, owners, places: counted in three steps, so that a value that fills a third of the
    corpus is one row a task after the first. A null owner or repository is one of its own."""
    one = rows.select("owner", "repository", F.explode("found.hash").alias("hash"))
    by_repository = one.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("places"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("places").alias("places"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.sum("places").alias("places"))


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, shared_by: int = SHARED_BY, spread_over: int = SPREAD_OVER
) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live (spans whose value looks live), examples (all
    spans of copied examples, base ones too), dropped (those of them that are not among the spans), most_owners and
    most_repositories (the largest counts of the row's values; null without a candidate).

    A null text is an empty one: no spans. Repeated rows give rows each, ids may be null, an empty table gives
    no rows, other columns are not read. A value held by exactly shared_by owners is an example. Time is linear in a text's length
    and matches. Owner and repository default to source, and source with lang; a null one is an owner of its own."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    rows = stored(candidates(docs, id_col, text_col, owner, repository))
    counts = stored(ownership(rows).select("hash", "owners", "repositories", "places", ((F.col("owners") >= shared_by) | (F.col("owners") >= 2) & (F.col("repositories") >= spread_over)).alias("example")))
    single = stored(rows.filter(F.size("found") > 0).select("row_id", "doc_id", F.explode("found").alias("s")).select("row_id", "doc_id", "s.*"))
    # one value may fill much of the corpus: its rows meet a broadcast of bounded size
    marked = skew_join(single, counts, ["hash"], "places")
    some = marked.groupBy("row_id", "doc_id").agg(F.collect_list(F.struct("start", "end", "kind", "example")).alias("s"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,example:boolean>>").alias("s")
    none = rows.filter(F.size("found") == 0).select("row_id", "doc_id", nothing, F.lit(None).cast("long").alias("most_owners"), F.lit(None).cast("long").alias("most_repositories"))
    is_base = lambda s: s["kind"].isin(*BASE)
    part = lambda test: F.filter("s", test)
    count = lambda kind: F.size(part(lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return none.unionByName(some).select(
        "doc_id", *map(count, BASE), F.sha2(spelled(part(is_base), KINDS).cast("binary"), 256).alias("base_sha256"),
        spelled(part(lambda s: is_base(s) | ~s["example"]), KINDS).alias("spans"), F.size(part(lambda s: ~s["example"])).cast("long").alias("n_live"),
        spelled(part(lambda s: s["example"]), KINDS).alias("examples"), spelled(part(lambda s: ~is_base(s) & s["example"]), KINDS).alias("dropped"), "most_owners", "most_repositories",
    )


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return secret_spans(read(spark, sf_dir, "documents"))
