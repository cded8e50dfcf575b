"""Personal data by candidate gradient boosting, in DataFrame functions throughout.

Strict rules give the base spans. Generators of high recall propose what they miss: addresses spelled out or spaced, numbers in
unusual groups, national phone numbers. Proposals of different kinds may overlap. Each is described by twelve yes/no
features of its format and context; trees of depth two are boosted on counts by (kind, bits, label), a table of bounded
size, and written out as one SQL expression.

Labels are not the rule that a candidate has to get past. Half of the weight comes from labelled readings (see
pii_readings; a table of one's own may take their place), half from the corpus: texts of a strict form that pass the
strict check against those of the same form that fail it. Proposals of the corpus are not labelled and teach nothing.
Thresholds are calibrated for each kind on readings that did not teach: the widest choice that is precise enough there.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .native_spans import bind, blanked, located_if, spelled
from .pii_readings import readings as default_readings

KINDS = ("email", "ip", "card", "phone")

#: The strict rules. Possessive runs and the guards before them keep the search linear; they match the same
#: spans as the plain forms.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
STRICT_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+"}
#: The generators: what looks remotely like it.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?:\x20?[\[({<]\x20?(?i:at|@)\x20?[\])}>]\x20?|\x20?@\x20?)[A-Za-z0-9-]++"
    r"(?:(?:\x20?[\[({<]\x20?(?i:dot|\.)\x20?[\])}>]\x20?|\x20(?i:dot)\x20|\.)[A-Za-z0-9-]++)*+"
    r"|\x20(?i:at)\x20[A-Za-z0-9-]++(?:(?:\x20(?i:dot)\x20|\.)[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?:(?:\x20?[\[(]\x20?(?i:dot|\.)\x20?[\])]\x20?|\x20(?i:dot)\x20|\x20?\.\x20?)[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20./_-]{0,3}+[0-9])++(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])[+(]?[0-9](?:[\x20()./-]{0,3}+[0-9])++(?![0-9A-Za-z])",
}
NEEDS = {
    "email": r"(?i)@|[\[(<{] ?at ?[\])>}]| at [a-z0-9-]+( dot |\.[a-z0-9-])",
    "ip": r"(?i)[0-9][ \[(]{0,2}(dot|\.)[ \])]{0,2}[0-9]",
    "card": r"[0-9]([ ./_-]{0,3}[0-9]){12}",
    "phone": r"[0-9]([ ()./-]{0,3}[0-9]){6}",
}
#: Digits that a proposal has.
DIGITS = {"email": (0, 1 << 30), "ip": (4, 12), "card": (13, 19), "phone": (7, 15)}
WORDS = {"email": "mail|contact|kontakt|correo|courriel", "ip": "ip|host|server|addr", "card": "card|visa|karte|carte|tarjeta", "phone": "phone|tel|call|fax|mobil"}
OTHER_WORDS = "version|release|build|chapter|section|rows|list|scores|isbn|order|invoice|tracking|ref|serial|page|date|amount|total|id|no|nr|met|looked|than|sold|see"

ROUNDS, RATE, LEAST_WEIGHT = 40, 0.3, 5.0
PRECISION, LEAST_CALIBRATION = 0.95, 20
FEATURES = 12
#: What each of the two sources of labels weighs in all.
WEIGHT = 1_000.0


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small(part: Column) -> Column:
    return bind(F.regexp_replace(part, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (F.lpad(q, 3, "0") <= "255"))


def strict_check(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small)
    if kind == "card":
        return bind(_only_digits(value), lambda d: F.when(F.length(d).between(14, 19), F.call_function("luhn_check", d)).otherwise(False))
    return F.length(_only_digits(value)).between(10, 15)


def _features(kind: str, s: Column) -> Column:
    """The bits of one span."""
    value = s["value"]
    digits = _only_digits(value)
    valid = {
        "email": value.rlike(r"(?i)(?:\.|dot)[\])}>\x20]*(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk)$"),
        "ip": F.forall(F.filter(F.split(value, "[^0-9]+"), lambda p: p != ""), _small),
        "card": bind(digits, lambda d: F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(False)),
        "phone": F.length(digits).between(10, 15),
    }[kind]
    shape = {
        "email": (r"(?i)[\[({<]\x20?(?:at|@)", r"(?i)\x20(?:at|dot)\x20", r"\x20@|@\x20|@[A-Za-z0-9-]+$"),
        "ip": (r"[\[(]", r"(?i)\x20dot\x20", r"\x20\.|\.\x20"),
        "card": (r"^[3-6]", r"^[0-9]{4}(?:[^0-9]{1,3}[0-9]{4}){3}$", r"[./_]"),
        "phone": (r"^(?:00|0|\()", r"[0-9][^0-9]+[0-9]+[^0-9]+[0-9]", r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-]|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}"),
    }[kind]
    bits = (
        s["before"].rlike(rf"(?i)(?:{WORDS[kind]})"),
        s["after"].rlike(rf"(?i)^.{{0,12}}(?:{WORDS[kind]})"),
        s["before"].rlike(rf"(?i)(?:^|[^A-Za-z])(?:{OTHER_WORDS})[^A-Za-z]*$"),
        s["after"].rlike(r"(?i)^\x20?(?:%|€|\$|£|eur|usd|kg|km|units|each|pieces)"),
        s["before"].rlike(r"[\p{L}\p{N}]$"),
        s["after"].rlike(r"^[\p{L}\p{N}]"),
        value.rlike(r"([0-9A-Za-z])\1{4}"),
        F.length(value) > 20,
        valid,
        *(value.rlike(p) for p in shape),
    )
    total = F.lit(0)
    for k, bit in enumerate(bits):
        total = total + F.when(bit, 1 << k).otherwise(0)
    return total


def _span(kind: str, s: Column) -> tuple[Column, ...]:
    return s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")


def _strict(kind: str, text: Column) -> Column:
    """What has the strict form, label telling whether it passes the strict check."""
    hits = located_if(text.rlike(STRICT_NEEDS[kind]), text, STRICT[kind])
    return F.transform(hits, lambda s: F.struct(*_span(kind, s), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after"), strict_check(kind, s["value"]).alias("label")))


def _base(kind: str) -> Column:
    return F.transform(F.filter(kind, lambda s: s["label"]), lambda s: F.struct(*_span(kind, s)))


def _taught(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), _features(kind, s).alias("bits"), s["label"].alias("label")))


def _without_base(kind: str, text: Column) -> Column:
    blank = lambda t: blanked(t, STRICT[kind], lambda v: strict_check(kind, v))
    return bind(text, lambda t: F.when(F.exists(kind, lambda s: s["label"]), blank(t)).otherwise(t))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base array<struct<start,end,kind>>, taught array<struct<kind,bits,label>> (what has a strict form, and whether it
    passes), loose array<struct<start,end,kind,bits>>. Proposals are sought where no base span lies."""
    text = F.col("text")
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = df.select("doc_id", "text", *(_strict(kind, text).alias(kind) for kind in KINDS))
    rest = text
    for kind in KINDS:
        rest = _without_base(kind, rest)
    base, taught = ([part(kind) for kind in KINDS] for part in (_base, _taught))
    return df.select("doc_id", F.concat(*base).alias("base"), F.concat(*taught).alias("taught"), rest.alias("rest")).select("doc_id", "base", "taught", proposals(F.col("rest")).alias("loose"))


def proposals(text: Column) -> Column:
    """What the generators find, as an array of structs of start, end, kind, bits."""

    def of_kind(kind: str):
        def found(t: Column) -> Column:
            low, high = DIGITS[kind]
            spans = F.filter(located_if(t.rlike(NEEDS[kind]), t, LOOSE[kind]), lambda s: F.length(_only_digits(s["value"])).between(low, high))
            return F.transform(spans, lambda s: F.struct(*_span(kind, s), _features(kind, s).alias("bits")))

        return found

    return bind(text, lambda t: F.concat(*(of_kind(kind)(t) for kind in KINDS)))


def boost(cells: list[tuple[int, float, float]], features: int = FEATURES, rounds: int = ROUNDS) -> list[tuple]:
    """Trees of depth two for log-odds, from cells (bits, weight of label 1, weight of label 0). A tree is
    (first, (second, value0, value1), (second, value0, value1)); the pairs belong to first = 0 and 1."""
    bits = np.array([c[0] for c in cells])
    pos, neg = np.array([c[1] for c in cells]), np.array([c[2] for c in cells])
    #: column 2 f + v: has the cell value v in feature f?
    has = np.stack([(bits >> f & 1) == v for f in range(features) for v in (0, 1)], axis=1).astype(float)
    pairs = lambda w: has.T @ (w[:, None] * has)
    margin, trees, weight = np.zeros(len(cells)), [], pairs(pos + neg)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = pairs(pos * (1 - p) - neg * p), pairs((pos + neg) * p * (1 - p))
        gain = g * g / (h + 1)
        both = gain[:, 0::2] + gain[:, 1::2]
        both[np.minimum(weight[:, 0::2], weight[:, 1::2]) < LEAST_WEIGHT] = -1
        alone = np.diag(gain)
        second, whole = both.argmax(axis=1), both.max(axis=1) <= alone + 1e-9
        best = np.where(whole, alone, both.max(axis=1))
        first = int((best[0::2] + best[1::2]).argmax())
        if best[2 * first] + best[2 * first + 1] < 1e-6:
            break
        sides = []
        for row in (2 * first, 2 * first + 1):
            leaf = lambda c, row=row: float(RATE * g[row, c] / (h[row, c] + 1))
            s = int(second[row])
            sides.append((0, leaf(row), leaf(row)) if whole[row] else (s, leaf(2 * s), leaf(2 * s + 1)))
        trees.append((first, *sides))
        margin = margin + np.array([tree_value(trees[-1], int(b)) for b in bits])
    return trees


def tree_value(tree: tuple, bits: int) -> float:
    second, a, b = tree[1 + (bits >> tree[0] & 1)]
    return b if bits >> second & 1 else a


def tree_column(trees: list[tuple], bits: Column) -> Column:
    """The summed margin as an expression."""

    def has(k: int) -> Column:
        return bits.bitwiseAND(F.lit(1 << k)) != 0

    total = F.lit(0.0)
    for first, (s0, a0, b0), (s1, a1, b1) in trees:
        total = total + F.when(has(first), F.when(has(s1), b1).otherwise(a1)).otherwise(F.when(has(s0), b0).otherwise(a0))
    return total


def fit(rows: DataFrame, readings: DataFrame) -> dict[str, tuple[list[tuple], float]]:
    """For each kind the trees and the least margin that is redacted (infinite if no choice is precise enough).
    readings: kind, text, start, end, label; a proposal that overlaps the marked span takes its label.

    At most 2 * 2 * 4 * 4096 * 2 counts reach the driver. One reading in three calibrates and does not teach."""
    corpus = rows.select(F.lit("corpus").alias("origin"), F.lit(False).alias("held"), F.explode("taught").alias("c")).select("origin", "held", "c.*")
    read = readings.select("kind", "start", "end", "label", F.pmod(F.xxhash64("text"), F.lit(3)).alias("part"), F.explode(proposals(F.col("text"))).alias("c"))
    read = read.filter("c.kind = kind AND c.start < end AND start < c.end").select(F.lit("reading").alias("origin"), (F.col("part") == 0).alias("held"), "c.kind", "c.bits", "label")
    counts = corpus.unionByName(read).groupBy("origin", "held", "kind", "bits", "label").count().collect()
    total: dict[tuple, float] = {}
    for r in counts:
        key = (r["origin"], r["held"], r["kind"])
        total[key] = total.get(key, 0.0) + r["count"]
    out = {}
    for kind in KINDS:
        taught: dict[int, list[float]] = {}
        held: dict[int, list[float]] = {}
        for r in counts:
            if r["kind"] == kind:
                if r["held"]:
                    held.setdefault(r["bits"], [0.0, 0.0])[0 if r["label"] else 1] += r["count"]
                else:
                    taught.setdefault(r["bits"], [0.0, 0.0])[0 if r["label"] else 1] += r["count"] * WEIGHT / total[r["origin"], False, kind]
        trees = boost([(bits, *w) for bits, w in sorted(taught.items())]) if taught else []
        margins = sorted(((sum(tree_value(t, bits) for t in trees), *w) for bits, w in held.items()), reverse=True)
        least, good, bad = math.inf, 0.0, 0.0
        for k, (margin, pos, neg) in enumerate(margins):
            good, bad = good + pos, bad + neg
            if k + 1 < len(margins) and margins[k + 1][0] == margin:
                continue
            if good + bad >= LEAST_CALIBRATION and good / (good + bad) >= PRECISION:
                least = margin
        out[kind] = (trees, least - 1e-9)
    return out


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", readings: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Strict matches always stay; a proposal is added if its margin reaches its kind's threshold. Spans of different kinds
    may overlap. A null text is an empty one: no spans. Repeated rows give rows each, ids may be null, an empty table gives no
    rows, other columns are not read. Time is linear in a text's length and matches, however many."""
    rows = stored(candidates(docs, id_col, text_col))
    if readings is None:
        readings = docs.sparkSession.createDataFrame(default_readings(), "kind string, text string, start long, end long, label boolean")
    model = fit(rows, readings)
    added = F.filter("loose", lambda c: _chosen(model, c))
    rows = rows.select("doc_id", "base", F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))).alias("added"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(spelled(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), spelled(F.concat("base", "added"), KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"))


def _chosen(model: dict, c: Column) -> Column:
    out = F.lit(False)
    for kind, (trees, least) in model.items():
        if math.isfinite(least):
            out = out | (c["kind"] == kind) & (tree_column(trees, c["bits"]) >= least)
    return out


def op2_pii(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return pii_spans(read(spark, sf_dir, "documents"))
