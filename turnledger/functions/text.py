"""Text normalisation and the expressions built on it."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that carry no letter, letters that fold to another, two families of digits, the article.
MARKS = "ؐ-ًؚ-ٰٟۖ-ۭـ"
FOLD_FROM = "آأإٱىةؤئ" + "٠١٢٣٤٥٦٧٨٩" + "۰۱۲۳۴۵۶۷۸۹"
FOLD_TO = "اااايهوي" + "0123456789" + "0123456789"
ARTICLE = "ال"

_COMBINING = r"[̀-ͯٓ-ٕ]"
_TABLE = str.maketrans(FOLD_FROM, FOLD_TO)
_MARKS = re.compile(f"[{MARKS}]")


def once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _composed(text):
    return text.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


def _compose(text: Column) -> Column:
    return F.pandas_udf(_composed, "string")(text)


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """The rows with these texts in canonical composition, so that a letter and its accent are one whether they were written as one or two. Only rows that hold a
    combining mark leave the JVM: the frame is split and put together again."""
    marked = F.lit(False)
    for c in columns:
        marked = marked | F.coalesce(F.col(c).rlike(_COMBINING), F.lit(False))
    apart = df.filter(marked).withColumns({c: _compose(F.col(c)) for c in columns})
    return df.filter(~marked).unionByName(apart.select(*df.columns))


#: What folding can change: marks, folded letters and digits all lie in this block.
_FOLDABLE = "[\u0600-\u06FF]"


def normalised(text: Column, compose: bool = True) -> Column:
    """Composed, without marks, letters and digits folded, lower case. Only rows that hold combining
    characters leave the JVM; with compose=False none do. Texts without a letter that folds are lowered alone."""
    if compose:
        text = F.when(text.rlike(_COMBINING), _compose(F.when(text.rlike(_COMBINING), text))).otherwise(text)
    return F.lower(F.when(text.rlike(_FOLDABLE), F.translate(F.regexp_replace(text, f"[{MARKS}]", ""), FOLD_FROM, FOLD_TO)).otherwise(text))


def normalise(text: str) -> str:
    """The same for one string."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFC", text)).translate(_TABLE).lower()


#: What parts search terms, and what they are made of.
BETWEEN_TERMS, TERM = r"[^\p{L}\p{N}_]+", r"[\p{L}\p{N}_]+"


def bare(word: Column) -> Column:
    """A word without the article, if it has more than four characters."""
    return F.when((F.length(word) > 4) & word.startswith(ARTICLE), F.substring(word, 3, 1 << 30)).otherwise(word)


def terms(text: Column, compose: bool = False) -> Column:
    """Search terms: runs of letters, digits and underscores of the normalised text, the article stripped from
    words of more than four characters."""
    return F.transform(F.filter(F.split(normalised(text, compose), BETWEEN_TERMS), lambda w: w != ""), bare)


def claim_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(normalised(text, False), r"\s+", " "))


def equivalent(a: Column, b: Column) -> Column:
    """Two claim forms say the same: equal, or one within the other when both are longer than 12."""
    return (a == b) | ((F.length(a) > 12) & (F.length(b) > 12) & (a.contains(b) | b.contains(a)))


def name_form(text: Column) -> Column:
    """A name with case and separators set aside."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s_-]+", "")


def key_forms(key: Column) -> Column:
    """All spellings under which two keys are one: words parted at dots, dashes and underscores, each word as
    it stands or without a plural ending. Two keys are the same when the arrays meet."""
    segments = F.split(F.lower(F.trim(key)), r"\.")

    def word_forms(w: Column) -> Column:
        plural = F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.expr("1"))
        return F.concat(
            F.array(w),
            F.when(plural.isNotNull(), F.array(F.left(w, F.length(w) - 1))).otherwise(F.array().cast("array<string>")),
            F.when((F.length(w) > 4) & w.endswith("ies"), F.array(F.concat(F.left(w, F.length(w) - 3), F.lit("y")))).otherwise(F.array().cast("array<string>")),
        )

    marked = F.flatten(F.transform(segments, lambda s: F.concat(F.array(F.lit(".")), F.filter(F.split(s, r"[-_\s]+"), lambda w: w != ""))))
    start = F.array(F.lit("")).cast("array<string>")
    return F.aggregate(marked, start, lambda acc, w: F.flatten(F.transform(acc, lambda a: F.transform(F.when(w == ".", F.array(w)).otherwise(word_forms(w)), lambda f: F.concat(a, F.lit("-"), f)))))
