"""Cleaning of descriptions and merchants, and categories by words, as Spark columns without Python code."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V


def trimmed(c: Column) -> Column:
    """Without controls and spaces (up to U+0020) at both ends."""
    return F.btrim(c, F.lit("".join(map(chr, range(0x21)))))


def clean_description(raw: Column) -> Column:
    """References and runs of spaces go; null gives an empty text."""
    text = F.regexp_replace(trimmed(F.coalesce(raw, F.lit(""))), r"(?i)(?=[0-9UNRI])(?:[0-9]{9,20}|UPI/[A-Z0-9]+|REF[A-Z0-9]+|NEFT/[A-Z0-9]+|IMPS/[A-Z0-9]+)", " ")
    text = F.regexp_replace(text, r"/[A-Z0-9]{6,}/", " ")
    text = F.regexp_replace(text, r"\s{2,}", " ")
    return trimmed(F.regexp_replace(text, r"[/@\-_]+$", ""))


def merchant_of(description: Column) -> Column:
    """The first part of a description, without the payment rail; the second if the first is a number."""
    text = F.regexp_replace(trimmed(description), r"(?i)^(UPI-|NEFT-|IMPS-|VPA-|POS-|ATM-|ACH-|SI-|ECS-|DD-|NACH-)", "")
    parts = F.split(text, r"[/|\-]", 3)
    first = trimmed(F.get(parts, 0))
    number = first.rlike(r"^[0-9\s]+$")
    return F.when(number, trimmed(F.get(parts, 1))).when(F.length(first) >= 3, first)


def _first(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*[F.when(text.contains(word), F.lit(name)) for word, name in pairs])


def with_merchant_key(df: DataFrame, merchant: str = "merchant") -> DataFrame:
    """Add merchant_key (never null) and canonical_name (null unless a known brand).

    The key of a brand is its name's letters and digits; else up to two telling words of what is left
    without noise endings. Null, blank and number-only merchants have an empty key.
    """
    s = F.lower(trimmed(F.coalesce(F.col(merchant), F.lit(""))))
    s = F.regexp_replace(s, r"^www\.", "")
    s = F.regexp_replace(s, r"\.(com|in|co\.in|net|org|io|app|co|tv|me|edu|ai)\b", "")
    s = F.regexp_replace(s, r"\b\d{5,}\b", "")
    s = F.regexp_replace(s, r"\b(upi|imps|neft|rtgs|ach|paytm|gpay|phonepe|bhim)[/\-:]?", "")
    s = F.regexp_replace(s, r"\(.*?\)", " ")
    s = F.regexp_replace(s, r"[/_\-]+", " ")
    s = F.regexp_replace(s, r"[^a-z0-9 ]", " ")
    s = trimmed(F.regexp_replace(s, r"\s+", " "))
    endings = "|".join(sorted(V.NOISE_ENDINGS, key=len, reverse=True))
    out = df.withColumn("_s", s)
    out = out.withColumn("_stripped", trimmed(F.regexp_replace("_s", rf"(?:(?:^| )(?:{endings}))+$", "")))
    # what holds a brand before the endings go, or else after
    out = out.withColumn("canonical_name", F.coalesce(_first(F.col("_s"), V.BRANDS), _first(F.col("_stripped"), V.BRANDS)))
    words = F.filter(F.split("_stripped", " "), lambda w: (F.length(w) >= 2) & ~w.isin(*V.STOPWORDS))
    one, two = F.get(words, 0), F.coalesce(F.get(words, 1), F.lit(""))
    picked = F.when(F.length(one) >= 12, one).otherwise(F.concat(one, two))
    fallback = F.coalesce(picked, F.replace("_stripped", F.lit(" "), F.lit("")))
    key = F.when(F.col("canonical_name").isNotNull(), F.regexp_replace(F.lower("canonical_name"), "[^a-z0-9]", "")).otherwise(fallback)
    return out.withColumn("merchant_key", key).drop("_s", "_stripped")


def words_pattern(words: Iterable[str]) -> str:
    """A pattern that, at each place where any of the words begins, captures the longest one without moving on."""
    tree: dict = {}
    for word in words:
        at = tree
        for sign in word:
            at = at.setdefault(sign, {})
        at[""] = {}

    def plain(sign: str) -> str:
        return sign if sign.isalnum() else "\\" + sign

    def one_of(signs: Iterable[str]) -> str:
        return f"[{''.join(map(plain, sorted(signs)))}]"

    def pattern(at: dict) -> str:
        ways = [plain(sign) + pattern(below) for sign, below in sorted(at.items()) if sign]
        one = ways[0] if len(ways) == 1 and "" not in at else f"(?:{'|'.join(ways)})" if ways else ""
        return one + "?" if ways and "" in at else one

    if not tree or "" in tree:
        return f"(?=({pattern(tree)}))"
    seconds = {sign for below in tree.values() for sign in below}
    # most places fail by their first two signs, without a try of each letter
    return f"(?={one_of(tree)}{one_of(seconds) if '' not in seconds else ''})(?=({pattern(tree)}))"


def with_category(df: DataFrame, description: str = "description", merchant: str = "merchant", lexicon: dict[str, tuple[str, ...]] = V.LEXICON) -> DataFrame:
    """Add category and confidence (decimal) by the words of lexicon in description and merchant.

    Each category scores 0.45, 0.12 for each of its words that occurs and 0.08 more for one of over 6
    letters, 0.95 at most; the best wins, a tie goes to the category that stands first. No word at all:
    UNCATEGORIZED with 0.25.
    """
    text = F.concat(F.lower(F.coalesce(F.col(description), F.lit(""))), F.lit(" "), F.lower(F.coalesce(F.col(merchant), F.lit(""))))
    listed = [{"n": n, "word": w, "at": at, "points": 12 + 8 * (len(w) > 6)} for n, (at, w) in enumerate((at, w) for at, words in enumerate(lexicon.values()) for w in words)]
    # one search for all words; where the longest begins, those that it begins with occur too
    known = {w: [{k: x[k] for k in ("n", "at", "points")} for x in listed if w.startswith(x["word"])] for w in {x["word"] for x in listed}}
    known = F.from_json(F.lit(json.dumps(known)), "map<string,array<struct<n:int,at:int,points:int>>>")
    seen = F.array_distinct(F.regexp_extract_all(text, F.lit(words_pattern(x["word"] for x in listed)), F.lit(1)))
    scored = df.withColumn("_seen", seen).withColumn("_hits", F.when(F.size("_seen") > 0, F.array_distinct(F.flatten(F.transform("_seen", lambda w: F.try_element_at(known, w))))))
    points = lambda at: F.aggregate("_hits", F.lit(0), lambda s, k: s + F.when(k["at"] == at, k["points"]).otherwise(0))
    made = F.transform("_hits", lambda h: F.struct(F.least(F.lit(95), points(h["at"]) + 45).alias("score"), (-h["at"]).alias("order")))
    scored = scored.withColumn("_best", F.array_max(made)).drop("_seen", "_hits")
    found = F.col("_best").isNotNull()
    category = F.coalesce(F.when(found, F.get(F.array(*map(F.lit, lexicon)), -F.col("_best.order"))), F.lit("UNCATEGORIZED"))
    confidence = (F.when(found, F.col("_best.score")).otherwise(25) / 100).cast("decimal(5,4)")
    return scored.withColumn("category", category).withColumn("confidence", confidence).drop("_best")
