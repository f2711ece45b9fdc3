"""License scan by ordered signature rules, DataFrame operations only."""

from __future__ import annotations

import json
import string
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from themescope.llm.license_rules import ANCHORS, Rule, rules as all_rules

#: Phrases that are counted whatever the rules say, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RULES = "array<struct<rank:int,priority:int,weight:double,label:string,keyword:string,pattern:string>>"
_SEEN = "array<struct<first:int,last:int,priority:int,rank:int,label:string,weight:double>>"


def _gate(text):
    """Texts that can match anything at all: each rule needs one of the anchors of its form, each base
    phrase "licen" or the words of the last test."""
    anchored = F.exists(F.array(F.lower(text)), lambda low: reduce(or_, [F.contains(low, F.lit(a)) for a in ANCHORS]))
    return anchored | text.rlike(r"[cC][cC][^0-9A-Za-z\x80-\x{10FFFF}]+[bB][yY][^0-9A-Za-z\x80-\x{10FFFF}]+[nN][cC]")


def _words_in(text):
    """Number of words, from the parts between them; an outer part is empty where the text does not
    begin or end with a word."""
    def inner(parts):
        return (F.size(parts) - F.when(parts[0] == "", 1).otherwise(0)
                - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")

    return F.transform(F.array(F.split(text, _NOT_WORD)), inner)[0]  # one split for all three uses


def _base(words):
    """Count, first and last word of the base phrases, and their labels; ``words`` has every word
    between two spaces of its own."""
    count, firsts, lasts, labels = F.lit(0), [], [], []
    back = F.reverse(words)
    for phrase, label in BASE.items():
        spaced = "".join(f" {w} " for w in phrase.split())
        held = F.contains(words, F.lit(spaced))
        count = count + F.when(held, (F.length(words) - F.length(F.replace(words, F.lit(spaced), F.lit("")))) / len(spaced)).otherwise(0)
        before = F.substring_index(words, spaced, 1)
        after = F.reverse(F.substring_index(back, spaced[::-1], 1))
        firsts.append(F.when(held, _count(before)))
        lasts.append(F.when(held, _count(words) - _count(after) - len(phrase.split())))
        labels.append(F.when(held, F.lit(label)))
    return (count.cast("long"), F.least(*firsts).cast("long"), F.greatest(*lasts).cast("long"),
            F.array_sort(F.array_compact(F.array(*labels))))


def _count(words):
    return ((F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))) / 2).cast("int")


def _detections(text, table: list[Rule]):
    """Matches of all rules whose keyword is there, as [first, last) character runs."""
    entries = F.from_json(F.lit(json.dumps([r._asdict() for r in table])), _RULES)

    def places(rule):
        hits = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
        gaps = F.split(text, rule["pattern"], -1)
        lengths = F.zip_with(gaps, hits, lambda g, h: F.struct(
            F.length(g).alias("gap"), F.coalesce(F.length(h), F.lit(0)).alias("hit")))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SEEN})").alias("seen"))

        def step(acc, x):
            first = acc["at"] + x["gap"]
            one = F.array(F.struct(
                first.alias("first"), (first + x["hit"]).alias("last"), rule["priority"].alias("priority"),
                rule["rank"].alias("rank"), rule["label"].alias("label"), rule["weight"].alias("weight")))
            return F.struct((first + x["hit"]).alias("at"),
                            F.when(x["hit"] > 0, F.concat(acc["seen"], one)).otherwise(acc["seen"]).alias("seen"))

        return F.aggregate(lengths, start, step, lambda acc: acc["seen"])

    known = F.array(*[F.lit(k) for k in sorted({r.keyword for r in table})])
    present = F.array(F.array_intersect(F.split(text, " "), known))
    live = F.flatten(F.transform(present, lambda words: F.filter(
        entries, lambda r: F.array_contains(words, r["keyword"]))))
    return F.when(text.isNotNull(), F.flatten(F.transform(live, places)))


def _standing(seen):
    """Detections that no other suppresses: one that contains it and has a higher priority, or the same
    priority and a longer run, or the same run and an earlier rule."""
    def beats(a, b):
        wider = (b["last"] - b["first"]) > (a["last"] - a["first"])
        return (b["first"] <= a["first"]) & (b["last"] >= a["last"]) & (
            (b["priority"] > a["priority"])
            | ((b["priority"] == a["priority"]) & (wider | (~wider & (b["rank"] < a["rank"])))))

    return F.filter(seen, lambda a: ~F.exists(seen, lambda b: beats(a, b)))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 table: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_base, first_word, last_word, base_labels, labels,
    score.

    Words are runs of ASCII letters, digits and everything beyond ASCII, after lower-casing A-Z.  Base
    phrases are counted at every place; rules add labels of their own.  The score is 1 minus the product
    of (1 - weight) over the labels that stand (a base phrase weighs 0.8).  A missing or empty text has
    no words, labels "" and score 0; repeated rows, missing ids and extra columns pass as they are; an
    empty table gives none.

    One narrow pass: most texts are settled by the keyword pattern, the words of the others are
    normalised once, and a rule is tried only where its keyword stands.  Rules look at normalised words,
    so line breaks and punctuation do not matter, and no rule spans more than some 20 words.
    """
    table = table or all_rules()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), _words_in(text).alias("n_words"),
                       F.when(_gate(text), text).alias("gated"))
    folded = F.translate(F.col("gated"), string.ascii_uppercase, string.ascii_lowercase)
    plain = F.concat(F.lit(" "), F.regexp_replace(folded, _NOT_WORD, " "), F.lit(" "))
    rows = rows.select(id_col, "n_words", F.explode(F.array(plain)).alias("plain"))  # computed once
    words = F.replace(F.concat(F.lit(" "), F.trim("plain"), F.lit(" ")), F.lit(" "), F.lit("  "))
    inner = F.substring(words, F.lit(2), F.length(words) - 2)
    rows = rows.select(id_col, "n_words", "plain", F.explode(F.array(inner)).alias("words"))
    n_base, first, last, base = _base(F.col("words"))
    rows = rows.select(
        id_col, "n_words", n_base.alias("n_base"), first.alias("first_word"), last.alias("last_word"),
        base.alias("base"), F.explode(F.array(_detections(F.col("plain"), table))).alias("seen"))
    rows = rows.withColumn("standing", F.explode(F.array(_standing(F.col("seen"))))).drop("seen")
    found = F.transform("standing", lambda d: d["label"])
    every = F.array_sort(F.array_distinct(F.concat(F.coalesce("base", F.array()), F.coalesce(found, F.array()))))
    weight = lambda name: F.coalesce(F.array_max(F.transform(
        F.filter("standing", lambda d: d["label"] == name), lambda d: d["weight"])), F.lit(0.0))
    strength = lambda name: F.greatest(
        weight(name), F.when(F.array_contains(F.coalesce("base", F.array()), name), 0.8).otherwise(0.0))
    score = F.lit(1.0) - F.aggregate(F.col("every"), F.lit(1.0), lambda acc, name: acc * (1.0 - strength(name)))
    return rows.withColumn("every", every).select(
        id_col, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.coalesce("base", F.array()), ",").alias("base_labels"),
        F.array_join("every", ",").alias("labels"), F.round(score, 6).alias("score"))
