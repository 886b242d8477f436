"""License scan by ordered signature rules, in Spark's own functions alone.

Texts are brought to words with a space on both sides of each.  Keywords gate the rules: a text is matched only
against rules whose keyword it holds.  Detections are word intervals; one that lies inside an interval of the same or a higher
priority is suppressed.
"""
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.license_rules import lines, word_regex

#: Phrases whose places are all counted, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
BASE_KEYWORDS = ("general", "apache", "cc", "mit")
#: Score of a text by the best priority among its detections.
SCORES = {1: 0.5, 2: 0.8, 3: 1.0}
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACES = "array<struct<first:int,stop:int,priority:int,label:string>>"


def wrapped_words(text: Column) -> Column:
    """' w1  w2  w3 ': ASCII lower case, every word between two spaces; '' without words."""
    inner = F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _GAP, "  "))
    return F.when(inner == "", "").otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def count_words(wrapped: Column) -> Column:
    """Words of a run of wrapped words."""
    return F.floor((F.length(wrapped) - F.length(F.replace(wrapped, F.lit(" "), F.lit("")))) / 2).cast("int")


def rule_table() -> list[dict]:
    return [{"keyword": f" {k} ", "regex": word_regex(p), "priority": n, "label": label} for label, n, k, p in lines()]


def keyword_regex(keywords: list[str]) -> str:
    """One pattern for all wrapped keywords, by their first letter, so that most words fail at once."""
    by_letter = {c: [k[1:] for k in keywords if k[0] == c] for c in sorted({k[0] for k in keywords})}
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ") "


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """An array in consecutive blocks of about the square root of its length.  A walk that adds to an array copies it at
    each step; walked block by block, n items take n * sqrt(n) copies at most."""

    def cut(given: Column) -> Column:
        size = F.size(given)
        return _let(F.greatest(F.lit(1), F.ceil(F.sqrt(size)).cast("int")), lambda width: F.transform(
            F.sequence(F.lit(0), F.ceil(size / width).cast("int")), lambda b: F.slice(given, b * width + 1, width)))

    return _let(items, cut)


def places(wrapped: Column, regex: Column, priority: Column, label: Column) -> Column:
    """Intervals [first, stop) of the matches, in words: matches and the gaps between them are walked side by side."""
    gaps = F.split(wrapped, regex, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(wrapped, regex, F.lit(0)).alias("hit"))
    counts = F.transform(pairs, lambda x: F.struct(count_words(x["gap"]).alias("gap"), F.coalesce(count_words(x["hit"]), F.lit(0)).alias("hit")))
    spans = "array<struct<first:int,stop:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))

    def step(acc, pair):
        first = acc["at"] + pair["gap"]
        stop = first + pair["hit"]
        made = F.when(pair["hit"] > 0, F.array(F.struct(first.alias("first"), stop.alias("stop")))).otherwise(F.array().cast(spans))
        return F.struct(stop.alias("at"), F.concat(acc["out"], made).alias("out"))

    # each block from word 0 on, then every block moved by the words before it
    walked = F.transform(_blocks(counts), lambda block: F.aggregate(block, start, step))
    moved = F.aggregate(walked, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<base:int,out:{spans}>>").alias("out")), lambda acc, b: F.struct(
        (acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("base"), b["out"].alias("out")))).alias("out")))["out"]
    return F.flatten(F.transform(moved, lambda b: F.transform(b["out"], lambda d: F.struct(
        (d["first"] + b["base"]).alias("first"), (d["stop"] + b["base"]).alias("stop"), priority.alias("priority"), label.alias("label")))))


def unsuppressed(found: Column) -> Column:
    """The detections that lie in no other interval of the same or a higher priority, by first word; of equal ones
    the first label stays.  One walk in order of (first, stop descending, priority descending, label), with the
    furthest stop seen so far for each priority or above."""
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["stop"]).alias("back"), (-d["priority"]).alias("less"), d["label"].alias("label"))))
    none = F.lit(-1)
    far = lambda acc, name, least, stop, priority: F.when(priority >= least, F.greatest(acc[name], stop)).otherwise(acc[name])
    seen = lambda acc, d: F.struct(*[far(acc, f"m{k}", k, -d["back"], -d["less"]).alias(f"m{k}") for k in (1, 2, 3)])

    def step(acc, d):
        stop, priority = -d["back"], -d["less"]
        before = F.when(priority == 3, acc["m3"]).when(priority == 2, acc["m2"]).otherwise(acc["m1"])
        made = F.struct(d["first"].alias("first"), stop.alias("stop"), priority.alias("priority"), d["label"].alias("label"))
        out = F.when(before >= stop, acc["out"]).otherwise(F.concat(acc["out"], F.array(made)))
        return F.struct(*[far(acc, f"m{k}", k, stop, priority).alias(f"m{k}") for k in (1, 2, 3)], out.alias("out"))

    # what each block has seen at its start, then every block by itself
    state = F.struct(none.alias("m1"), none.alias("m2"), none.alias("m3"))
    kind = "struct<m1:int,m2:int,m3:int>"
    block = f"struct<seen:{kind},block:array<struct<first:int,back:int,less:int,label:string>>>"
    begun = F.aggregate(_blocks(order), F.struct(state.alias("seen"), F.array().cast(f"array<{block}>").alias("out")), lambda acc, b: F.struct(
        F.aggregate(b, acc["seen"], seen).alias("seen"), F.concat(acc["out"], F.array(F.struct(acc["seen"].alias("seen"), b.alias("block")))).alias("out")))["out"]
    return F.flatten(F.transform(begun, lambda x: F.aggregate(x["block"], F.struct(*[x["seen"][f"m{k}"].alias(f"m{k}") for k in (1, 2, 3)], F.array().cast(PLACES).alias("out")), step)["out"]))


def license_scan(docs: DataFrame, *, text: str = "text", out: str = "license") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words; base (places of the BASE phrases, all of them); detections
    (intervals of words with priority and label, after suppression); score (0 without a detection, else by the best priority).

    Null texts count as empty: no words, no places, score 0.  Repeated rows are judged alike; an input column named
    ``out`` is replaced.
    """
    rules = rule_table()
    keywords = sorted({r["keyword"].strip() for r in rules} | set(BASE_KEYWORDS))
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    typed = F.from_json(F.lit(json.dumps(rules)), "array<struct<keyword:string,regex:string,priority:int,label:string>>")
    wide = docs.select(*columns, wrapped_words(F.col(f"`{text}`")).alias("__w"))
    wide = wide.withColumn("__kw", F.array_distinct(F.regexp_extract_all("__w", F.lit(keyword_regex(keywords)), F.lit(0))))
    none = F.array().cast(PLACES)
    gated = F.filter(typed, lambda r: F.array_contains(F.col("__kw"), r["keyword"]))
    wide = wide.withColumn("__found", F.when(F.size("__kw") == 0, none).otherwise(
        unsuppressed(F.flatten(F.transform(gated, lambda r: places(F.col("__w"), r["regex"], r["priority"], r["label"]))))))
    base = [F.when(F.array_contains("__kw", F.lit(f" {k} ")), places(F.col("__w"), F.lit(word_regex(p)), F.lit(0), F.lit(label))).otherwise(none) for (p, label), k in zip(BASE, BASE_KEYWORDS)]
    wide = wide.withColumn("__base", F.when(F.size("__kw") == 0, none).otherwise(F.flatten(F.array(*base))))
    best = F.array_max(F.transform("__found", lambda d: d["priority"]))
    score = F.lit(0.0)
    for priority, value in SCORES.items():
        score = F.when(best == priority, F.lit(value)).otherwise(score)
    made = F.struct(count_words(F.col("__w")).cast("bigint").alias("n_words"), F.col("__base").alias("base"), F.col("__found").alias("detections"), score.alias("score"))
    return wide.withColumn(out, made).drop("__w", "__kw", "__found", "__base")


def label_list(*places: Column) -> Column:
    """Distinct labels, sorted and joined by commas."""
    labels = F.flatten(F.array(*[F.transform(p, lambda d: d["label"]) for p in places]))
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
