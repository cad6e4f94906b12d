"""Operator 9, license scans: ordered signature rules, in DataFrame operations only.

Hundreds of regexes (license_rules) run on the normalised words of a text. A gate of literals over the whole text and the
keywords of each rule, both read off the regexes so that no match is lost, come first: most texts cost one regex, and
most rules a search for a literal. Overlapping detections are resolved by priority and interval containment: a detection
inside another of the same or higher priority goes.

All work stays inside a row: no shuffle, no join, no group of rows.

Defined results: a null or empty text has no words and no labels, score 0; repeated rows are judged alike, each by
itself; of detections with equal span and priority the first by label stays (ties); an empty table gives an empty result;
other columns, whatever their names, are ignored; texts of any length are scanned whole, and a text's matches are what
bounds memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import BASE, Rule, gate, needed, rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words in a lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NONE = "array<struct<start:int,back:int,low:int,label:string>>"


def words_of(text: Column) -> Column:
    """The words, with A-Z lower-cased, and a space before and after each: ' a b c '.

    Other letters are lower-cased too, which costs less and changes no ASCII word; of the two that would give an ASCII
    letter, texts are lower-cased letter by letter.
    """
    plain = F.when(text.contains("\u0130") | text.contains("\u212a"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, GAP, " ")), F.lit(" "))


def _count(piece: Column) -> Column:
    """Words in a piece between matches: each has its space before it."""
    return F.octet_length(piece) - F.octet_length(F.replace(piece, F.lit(" "), F.lit("")))


#: Stands for a match when a text is cut into what lies between matches; no normalised text has it.
_MARK = "\x01"


def _tried(rule: Rule) -> str:
    """SQL of a rule's matches in `norm` and what lies between them; null if its keywords don't occur.

    Patterns are literals, so each is compiled once. Rules have neither quotes nor backslashes.
    """
    rare_first = sorted(needed(rule.regex), key=lambda clause: (len(clause), -min(map(len, clause))) if clause != (" under ",) else (99, 0))
    there = " and ".join("(" + " or ".join(f"contains(norm, '{x}')" for x in clause) + ")" for clause in rare_first)
    regex = f"' {rule.regex}(?= )'"
    pieces = f"split(regexp_replace(norm, {regex}, '{_MARK}'), '{_MARK}', -1)"
    return f"case when {there} then named_struct('hits', regexp_extract_all(norm, {regex}, 0), 'pieces', {pieces}, 'low', {-rule.priority}, 'label', '{rule.label}') end"


def _spans(tried: Column) -> Column:
    """A rule's matches as (start, -end, -priority, label), in words from 0."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + _count(pair["piece"])
        end = at + _count(pair["hit"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(at.alias("start"), (-end).alias("back"), tried["low"].alias("low"), tried["label"].alias("label"))).alias("out"))

    pairs = F.zip_with(tried["hits"], F.slice(tried["pieces"], F.lit(1), F.size(tried["hits"])), lambda h, p: F.struct(h.alias("hit"), p.alias("piece")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _resolve(dets: Column) -> Column:
    """(labels, best priority) of the detections that no other contains with the same or a higher priority."""
    zero = F.struct(*(F.lit(-1).alias(f"m{p}") for p in (1, 2, 3, 4)), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["back"], -d["low"]
        covered = F.element_at(F.array(*(acc[f"m{p}"] for p in (1, 2, 3, 4))), priority)
        stays = covered < end
        reach = [F.when(priority >= p, F.greatest(acc[f"m{p}"], end)).otherwise(acc[f"m{p}"]).alias(f"m{p}") for p in (1, 2, 3, 4)]
        return F.struct(*reach, F.when(stays, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"), F.when(stays, F.greatest(acc["best"], priority)).otherwise(acc["best"]).alias("best"))

    return F.aggregate(F.array_sort(dets), zero, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["best"].alias("best")))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    body = F.coalesce(F.col(text), F.lit(""))
    made = rules()
    d = docs.select(F.col(key).alias("doc_id"), words_of(body).alias("norm"))
    norm = F.col("norm")
    d = d.select("doc_id", "norm", F.when(norm == "  ", F.lit(0)).otherwise(_count(norm) - 1).cast("long").alias("n_words"))
    hits = []
    for phrase, _ in BASE:
        pattern = F.lit(f" {phrase}(?= )")
        pieces = F.split(norm, pattern, -1)
        after = _count(F.element_at(pieces, -1)) - 1
        n = F.size(pieces) - 1
        hits.append(F.when(norm.contains(f" {phrase} "), F.struct(n.alias("n"), _count(pieces[0]).alias("first"), (F.col("n_words") - after - len(phrase.split())).alias("last"))))
    d = d.select("doc_id", "n_words", "norm", *(h.alias(f"b{i}") for i, h in enumerate(hits)))
    tried = F.expr(f"array_compact(array({', '.join(map(_tried, made))}))")
    d = d.withColumn("tried", F.when(norm.rlike(gate(made)), tried))
    d = d.withColumn("dets", F.when(F.size("tried") > 0, F.flatten(F.transform("tried", _spans))))
    d = d.withColumn("found", F.when(F.size("dets") > 0, _resolve(F.col("dets"))))
    base = F.array_compact(F.array(*(F.when(F.col(f"b{i}").isNotNull(), F.lit(label)) for i, (_, label) in enumerate(BASE))))
    method = F.coalesce(F.col("found.labels"), F.array().cast("array<string>"))
    n_base = sum((F.coalesce(F.col(f"b{i}.n"), F.lit(0)) for i in range(1, len(BASE))), F.coalesce(F.col("b0.n"), F.lit(0)))
    return d.select(
        "doc_id",
        "n_words",
        n_base.cast("long").alias("n_base"),
        F.least(*(F.col(f"b{i}.first") for i in range(len(BASE)))).cast("long").alias("first_word"),
        F.greatest(*(F.col(f"b{i}.last") for i in range(len(BASE)))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, method)), ",").alias("labels"),
        F.greatest(F.when(n_base > 0, F.lit(0.95)).otherwise(F.lit(0.0)), F.coalesce(F.col("found.best") * 0.25, F.lit(0.0))).alias("score"),
    )
