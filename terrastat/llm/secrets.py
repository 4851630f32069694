"""Secret spans by rules: a trigram index proposes (document, rule) pairs, the rules' expressions confirm them.

Everything on the way from texts to spans is column expressions, joins and aggregates.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``group`` of a match must have ``least`` characters, else the match is passed over."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Fixed values. Base rules first, in the order in which equal starts are listed. Runs of one character class that must
#: have a least length carry it in the pattern: the run is maximal either way.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
MOST_ALTERNATIVES = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of which one must hold, each a set of lower-case trigrams that all occur in a matching text.

    ``None`` if some match needs no trigram: such a rule reads every text.
    """
    parser = re._parser

    def walk(parts, found: list[tuple[tuple[str, ...], str]]) -> list[tuple[tuple[str, ...], str]]:
        """Each state is (finished literal runs, run in progress)."""
        closed = lambda states: [((*done, run), "") for done, run in states]
        for op, value in parts:
            name = str(op)
            if name == "LITERAL":
                found = [(done, run + chr(value).lower()) for done, run in found]
            elif name == "SUBPATTERN":
                found = walk(value[3], found)
            elif name == "BRANCH":
                found = [s for branch in value[1] for s in walk(branch, found)]
            elif name == "MAX_REPEAT" and value[0] == 0 and value[1] == 1:
                found = found + walk(value[2], found)
            elif name == "MAX_REPEAT" and value[0] >= 1:
                for _ in range(min(value[0], 8)):
                    found = walk(value[2], found)
                found = found if value[0] == value[1] <= 8 else closed(found)
            else:
                found = closed(found)
            if len(found) > MOST_ALTERNATIVES:
                found = [((), "")]
        return found

    sets = set()
    for done, run in walk(parser.parse(pattern), [((), "")]):
        sets.add(frozenset(r[i : i + 3] for r in (*done, run) for i in range(len(r) - 2)))
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id, rules``: a bit per rule whose trigram query the postings of the document answer."""
    spark = docs.sparkSession
    wanted = [(k, a, t, len(s)) for k, r in enumerate(rules) for a, s in enumerate(trigram_query(r.pattern) or ()) for t in sorted(s)]
    grams = sorted({t for _, _, t, _ in wanted})
    held = F.filter(F.array(*map(F.lit, grams)), lambda t: F.contains(F.col("low"), t))
    postings = docs.where("doc_id is not null").select("doc_id", F.lower("text").alias("low")).select(F.explode(held).alias("gram"), "doc_id").distinct()
    asked = F.broadcast(spark.createDataFrame(wanted, "rule int, alternative int, gram string, need int"))
    met = postings.join(asked, "gram").groupBy("doc_id", "rule", "alternative").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return met.where("n = need").groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def rule_spans(text: Column, order: int, rule: Rule) -> Column:
    """Spans of one rule: the lengths of matches and of the gaps between them, summed up in code points."""
    whole, value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    sizes = F.arrays_zip(F.transform(whole, F.length).alias("m"), F.transform(gaps, F.length).alias("g"), F.transform(value, F.length).alias("v"))
    sizes = F.filter(sizes, lambda s: s["m"].isNotNull())
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,rank:int,stop:int,kind:string>>)").alias("out"))

    def add(seen: Column, s: Column) -> Column:
        start = seen["at"] + s["g"]
        one = F.struct(start.alias("start"), F.lit(order).alias("rank"), (start + s["m"]).alias("stop"), F.lit(rule.kind).alias("kind"))
        return F.struct((start + s["m"]).alias("at"), F.when(s["v"] >= rule.least, F.concat(seen["out"], F.array(one))).otherwise(seen["out"]).alias("out"))

    return F.aggregate(sizes, empty, add)["out"]


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores as it takes to clash with no column."""
    while name in columns:
        name += "_"
    return name


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """``docs`` with ``into``, an array of (start, rank, stop, kind) in code points by start and rule.

    Matches of one rule are leftmost and do not overlap; those of different rules may. A rule without mandatory trigrams
    reads every text, any other rule only the texts that the index proposes. A missing text counts as empty; rows without
    ``doc_id`` cannot be looked up in the index and are read by every rule; rows that repeat a ``doc_id`` are read by what
    the index proposes for any of them. Other columns stay, whatever they are called, but one named ``into`` is replaced.
    """
    bits = unused("rules", docs.columns)
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    proposed = candidates(plain, rules).withColumnRenamed("rules", bits)
    rows = docs.join(proposed, "doc_id", "left").select(*docs.columns, bits)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,stop:int,kind:string>>)")
    found = []
    for k, rule in enumerate(rules):
        spans = rule_spans(text, k, rule)
        if trigram_query(rule.pattern) is not None:
            asked = F.col("doc_id").isNull() | (F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(1 << k) != 0)
        else:
            # a text without a match needs no further work on its gaps
            asked = text.rlike(rule.pattern)
        found.append(F.when(asked, spans).otherwise(none))
    return rows.withColumn(into, F.array_sort(F.concat(*found))).drop(bits)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, digest of the base spans and all spans per row of ``docs (doc_id, text)``."""
    rows = secret_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules)
    base = [k for k, r in enumerate(rules) if r.base]
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    of_base = F.filter("secrets", lambda s: s["rank"].isin(base))
    return rows.select("doc_id", *[count(r.kind) for r in rules if r.base], F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; spans that touch or overlap become one."""
    spans = unused("secrets", docs.columns)
    rows = secret_spans(docs, rules, spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(seen: Column, s: Column) -> Column:
        inside = s["start"] < seen["at"]
        kept = F.concat(seen["out"], text.substr(seen["at"] + 1, s["start"] - seen["at"]), F.lit(mark))
        return F.struct(F.greatest(seen["at"], s["stop"]).alias("at"), F.when(inside, seen["out"]).otherwise(kept).alias("out"))

    done = F.aggregate(spans, start, step)
    new = F.concat(done["out"], text.substr(done["at"] + 1, F.length(text) - done["at"]))
    return rows.withColumn("text", F.when((F.size(spans) > 0) & text.isNotNull(), new).otherwise(text)).select(*docs.columns)
