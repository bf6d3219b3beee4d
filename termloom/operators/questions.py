"""Questions: other wordings, topics, and the tools that an intent needs. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: questions of up to so many characters are short.
SHORT = 18


def variants(text: Column, templates: list[str], polite: list[str]) -> Column:
    """The cleaned text, then for short ones each template, for others the text without polite words if that differs."""
    base = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " "), r"\s+", " "))
    filled = [F.concat(F.lit(t.split("{}")[0]), base, F.lit(t.split("{}")[1])) for t in templates]
    bare = F.trim(F.regexp_replace(F.regexp_replace(base, r"\b(" + "|".join(polite) + r")\b", " "), r"\s+", " "))
    return F.array_distinct(F.when(F.length(base) <= SHORT, F.array(base, *filled)).when((bare != "") & (bare != base), F.array(base, bare)).otherwise(F.array(base)))


def topics(text: Column, table: list[tuple[str, list[str], str]], unless: dict[str, list[str]]) -> Column:
    """Additions of the topics of which a word stands in the text, in the table's order; a topic gives way to those in ``unless``."""
    hit = {name: F.coalesce(F.expr("false") if not words else _any([F.contains(text, F.lit(w)) for w in words]), F.lit(False)) for name, words, _ in table}
    kept = [F.when(hit[name] & ~_any([hit[other] for other in unless.get(name, [])]), F.lit(added)) for name, _, added in table]
    return F.array_distinct(F.filter(F.array(*kept), lambda x: x.isNotNull()))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def tool_plan(rows: DataFrame, intent: str, slots: str, needed: dict[str, list[str]], tools: dict[str, list[list[str]]]) -> DataFrame:
    """Adds missing (needed slots that are not there), stages (tools, those of a stage joined by +) and action."""
    words = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>") if xs else F.array().cast("array<string>")
    need = F.create_map(*(x for k, v in needed.items() for x in (F.lit(k), words(v))))
    plan = F.create_map(*(F.lit(x) for k, v in tools.items() for x in (k, " > ".join("+".join(stage) for stage in v))))
    out = rows.withColumn("missing", F.array_except(F.coalesce(need[F.col(intent)], F.array().cast("array<string>")), F.col(slots)))
    return out.withColumn("stages", plan[F.col(intent)]).withColumn("action", F.when(F.size("missing") > 0, "clarify").otherwise("run"))
