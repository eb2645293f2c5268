"""Rule-based classification: level, discipline, term, skills.

Inputs are canonical text columns (`functions.text.canonical_text`), computed
once.  Phrase rules are tested on word-marked text, so a rule is one substring
test and a whole family is one array filter: the expression stays small however
many phrases there are, and nothing leaves the JVM or shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantic.functions.let import let
from vacantic.functions.text import WORD_MARK, canonical_text, html_to_text, mark_words, marked_phrase, truncate_summary
from vacantic.rules import (EARLY_TITLE, LEAD_TITLE, SENIOR_TITLE, SOURCE_LEVEL_HINTS, RuleSet, literal)


PHRASES = "array<struct<h:string,p:string>>"


def _head(phrase: str) -> str:
    words = re.findall(r"\w+", phrase.lower())
    return words[0] if words else ""


def _marked(phrases: list[str], extra: str = "") -> list[dict]:
    """Marked phrases, each with its first word."""
    return [{"h": _head(p), "p": marked_phrase(p.lower(), extra)} for p in phrases if p]


def _all_phrases(r: RuleSet) -> list[str]:
    return [p for _, ps in r.career_levels for p in ps] + [p for _, label, al in r.disciplines for p in [label, *al]] \
        + [p for name, al in r.skills for p in [name, *al]]


def rule_words(text: Column, rules: RuleSet | None = None, marked: Column | None = None) -> Column:
    """The few words of a text that start a rule phrase: one hashed intersection instead of one search per phrase.

    The word-marked text, where there is one, is cut at its marks, which needs no pattern; what lies between words starts no phrase.
    """
    heads = sorted({_head(p) for p in _all_phrases(rules or RuleSet()) if p})
    words = F.split(text, r"[^\p{L}\p{N}_]+") if marked is None else F.split(marked, WORD_MARK)
    # a list of plain values is hashed once, an array of them in every row
    return F.array_distinct(F.filter(words, lambda w: w.isin(heads)))


def _found(marked: Column, words: Column, phrase: Column) -> Column:
    return ((phrase["h"] == "") | F.array_contains(words, phrase["h"])) & F.contains(marked, phrase["p"])


def _hits(marked: Column, phrases: Column) -> Column:
    """How many of the phrases (an array column) occur in short word-marked text."""
    return F.size(F.filter(phrases, lambda p: F.contains(marked, p["p"])))


def _joined(*parts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *parts))


# --- level ------------------------------------------------------------------------------------
def best_level(candidates: Column) -> Column:
    """Array of struct(score, ord, level) -> the highest score, the first rule on a tie."""
    keyed = F.transform(candidates, lambda c: F.struct(c["score"], (-c["ord"]).alias("o"), c["level"]))
    return F.array_max(keyed)


def is_senior_title(title: Column, rules: RuleSet | None = None) -> Column:
    r = rules or RuleSet()
    phrase = F.exists(literal(r.senior_phrases, "array<string>"), lambda p: F.contains(title, p))
    return phrase | title.rlike(SENIOR_TITLE) | (title.rlike(LEAD_TITLE) & ~title.rlike(EARLY_TITLE))


def career_level(title: Column, corpus: Column, hints: Column | None = None,
                 rules: RuleSet | None = None, marked_title: Column | None = None,
                 marked_corpus: Column | None = None, words: Column | None = None) -> Column:
    """struct(level, confidence). A title hit is needed for a high score; source metadata helps below 0.55.

    `words`, where given, are the rule words of title and corpus.
    """
    r = rules or RuleSet()
    marks = F.struct((mark_words(title) if marked_title is None else marked_title).alias("t"),
                     (mark_words(corpus) if marked_corpus is None else marked_corpus).alias("c"),
                     (rule_words(_joined(title, corpus), r) if words is None else words).alias("w"))
    table = literal([{"ord": i, "level": level} for i, (level, _) in enumerate(r.career_levels)], "array<struct<ord:int,level:string>>")
    heads: dict[str, list[dict]] = {}
    for i, (_, phrases) in enumerate(r.career_levels):
        for p in _marked(phrases):
            heads.setdefault(p["h"], []).append({"ord": i, "p": p["p"]})
    kind = "array<struct<ord:int,p:string>>"
    wordless, by_head = literal(heads.pop("", []), kind), literal(heads, f"map<string,{kind}>")

    def hits(m: Column) -> Column:
        """Phrases that occur, of those the row's words start: most rows have none, and no phrase is tried."""
        near = F.flatten(F.transform(m["w"], lambda w: F.coalesce(F.try_element_at(by_head, w), literal([], kind))))
        tried = F.transform(F.concat(wordless, near), lambda p: F.struct(
            p["ord"].alias("ord"), F.contains(m["t"], p["p"]).alias("t"), F.contains(m["c"], p["p"]).alias("c")))
        return F.filter(tried, lambda x: x["t"] | x["c"])

    def count(found: Column, s: Column) -> Column:
        def size(test: Callable[[Column], Column]) -> Column:
            return F.size(F.filter(found, lambda x: (x["ord"] == s["ord"]) & test(x)))

        return F.struct(size(lambda x: x["t"]).alias("t"), size(lambda x: ~x["t"]).alias("b"), s["ord"].alias("ord"), s["level"].alias("level"))

    def score(h: Column) -> Column:
        body = F.least(h["b"], F.lit(2))
        strong = F.least(F.lit(0.72) + F.lit(0.1) * F.least(h["t"], F.lit(2)) + F.lit(0.05) * body, F.lit(0.95))
        weak = F.least(F.lit(0.45), F.lit(0.28) + F.lit(0.08) * body)
        return F.struct(F.when(h["t"] > 0, strong).when(h["b"] > 0, weak).otherwise(F.lit(0.0)).alias("score"),
                        h["ord"].alias("ord"), h["level"].alias("level"))

    # bound once per row: a column named inside a lambda may otherwise be evaluated per rule
    counted = let(let(marks, hits), lambda found: F.when(F.size(found) > 0, F.transform(table, lambda s: count(found, s))))
    best = best_level(F.filter(F.transform(counted, score), lambda s: s["score"] > 0))
    own = let(best, lambda w: F.struct(F.coalesce(w["level"], F.lit("unknown")).alias("level"),
                                       F.coalesce(w["score"], F.lit(0.0)).alias("confidence")))
    if hints is not None:
        text = F.coalesce(hints, F.lit(""))
        hint = F.coalesce(*[F.when(text.rlike(p), F.struct(F.lit(lv).alias("level"), F.lit(sc).alias("confidence")))
                            for p, lv, sc in SOURCE_LEVEL_HINTS])
        own = let(F.struct(own.alias("own"), hint.alias("hint")), lambda s: F.when(
            (s["own"]["confidence"] < 0.55) & (s["hint"]["confidence"] > s["own"]["confidence"]), s["hint"]).otherwise(s["own"]))
    none = F.struct(F.lit("unknown").alias("level"), F.lit(0.0).alias("confidence"))
    return F.when(is_senior_title(title, r), none).otherwise(own)


# --- discipline ---------------------------------------------------------------------------------
def rank_disciplines(scored: Column) -> Column:
    """G1: array of struct(score, id) -> struct(primary, secondary, confidence)."""
    def split(order: Column) -> Column:
        top = F.get(order, F.lit(0))
        rest = F.filter(F.slice(order, 2, 3), lambda s: -s["n"] >= 0.5)
        return F.struct(F.coalesce(top["id"], F.lit("other")).alias("primary"), F.transform(rest, lambda s: s["id"]).alias("secondary"),
                        F.coalesce(F.round(-top["n"], 3), F.lit(0.0)).alias("confidence"))

    keyed = F.transform(scored, lambda s: F.struct((-s["score"]).alias("n"), s["id"].alias("id")))
    return let(F.array_sort(keyed), split)


def discipline(title: Column, department: Column, corpus: Column, rules: RuleSet | None = None,
               marked: tuple[Column, Column, Column] | None = None, words: Column | None = None) -> Column:
    """0.4 + 0.1 per hit (3 at most) + 0.25 for a title hit + 0.15 for a department hit, 0.98 at most."""
    r = rules or RuleSet()
    mt, md, mc = marked or (mark_words(title), mark_words(department), mark_words(corpus))
    marks = F.struct(mt.alias("t"), md.alias("d"), mc.alias("c"),
                     (rule_words(corpus, r) if words is None else words).alias("w"))
    table = literal([{"id": ident, "phrases": _marked([label, *aliases])} for ident, label, aliases in r.disciplines],
                    f"array<struct<id:string,phrases:{PHRASES}>>")
    counted = let(marks, lambda m: F.transform(table, lambda s: F.struct(
        s["id"].alias("id"), F.size(F.filter(s["phrases"], lambda p: _found(m["c"], m["w"], p))).alias("h"), _hits(m["t"], s["phrases"]).alias("t"),
        _hits(m["d"], s["phrases"]).alias("d"))))
    scored = F.transform(F.filter(counted, lambda s: s["h"] > 0), lambda s: F.struct(
        F.least(F.lit(0.4) + F.lit(0.1) * F.least(s["h"], F.lit(3))
                + F.when(s["t"] > 0, 0.25).otherwise(0.0)
                + F.when(s["d"] > 0, 0.15).otherwise(0.0), F.lit(0.98)).alias("score"), s["id"].alias("id")))
    return rank_disciplines(scored)


# --- term ------------------------------------------------------------------------------------------
def earliest_match(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Label of the pattern that starts first in the text; rule order on a tie; null without a hit."""
    spots = F.array(*[F.struct(F.regexp_instr(text, F.lit(p)).alias("pos"), F.lit(i).alias("ord"),
                               F.lit(label).alias("label")) for i, (label, p) in enumerate(patterns)])
    any_hit = text.rlike("|".join(f"(?:{p})" for _, p in patterns))
    return F.when(any_hit, F.array_min(F.filter(spots, lambda s: s["pos"] > 0))["label"])


def academic_term(title: Column, canon_title: Column, summary: Column, description: Column,
                  structured: Column | None = None, rules: RuleSet | None = None) -> Column:
    """Structured terms, title, summary, bare title words, description; the first that answers."""
    r = rules or RuleSet()
    steps: list[Column] = []
    if structured is not None:
        each = F.transform(structured, lambda t: earliest_match(t, r.precise_terms))
        steps.append(F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0)))
    steps += [earliest_match(F.coalesce(title, F.lit("")), r.precise_terms),
              earliest_match(F.coalesce(summary, F.lit("")), r.precise_terms)]
    words = [(label, literal(_marked(ws), PHRASES)) for label, ws in r.title_terms]
    steps.append(let(mark_words(canon_title), lambda m: F.coalesce(
        *[F.when(_hits(m, ws) > 0, F.lit(label)) for label, ws in words], F.lit(None).cast("string"))))
    steps.append(earliest_match(F.coalesce(description, F.lit("")), r.precise_terms))
    return F.coalesce(*steps, F.lit("unknown"))


# --- skills ------------------------------------------------------------------------------------------
SKILL_CHARS = "+#"


def skills(text: Column, rules: RuleSet | None = None, marked: Column | None = None,
           words: Column | None = None) -> Column:
    """Sorted names of the skills whose name or alias occurs.

    `+` and `#` count as word characters, so C is not found inside C++ or C#.
    """
    r = rules or RuleSet()
    m = mark_words(text, SKILL_CHARS) if marked is None else marked
    table = literal([{"name": name, "phrases": _marked([name, *aliases], SKILL_CHARS)} for name, aliases in r.skills],
                    f"array<struct<name:string,phrases:{PHRASES}>>")
    both = F.struct(m.alias("m"), (rule_words(text, r) if words is None else words).alias("w"))
    found = let(both, lambda x: F.filter(table, lambda s: F.exists(s["phrases"], lambda p: _found(x["m"], x["w"], p))))
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: s["name"])))


# --- whole-table jobs -----------------------------------------------------------------------------------
def enrich_level(df: DataFrame, title: str, body: str | None = None, hints: Column | None = None,
                 rules: RuleSet | None = None) -> DataFrame:
    """J1 as a job: adds `career_level` and `career_level_confidence`."""
    base = df.select("*", canonical_text(F.col(title)).alias("_t"),
                     (canonical_text(F.col(body)) if body else F.lit("")).alias("_b"))
    base = base.select("*", mark_words(F.col("_t")).alias("_mt"),
                       mark_words(_joined(F.col("_t"), F.col("_b"))).alias("_mc"))
    corpus = _joined(F.col("_t"), F.col("_b"))
    out = base.select("*", career_level(F.col("_t"), corpus, hints, rules, F.col("_mt"), F.col("_mc")).alias("_l"))
    return out.select("*", F.col("_l.level").alias("career_level"),
                      F.col("_l.confidence").alias("career_level_confidence")).drop("_t", "_b", "_mt", "_mc", "_l")


def enrich_discipline(df: DataFrame, title: str, department: str | None = None, body: str | None = None,
                      rules: RuleSet | None = None) -> DataFrame:
    """J2 as a job: adds `disciplines`."""
    def canon(c: str | None) -> Column:
        return canonical_text(F.col(c)) if c else F.lit("")

    base = df.select("*", canon(title).alias("_t"), canon(department).alias("_d"), canon(body).alias("_b"))
    base = base.select("*", mark_words(F.col("_t")).alias("_mt"), mark_words(F.col("_d")).alias("_md"),
                       mark_words(_joined(F.col("_t"), F.col("_d"), F.col("_b"))).alias("_mc"))
    made = discipline(F.col("_t"), F.col("_d"), _joined(F.col("_t"), F.col("_d"), F.col("_b")), rules, (F.col("_mt"), F.col("_md"), F.col("_mc")))
    return base.select("*", made.alias("disciplines")).drop("_t", "_d", "_b", "_mt", "_md", "_mc")


def enrich_term(df: DataFrame, title: str, summary: str | None = None, description: str | None = None,
                structured: str | None = None, rules: RuleSet | None = None) -> DataFrame:
    """J3 as a job: adds `academic_term`."""
    none = F.lit("")
    base = df.select("*", canonical_text(F.col(title)).alias("_t"))
    made = academic_term(F.col(title), F.col("_t"), F.col(summary) if summary else none,
                         F.col(description) if description else none,
                         F.col(structured) if structured else None, rules)
    return base.select("*", made.alias("academic_term")).drop("_t")


def enrich_skills(df: DataFrame, text: str, rules: RuleSet | None = None) -> DataFrame:
    """J4 as a job: adds `skills`."""
    base = df.select("*", canonical_text(F.col(text)).alias("_c"))
    return base.select("*", skills(F.col("_c"), rules).alias("skills")).drop("_c")


def reclassify(postings: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Level, discipline and term again from title and summary; `level_changed` marks differences."""
    hints = F.concat_ws(" ", F.col("employment_type"), F.col("extra.experience_level")) \
        if "extra" in postings.columns else F.col("employment_type")
    old = postings.withColumnsRenamed({"career_level": "_old_level", "career_level_confidence": "_old_conf"}) \
        .drop("disciplines", "academic_term")
    new = enrich_term(enrich_discipline(enrich_level(old, "title", "summary", hints, rules),
                                        "title", body="summary", rules=rules),
                      "title", description="summary", rules=rules)
    changed = ~F.col("_old_level").eqNullSafe(F.col("career_level")) \
        | (F.abs(F.col("_old_conf") - F.col("career_level_confidence")) > 1e-9)
    return (new.withColumn("level_changed", F.coalesce(changed, F.lit(True)))
            .withColumn("summary", truncate_summary(html_to_text(F.col("summary"))))
            .drop("_old_level", "_old_conf"))


def reclassify_summary(postings: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """How many rows changed."""
    return reclassify(postings, rules).agg(F.count("*").alias("rows"), F.count_if("level_changed").alias("changed"))
