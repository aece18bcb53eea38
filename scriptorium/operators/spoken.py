"""Texts made fit for reading aloud by ordered rules, with a record of what each changed.

A rule rewrites a text or leaves it empty. The chain threads text and changes through
all rules as projections on the JVM: a step's text is computed once, compared with the
one before and handed on, and Catalyst keeps such steps apart, as both use it. What a
rule needs in a text to match at all is looked for first, by a plain search.

A null text stays null with no changes; a name is recorded once for each rule that
changed something, in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import BEGINS


@dataclass(frozen=True)
class Rule:
    """``pattern`` is replaced by ``by`` (Java's ``$n``) wherever it stands; ``whole``: the text is left empty where it matches.

    ``needs``: strings of which one stands in every text that matches, in lower case.
    ``sections``: the only sections in which the rule holds. A rule without a name is not recorded.
    """

    name: str
    pattern: str
    by: str = ""
    whole: bool = False
    needs: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()


_ITEM = r"[A-ZÀ-ÖØ-Þ][^()\[\]0-9;]{1,120}[ ,](?:19|20)[0-9]{2}[a-z]?"
#: Words that typesetting is known to have broken, or to have run together.
BROKEN = ("organiza-tional", "con-cern", "vari-able", "concep-tual", "devel-oping", "empir-ical", "char-acterize", "gover-nance", "ten-sions", "utiliz-ing", "ele-ments", "sup-porting", "estab-lished", "mod-eling")
FUSED = {"retrievalaugmented": "retrieval-augmented", "human-inthe-loop": "human-in-the-loop", "domainspecific": "domain-specific", "crosssection": "cross-section"}
#: How notices begin, and labels of structured abstracts.
NOTICES = ("Open Access This article is licensed under", "This article is licensed under", "This work is licensed under", "This article is provided under", "Permission to make digital or hard copies", "Published under the following licence:", "Published under the following license:", "This material is protected by copyright")
FRONT_MATTER = ("This article is part of a Special issue", "This is an open access article under", "Published by Elsevier", "Manuscript received", "Corresponding author.")
LABELS = ("Purpose", "Background", "Objective", "Objectives", "Aim", "Aims", "Methods", "Methodology", "Findings", "Results", "Conclusion", "Conclusions", "Practical implications", "Social implications")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}

RULES = (
    *(Rule("decode-html-entities", e, c, needs=(e,)) for e, c in ENTITIES.items()),
    Rule("omit-license-notice", rf"(?is)\A\s*(?:{'|'.join(NOTICES)}).*", whole=True),
    Rule("omit-publisher-front-matter", rf"(?is)\A(?:☆\s*)?(?:{'|'.join(FRONT_MATTER)}).*".replace("author.", r"author\."), whole=True),
    Rule("omit-keyword-list", r"(?is)\A(?:key ?words|index terms)\b.*", whole=True, needs=("word", "index")),
    Rule("omit-publisher-footer", r"(?s)\. +(?:CCS Concepts|Permission to make digital or hard copies|Open Access This article is licensed)\b.*", ".", needs=("ccs", "permission", "open access"), sections=("abstract", "summary", "conclusion", "conclusions")),
    Rule("repair-typesetting-split", "(?i)\\b(" + "|".join(w.split("-")[0] for w in BROKEN) + ")-\\s*(" + "|".join(w.split("-")[1] for w in BROKEN) + ")\\b", "$1$2", needs=("-",)),
    Rule("omit-author-year-citation", rf" ?\((?:e\.g\.,? )?{_ITEM}(?:; ?{_ITEM})*\)", needs=("(",)),
    Rule("omit-author-year-citation", rf" ?\[{_ITEM}(?:; ?{_ITEM})*\]", needs=("[",)),
    Rule("omit-arxiv-page-stamp", r"arXiv:[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)? *\[[^\]\n]+\] *[0-9]{1,2} +[A-Za-z]+ +[0-9]{4}", needs=("arxiv:",)),
    Rule("omit-publisher-front-matter", r"(?i)© *[0-9]{4} +Copyright[^\n]{0,500}?CC *BY *[0-9](?:\.[0-9])? *\)?[.?!]?", " ", needs=("©",)),
    Rule("omit-orcid-identifier", r"(?i)/?orcid(?:[0-9]{4}-){3}[0-9]{3,4}", " ", needs=("orcid",)),
    *(Rule("repair-fused-word", rf"\b{f}\b", t, needs=(a,)) for a, b in FUSED.items() for f, t in ((a, b), (a.capitalize(), b.capitalize()))),
    Rule("punctuate-structured-abstract-label", rf"(\A|[.!?] )({'|'.join(LABELS)}) ([{BEGINS}])", "$1$2. $3", sections=("abstract", "summary")),
    Rule("separate-greek-symbol", "([a-z]{2})([α-ωΑ-Ω])", "$1 $2"),
    Rule("omit-grouped-email-addresses", r"\{[^{}\n]{1,200}\} *@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}[.,;:]?", " ", needs=("@",)),
    Rule("omit-numeric-citation-marker", r" ?\[[0-9]{1,3}(?: *[,;–-] *[0-9]{1,3})*\]", needs=("[",)),
    Rule("replace-email-address", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.[A-Za-z]{2,}", "the email address", needs=("@",)),
    Rule("", r"(?i)(https?://)\s+", "$1", needs=("://",)),
    Rule("replace-web-link", r"(?i)\b(?:https?://|www\.)[^\s]*[^\s.,;:!?)\]}]", "the linked source", needs=("://", "www.")),
    Rule("", r"\(\s*\)", needs=("(",)),
    Rule("", r",\s*([.;:!?])", "$1", needs=(",",)),
    Rule("", r"\s+([,.;:!?])", "$1"),
    Rule("", r"\s{2,}", " "),
    Rule("", r"\A\s+|\s+\z"),
)


def _applied(rule: Rule, text: Column, section: Column) -> Column:
    here = F.lit(True)
    if rule.needs:
        low = F.lower(text)
        here = low.contains(rule.needs[0])
        for word in rule.needs[1:]:
            here = here | low.contains(word)
    if rule.sections:
        here = here & section.isin(*rule.sections)
    new = F.when(text.rlike(rule.pattern), F.lit("")).otherwise(text) if rule.whole else F.regexp_replace(text, rule.pattern, rule.by)
    return F.when(here, new).otherwise(text)


def spoken(df: DataFrame, text: str, section: Column | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with ``spoken``, the column ``text`` after all rules in order, and ``changes``, the names of those that changed it. Columns of these names are replaced."""
    name = F.rtrim(F.lower(F.coalesce(section, F.lit(""))), F.lit(".: ")) if section is not None else F.lit("")
    kept = [c for c in df.columns if c not in ("spoken", "changes")]
    out = df.select(*kept, F.col(text).alias("_text"), F.array().cast("array<string>").alias("_changes"), name.alias("_section"))
    for rule in rules:
        out = out.withColumn("_new", _applied(rule, F.col("_text"), F.col("_section")))
        add = F.when(F.col("_new").eqNullSafe(F.col("_text")) | F.array_contains("_changes", rule.name), F.col("_changes")).otherwise(F.array_append("_changes", F.lit(rule.name)))
        out = out.select(*kept, F.col("_new").alias("_text"), (add if rule.name else F.col("_changes")).alias("_changes"), "_section")
    return out.select(*kept, F.col("_text").alias("spoken"), F.col("_changes").alias("changes"))
