"""Text expressions: markup cleaning, quality predicates, splitting, counting, parsing of model replies."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import lexicon as L


def _sub(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, F.lit(s[0]), F.lit(s[1])), steps, text)


def _swap(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def strip(text: Column) -> Column:
    """White space off both ends, of any kind."""
    return _sub(text, (r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$", ""))


def words(text: Column) -> Column:
    """Words between white space; none for a blank or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def contains_any(text: Column, terms: Iterable[str], word_boundary: bool = False) -> Column:
    """Whether a lower-case text holds one of the terms: as a substring (byte searches, up to the first that is found), or between word
    boundaries (one alternation). A term that holds another one is left out."""
    lower = sorted({t.lower() for t in terms}, key=lambda t: (len(t), t))
    if word_boundary:
        return text.rlike(r"\b(?:" + "|".join("\\Q" + t + "\\E" for t in lower) + r")\b")
    least = [t for i, t in enumerate(lower) if not any(s in t for s in lower[:i])]
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in least], F.lit(False))


def count_terms(text: Column, terms: Iterable[str]) -> Column:
    """How many of the terms stand in the text."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms])


def count_patterns(text: Column, patterns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in patterns])


# ---- identifiers, links, dates


def normalise_id(paper_id: Column) -> Column:
    """Without a leading `arXiv:` in any case."""
    return F.regexp_replace(paper_id, "(?i)^arxiv:", "")


def strip_version(paper_id: Column) -> Column:
    return F.regexp_replace(paper_id, r"v\d+$", "")


def safe_name(paper_id: Column) -> Column:
    return F.translate(paper_id, "/:", "__")


def links(paper_id: Column) -> Column:
    base = "https://arxiv.org"
    return F.struct(F.concat(F.lit(f"{base}/abs/"), paper_id).alias("abs_url"), F.concat(F.lit(f"{base}/pdf/"), paper_id, F.lit(".pdf")).alias("pdf_url"), F.concat(F.lit(f"{base}/e-print/"), paper_id).alias("latex_url"))


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def shorten(text: Column, most: int, mark: str = "...") -> Column:
    """At most `most` characters, and a mark after a cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


# ---- markup


def clean_markup(text: Column) -> Column:
    """Running text of LaTeX: commands go, with or without what they hold; quotes, dashes and white space are made even."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(F.contains(t, F.lit("\\")), _sub(t, *L.COMMANDS)).otherwise(t)  # all of them ask for a backslash
    return strip(_sub(_swap(t, L.SPECIAL_CHARS), *L.SIGNS))


def clean_section_title(title: Column) -> Column:
    return strip(_sub(clean_markup(title), *L.HEADING_MARKS))


def clean_paper_title(title: Column) -> Column:
    t = _sub(clean_markup(_sub(F.coalesce(title, F.lit("")), *L.TITLE_COMMENT)), *L.TITLE_ENDS)
    return strip(_swap(t, (("\\", ""), ("  ", " "))))


def clean_equation(latex: Column) -> Column:
    return strip(_sub(F.coalesce(latex, F.lit("")), *L.EQUATION_MARKS))


def plain_content(latex: Column) -> Column:
    """Text alone: environments and commands with their arguments go."""
    t = _sub(F.coalesce(latex, F.lit("")), (r"(?s)\\begin\{[^}]*\}.*?\\end\{[^}]*\}", ""), (r"\\[a-zA-Z]+\*?(\[[^\]]*\])?(\{[^}]*\})?", ""))
    return strip(_swap(clean_markup(t), (("\\", ""), ("{", ""), ("}", ""))))


def clean_caption(caption: Column) -> Column:
    return strip(_sub(clean_markup(caption), (r"(?i)^(?:Figure|Fig\.?)\s*\d+[.:]\s*", "")))


def clean_query(text: Column) -> Column:
    """One line without quotes around it, as from an expansion model."""
    return strip(_sub(strip(text), (r"(?i)^(?:abstract|passage|answer|hypothetical abstract)\s*:\s*", ""), (r"^[\"']+|[\"']+$", "")))


def fix_common_issues(text: Column) -> Column:
    t = _swap(text, (("�", ""), ("\x00", "")))
    return strip(_sub(t, (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"(?U)(?<!\w)[^\w\s]{5,}(?!\w)", " ")))


# ---- predicates


def alnum_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))


def is_valid_text(text: Column, min_words: int = 10) -> Column:
    t = F.coalesce(text, F.lit(""))
    bad = F.contains(t, F.lit("�")) | F.contains(t, F.lit("\x00"))
    return (word_count(t) >= min_words) & ~bad & (alnum_count(t) / F.greatest(F.length(t), F.lit(1)) >= 0.3)


def is_noisy_markup(text: Column, threshold: float = 0.3) -> Column:
    t = F.coalesce(text, F.lit(""))
    tokens = F.regexp_count(t, F.lit(r"\S+"))
    return (tokens > 0) & (F.regexp_count(t, F.lit(r"\\[a-zA-Z]+")) / F.greatest(tokens, F.lit(1)) > threshold)


def is_math_heavy(text: Column, threshold: float = 0.3) -> Column:
    """An empty text is not; a text of white space alone is."""
    t = F.coalesce(text, F.lit(""))
    marks = F.regexp_count(t, F.lit(r"\$|\\\(|\\\)|\\\[|\\\]|\\begin\{"))
    n = word_count(t)
    return F.when(t == "", False).when(n == 0, True).otherwise(marks / F.greatest(n, F.lit(1)) > threshold)


def _title_key(title: Column) -> Column:
    return _sub(F.lower(strip(F.coalesce(title, F.lit("")))), (r"^[\d.]+\s*", ""), (r"\s+", " "))


def is_excluded_section(title: Column) -> Column:
    return _title_key(title).rlike("(?i)^(?:" + "|".join(L.EXCLUDED_SECTIONS) + ")$")


def section_importance(title: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in L.SECTION_IMPORTANCE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _title_key(title)), F.lit(L.DEFAULT_IMPORTANCE))


def quality_issues(text: Column, location: Column) -> Column:
    """Array of (issue_type, severity, location): encoding errors, low share of letters and digits, runs of signs,
    commands left over."""
    t = F.coalesce(text, F.lit(""))
    n = word_count(t)

    def issue(when: Column, kind: str, severity: str) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), location.alias("location")))

    found = F.array(
        issue(F.contains(t, F.lit("�")), "encoding", "error"),
        issue(F.contains(t, F.lit("\x00")), "encoding", "error"),
        issue((F.length(t) >= 50) & (alnum_count(t) / F.length(t) < 0.5), "content_ratio", "warning"),
        issue(t.rlike(r"(?U)[^\w\s]{10,}"), "special_chars", "warning"),
        issue((n > 0) & (F.regexp_count(t, F.lit(r"\\[a-zA-Z]+")) / F.greatest(n, F.lit(1)) > 0.05), "unconverted_latex", "warning"),
    )
    return F.array_compact(found)


# ---- splitting


def sentences(text: Column) -> Column:
    """Split after . ! or ? before white space; blank parts go."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def paragraphs(text: Column, separator: str = r"\n\s*\n|\\par\b") -> Column:
    """(paragraph, order) with order from 1 over all raw parts; parts under 20 characters after cleaning go."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda p, i: F.struct(clean_markup(p).alias("content"), (i + 1).alias("order")))
    return F.filter(parts, lambda p: F.length(p["content"]) >= 20)


# ---- replies of models


def strip_fences(reply: Column) -> Column:
    return strip(_sub(strip(F.coalesce(reply, F.lit(""))), (r"^```(?:json)?\s*", ""), (r"\s*```$", "")))


def parse_enrichment(reply: Column, kinds: Iterable[str] = ("method", "dataset", "analysis", "survey", "application", "theory", "other")) -> Column:
    """keywords (at most five; a comma-separated string is split), summary and contribution_type (null unless one of `kinds`)
    of a JSON reply; null if it isn't JSON."""
    body = F.from_json(strip_fences(reply), "struct<keywords:string,summary:string,contribution_type:string>")
    listed = F.from_json(body["keywords"], "array<string>")
    keywords = F.slice(F.coalesce(listed, F.transform(F.split(body["keywords"], ","), strip)), 1, 5)
    return F.when(body.isNotNull(), F.struct(keywords.alias("keywords"), body["summary"].alias("summary"), F.when(body["contribution_type"].isin(*kinds), body["contribution_type"]).alias("contribution_type")))


def parse_generated_queries(reply: Column, styles: Iterable[str] = ("keyword", "natural_short", "natural_long", "conceptual")) -> Column:
    """(query, style) of a JSON reply; queries of 5 to 300 characters in a known style stay."""
    found = F.from_json(strip_fences(reply), "array<struct<query:string,style:string>>")
    return F.filter(F.coalesce(found, F.array()), lambda q: F.length(q["query"]).between(5, 300) & q["style"].isin(*styles))


def parse_relevance(reply: Column) -> Column:
    """relevant (the decision starts with yes) and reason of a reply with DECISION: and REASON: lines."""
    decision = F.lower(strip(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?mi)^\s*DECISION:\s*(.*)$", 1)))
    reason = strip(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?mi)^\s*REASON:\s*(.*)$", 1))
    return F.struct(decision.startswith("yes").alias("relevant"), reason.alias("reason"))


def image_kind(data: Column) -> Column:
    """File extension by leading bytes; null if unknown."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "webp").when(head.startswith("25504446"), "pdf")
    )


def looks_like_pdf(data: Column) -> Column:
    return F.hex(F.substring(data, 1, 4)) == "25504446"


def full_text(abstract: Column, sections: Column) -> Column:
    """Abstract, then each section's title and paragraphs, with blank lines between."""
    parts = F.transform(sections, lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n\n"), F.array_join(F.transform(s["paragraphs"], lambda p: p["content"]), "\n\n")))
    return F.array_join(F.concat(F.array(abstract), parts), "\n\n")
