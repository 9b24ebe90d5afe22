"""Expressions that enrich chunks of text: confidence, types, grades, tags, scopes, classification, row repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import scalars as S, vocabulary as V


def confidence(content: Column, tokens: Column) -> Column:
    """Half for length, a fifth for a full ending, three tenths for up to three clinical signals."""
    length = F.when(tokens < 20, 0.1).when(tokens < 50, 0.5).when(tokens < 400, 1.0).otherwise(0.8)
    ends = F.when(F.rtrim(content).rlike("[.!?):]$"), 1.0).otherwise(0.7)
    signals = reduce(lambda a, b: a + b, [F.contains(F.lower(content), F.lit(s)).cast("int") for s in V.SIGNALS])
    return length * 0.5 + ends * 0.2 + F.least(F.lit(1.0), signals / 3) * 0.3


def chunk_type(content: Column, heading: Column) -> Column:
    return S.first_match(F.lower(F.concat(content, F.lit(" "), heading)), V.CHUNK_TYPES, "background")


def recommendation(content: Column) -> Column:
    """struct(id, text, grade) by four patterns; the first two decide alone."""
    numbered, lettered, plain = V.RECOMMENDATION_NUMBERED, V.RECOMMENDATION_LETTERED, V.RECOMMENDATION_PLAIN
    t = F.trim(content)
    pick = lambda c, p: F.struct(F.regexp_extract(c, p, 1).alias("id"), F.trim(F.regexp_extract(c, p, 2)).alias("text"), F.lower(F.regexp_extract(c, p, 3)).alias("grade"))
    bracket = F.nullif(F.lower(F.regexp_extract(content, V.RECOMMENDATION_BRACKET, 1)), F.lit(""))
    rest = F.struct(
        F.nullif(F.regexp_extract(content, plain, 1), F.lit("")).alias("id"), F.nullif(F.substring(F.trim(F.regexp_extract(content, plain, 2)), 1, 500), F.lit("")).alias("text"), bracket.alias("grade")
    )
    return F.when(content.rlike(numbered), pick(content, numbered)).when(t.rlike(lettered), pick(t, lettered)).otherwise(rest)


def grade(symbol: Column) -> Column:
    """struct(strength, quality, direction) of a grade symbol."""
    s = F.lower(F.trim(symbol))
    part = lambda k: S.mapped(s, {g: v[k] for g, v in V.GRADES.items() if v[k] is not None})
    return F.struct(part(0).alias("strength"), part(1).alias("quality"), part(2).alias("direction"))


def has_dosage(content: Column) -> Column:
    needles = [S.needle(p) for p in V.DOSAGE]
    seen = S.let(F.lower(content), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) if n else F.lit(True) for n in needles]))
    return seen & content.rlike("(?i)(" + "|".join(V.DOSAGE) + ")")


def drug_tags(content: Column) -> Column:
    return F.filter(F.array(*map(F.lit, V.DRUG_FRAGMENTS)), lambda d: F.contains(F.lower(content), d))


def strength(content: Column) -> Column:
    return S.first_match(F.lower(content), V.STRENGTHS)


def evidence(content: Column) -> Column:
    """First marker wins, so 'very low certainty' counts as low, as its shorter form is listed before it."""
    return S.first_match(F.lower(content), V.EVIDENCE)


def segment_type(content: Column, at_recommendation: Column) -> Column:
    def of(t):
        has = lambda *words: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
        signals = reduce(lambda a, b: a + b, [S.found(content, t, p).cast("int") for p in V.REASONS])
        return (
            F.when(at_recommendation & content.rlike(V.RECOMMENDATION), "recommendation")
            .when(has("dose", "dosage", "dosing", "mg/kg", "per kg") & content.rlike(V.DOSES), "drug_dosing")
            .when(has("monitor", "surveillance", "follow-up", "follow up"), "monitoring")
            .when(has("defined as", "criterion", "criteria", "classified as"), "definition_criteria")
            .when(signals >= 2, "rationale")
            .otherwise("background")
        )

    return S.let(F.lower(content), of)


def population_tags(content: Column) -> Column:
    return S.tags(content, V.POPULATIONS)


def intervention_tags(content: Column) -> Column:
    return S.tags(content, V.INTERVENTIONS)


def evidence_tier(content: Column, kind: Column) -> Column:
    found = S.first_match(F.lower(content), V.TIERS, None)
    return F.coalesce(found.cast("int"), F.when(kind.isin("practice_point", "background"), 3))


def scope(title: Column, abstract: Column) -> Column:
    return S.first_match(F.lower(F.concat(title, F.lit(" "), abstract)), V.PLACES, "global")


def issuing_body(name: Column) -> Column:
    return F.coalesce(S.first_match(F.lower(F.trim(name)), V.BODIES), name)


def document_class(publication_types: Column, article_type: Column, title: Column) -> Column:
    """struct(type, tier): the first known publication type, else markers of the article type, else of the title."""
    known = F.filter(F.transform(publication_types, lambda p: S.mapped(F.lower(p), V.PUBLICATION_TYPES)), lambda x: x.isNotNull())
    first = F.get(known, F.lit(0))
    kind = F.coalesce(F.when(first == "", "exclude").otherwise(first), S.first_match(F.lower(article_type), V.ARTICLE_MARKERS), S.first_match(F.lower(title), V.TITLE_MARKERS, "research_article"))
    return F.struct(kind.alias("type"), F.coalesce(S.mapped(kind, {k: str(v) for k, v in V.TYPE_TIERS.items()}).cast("int"), F.lit(5)).alias("tier"))


def authority_rank(body: Column, kind: Column) -> Column:
    """1 to 4 by the issuing body; guidelines of other bodies rank third."""
    name = F.lower(body)
    listed = S.first_match(name, V.RANKS, None).cast("int")
    third = (kind == "clinical_practice_guideline") | F.exists(F.array(*map(F.lit, V.THIRD_RANK)), lambda t: F.contains(name, t))
    return F.coalesce(listed, F.when(third, 3).otherwise(4))


def is_clinical(keywords: Column, title: Column) -> Column:
    """Not animals or cells alone, and not veterinary alone."""
    words, head = F.lower(F.array_join(keywords, " ")), F.lower(title)
    any_in = lambda names, *texts: F.exists(F.array(*map(F.lit, names)), lambda n: reduce(lambda a, b: a | b, [F.contains(t, n) for t in texts]))
    basic = any_in(V.NON_CLINICAL, words) & ~any_in(V.CLINICAL, words, head)
    veterinary = F.contains(head, F.lit("veterinar")) & ~any_in(["human", "patient", "women", "men", "children", "adult"], head)
    return ~(basic | veterinary)


def skipped_section(title: Column) -> Column:
    return F.exists(F.array(*map(F.lit, V.SKIPPED_SECTIONS)), lambda s: F.contains(F.lower(title), s))


def has_page_text(text: Column, least: int = 100) -> Column:
    return F.length(F.regexp_replace(text, "\\s", "")) >= least


def context_header(title: Column, path: Column, body: Column) -> Column:
    return F.concat(F.lit("From "), title, F.lit(", section "), F.array_join(path, " > "), F.lit(".\n\n"), body)


def grounded(suggestion: Column, answer: Column) -> Column:
    """A question of five words or more, whose drug framing suits the answer and whose capitalised words are in it."""
    s = F.trim(suggestion)
    complete = s.endswith("?") & (S.word_count(s) >= 5)
    nutrition = reduce(lambda a, b: a | b, [F.contains(F.lower(s), F.lit(n)) for n in V.NUTRITION])
    framed = ~s.rlike(V.DRUG_QUESTION) | (~nutrition & answer.rlike(V.DRUG_MARKERS))
    names = F.filter(F.regexp_extract_all(s, F.lit("\\b([A-Za-z]{5,})\\b"), F.lit(1)), lambda w: w.rlike("^[A-Z]") & ~F.lower(w).isin(V.SUGGESTION_STOP))
    return complete & framed & F.forall(names, lambda w: F.contains(F.lower(answer), F.lower(w)))


def repaired_json(c: Column) -> Column:
    """Model output without its code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), "^```(?:json)?\\s*", ""), "\\s*```$", ""))


def ocr_quality(method: Column) -> Column:
    """Of a document's pages, an aggregate over their methods: three counts, and no list of pages."""
    n = F.count(F.lit(1))
    clean = F.count_if(F.contains(method, F.lit("pymupdf"))) / n
    low = F.count_if(F.contains(method, F.lit("low")) | (method == "failed")) / n
    return F.when(clean >= 0.9, "clean").when(low >= 0.3, "ocr_low").when(clean >= 0.5, "mixed").otherwise("ocr_good")


def metadata_gate(confidence_: Column, *required: Column, least: float = 0.7) -> Column:
    """struct(confidence, status): clamped to 0..1, capped at 0.6 where a required field is missing; below least goes to review."""
    missing = reduce(lambda a, b: a | b, [c.isNull() | (c.cast("string") == "") for c in required])
    clamped = S.clamp(confidence_, 0.0, 1.0)
    return F.struct(F.when(missing, F.least(clamped, F.lit(0.6))).otherwise(clamped).alias("confidence"), F.when(confidence_ >= least, "metadata_extracted").otherwise("metadata_review").alias("status"))


def sanitized(columns: dict[str, Column]) -> dict[str, Column]:
    """Row repair: unknown names to defaults, numbers into their ranges or to null, dates to full dates, empty grades to null."""
    c = columns
    listed = lambda col, valid, names, default: F.when(col.isin(valid), col).otherwise(S.mapped(F.lower(F.trim(col)), names, F.lit(default)))
    or_default = lambda col, default: F.coalesce(F.nullif(col, F.lit("")), F.lit(default))
    kind = or_default(c["chunk_type"], "background")
    kind = F.when(kind.isin(V.VALID_CHUNK_TYPES), kind).when(kind == "recommendation_statement", "recommendation").otherwise("background")
    doc = or_default(c["document_type"], "guideline")
    year, strong = S.guarded_int(c["pub_year"]), S.mapped(F.lower(c["grade_strength"]), V.ROW_STRENGTHS)
    date = F.trim(c["date_published"])
    framework = F.nullif(c["evidence_framework"], F.lit(""))
    return {
        "chunk_type": kind,
        "document_type": F.when(doc.isin(V.DOCUMENT_TYPES), doc).otherwise("guideline"),
        "domain": listed(or_default(c["domain"], "general_medicine"), V.DOMAINS, V.DOMAIN_NAMES, "general_medicine"),
        "evidence_framework": F.when(framework.isNull(), c["evidence_framework"]).otherwise(listed(framework, V.FRAMEWORKS, V.FRAMEWORK_NAMES, "other")),
        "geographic_scope": listed(or_default(c["geographic_scope"], "global"), V.SCOPES, V.SCOPE_NAMES, "global"),
        "evidence_tier": S.clamp(S.guarded_int(c["evidence_tier"]), 1, 3),
        "section_depth": S.clamp(S.guarded_int(c["section_depth"]), 1, 6),
        "pub_year": F.when(year.between(1900, 2100), year),
        "date_published": F.when(date.rlike("^\\d{4}$"), F.concat(date, F.lit("-01-01"))).when(date.rlike("^\\d{4}-\\d{2}-\\d{2}$"), date),
        "grade_strength": strong,
        "grade_symbol": F.when(strong.isNotNull(), F.nullif(c["grade_symbol"], F.lit(""))),
        "content_tokens": F.when(c["content_tokens"] >= 1, c["content_tokens"]).otherwise(F.greatest(F.lit(1), S.word_count(c["content"]))),
    }
