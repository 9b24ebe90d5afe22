"""Sections and chunks of documents. Greedy packing is a fold over an array of pieces, one document at a time, in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as S, text as X, vocabulary as V

SENTENCE_END = "(?<=[.!?])\\s+"
MARK = "\u0001"


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def windows(words: Column, size: int, step: int, least: int = 1) -> Column:
    """Fixed windows of words, each as a text; those of fewer than `least` words are left out."""

    def cut(w):
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(starts, lambda i: F.least(F.lit(size), F.size(w) - i) >= least), lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))

    return S.let(words, cut)


def cuts(sizes: Column, most: int, overlap: int = 0) -> Column:
    """array of struct(a, b): pieces a to b - 1 make a chunk of up to `most`, or one piece that is larger. A chunk begins with the
    last whole pieces of the one before that fit in `overlap`. One pass over the sizes; what is appended are two numbers a chunk."""
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), F.lit(0).alias("a"), F.lit(0).alias("n"))

    def tail(first, end):
        """(place, size) of the last pieces before end that fit in the overlap, going back from the end."""
        open_ = F.struct(F.lit(True).alias("open"), end.alias("at"), F.lit(0).alias("n"))
        back = lambda z, k: F.when(z["open"] & (z["n"] + F.get(sizes, k) <= overlap), F.struct(F.lit(True).alias("open"), k.alias("at"), (z["n"] + F.get(sizes, k)).alias("n"))).otherwise(F.struct(F.lit(False).alias("open"), z["at"].alias("at"), z["n"].alias("n")))
        return F.aggregate(F.sequence(end - 1, first, F.lit(-1)), open_, back)

    def step(acc, x):
        full = (x["i"] > acc["a"]) & (acc["n"] + x["n"] > most)
        begin = tail(acc["a"], x["i"]) if overlap else F.struct(x["i"].alias("at"), F.lit(0).alias("n"))
        move = S.let(begin, lambda t: F.struct(F.array_append(acc["done"], F.struct(acc["a"].alias("a"), x["i"].alias("b"))).alias("done"), t["at"].alias("a"), (t["n"] + x["n"]).alias("n")))
        return F.when(full, move).otherwise(F.struct(acc["done"].alias("done"), acc["a"].alias("a"), (acc["n"] + x["n"]).alias("n")))

    last = lambda a: F.when(F.size(sizes) > a["a"], F.array_append(a["done"], F.struct(a["a"].alias("a"), F.size(sizes).alias("b")))).otherwise(a["done"])
    return F.aggregate(F.transform(sizes, lambda n, i: F.struct(i.alias("i"), n.alias("n"))), start, step, last)


def packed(pieces: Column, size, most: int, overlap: int = 0, joint: str = " ") -> Column:
    """Pieces joined greedily up to `most` by the measure `size`; each chunk begins with the last whole pieces of the one before
    that fit in `overlap`. Sizes are measured once, and a chunk is one slice of the pieces."""
    text = lambda p, c: F.array_join(F.slice(p, c["a"] + 1, c["b"] - c["a"]), joint)
    by_size = lambda p: S.let(F.transform(p, lambda x: size(x).cast("int")), lambda n: cuts(n, most, overlap))
    return S.let(pieces, lambda p: F.transform(by_size(p), lambda c: text(p, c)))


def word_chunks(text: Column, most: int = 400, least: int = 60, overlap: int = 50) -> Column:
    """A text of up to `most` words whole; else sentences packed with overlap, of what is still too long its lines, and windows of
    a line that is."""
    wide = lambda p: windows(S.words(p), most, max(1, most - overlap), least)
    by_line = lambda p: F.flatten(F.transform(packed(F.split(p, "\\n"), S.word_count, most, overlap, "\n"), lambda q: F.when(S.word_count(q) > most, wide(q)).otherwise(F.array(q))))
    parts = packed(sentences(text), S.word_count, most, overlap)
    cut = F.flatten(F.transform(parts, lambda p: F.when(S.word_count(p) > most, by_line(p)).otherwise(F.array(p))))
    long = F.filter(cut, lambda p: S.word_count(p) >= least)
    return S.let(S.word_count(text), lambda n: F.when(n < least, F.array().cast("array<string>")).when(n <= most, F.array(text)).otherwise(long))


def sentence_chunks(text: Column, most: int, size=S.word_count) -> Column:
    return packed(sentences(text), size, most)


def paragraph_chunks(text: Column, most: int = 600, target: int = 400, overlap: int = 50, size=S.word_count, split: str = "\\n{2,}") -> Column:
    """Paragraphs packed to target. One longer than most is packed by sentences of its own, a sentence longer than most is cut in
    windows of words; a paragraph that begins with [TABLE] is never cut. The overlap is the last whole paragraphs that fit, and
    size any measure (words here; a tokenizer's count where one is plugged in)."""
    paragraphs = F.filter(S.trimmed(F.split(text, split)), lambda p: p != "")
    hard = lambda p: F.flatten(F.transform(packed(sentences(p), size, most), lambda s: F.when(size(s) > most, windows(S.words(s), most, most)).otherwise(F.array(s))))
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when((size(p) > most) & ~F.startswith(p, F.lit("[TABLE]")), hard(p)).otherwise(F.array(p))))
    return packed(pieces, size, target, overlap, "\n\n")


def char_chunks(text: Column, most: int = 3200, overlap: int = 400) -> Column:
    """Paragraphs packed by characters; one that is too long is cut hard with overlap."""
    paragraphs = F.filter(S.trimmed(F.split(text, "\\n{2,}")), lambda p: p != "")
    hard = lambda p: F.transform(F.sequence(F.lit(1), F.length(p), F.lit(most - overlap)), lambda i: F.substring(p, i, F.lit(most)))
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > most, hard(p)).otherwise(F.array(p))))
    return packed(pieces, lambda p: F.length(p) + 1, most + 1, 0, "\n\n")


def segments(text: Column, pattern: str = V.RECOMMENDATION) -> Column:
    """The text cut at the start of each match: array of struct(is_match, text). A first piece without a match is kept."""
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1"), MARK)
    return F.filter(F.transform(pieces, lambda p, i: F.struct((i > 0).alias("is_match"), F.trim(p).alias("text"))), lambda x: x["text"] != "")


def sections(text: Column, title: Column, least: int = 60) -> Column:
    """array of struct(title, depth, method, text): headings in markdown, else upper-case lines, else numbered lines, three or
    more of a kind; else the whole text."""

    def cut(pattern, replacement):
        pieces = F.split(F.regexp_replace(text, pattern, replacement), MARK)
        return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.split(p, "\u0002"))

    part = lambda t, depth, method, body: F.struct(t.alias("title"), depth.cast("int").alias("depth"), F.lit(method).alias("method"), F.trim(body).alias("text"))
    marked = cut(V.MARKDOWN_HEADING, f"{MARK}$1\u0002$2\u0002")
    capital = cut(V.CAPITAL_HEADING, f"{MARK}$1\u0002")
    numbered = cut(V.NUMBERED_HEADING, f"{MARK}$1\u0002")
    long_enough = lambda a: F.filter(a, lambda x: S.word_count(x["text"]) >= least)
    one = lambda m: F.transform(m, lambda p: part(F.trim(F.get(p, F.lit(1))), F.length(F.get(p, F.lit(0))), "markdown_heading", F.get(p, F.lit(2))))
    two = lambda m: long_enough(F.transform(m, lambda p: part(S.title_case(F.trim(F.get(p, F.lit(0)))), F.lit(1), "caps_heading", F.get(p, F.lit(1)))))
    three = lambda m: long_enough(F.transform(m, lambda p: part(F.trim(F.get(p, F.lit(0))), F.lit(1), "numbered_heading", F.get(p, F.lit(1)))))
    whole = F.array(part(title, F.lit(1), "sliding_window", text))
    filled = lambda found, rest: S.let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(rest))
    by_number = S.let(numbered, lambda m: F.when(F.size(m) >= 3, filled(three(m), whole)).otherwise(whole))
    by_capitals = S.let(capital, lambda m: F.when(F.size(m) >= 3, filled(two(m), by_number)).otherwise(by_number))
    return S.let(marked, lambda m: F.when(F.size(m) >= 3, one(m)).otherwise(by_capitals))


def breadcrumbs(headings: DataFrame, levels: int = 6) -> DataFrame:
    """path: for each heading of a document (doc_id, seq, level, heading), the last heading of each lower level since then, and
    itself."""
    w = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = headings
    for k in range(1, levels + 1):
        own = F.when(F.col("level") == k, F.struct("seq", "heading"))
        reset = F.max(F.when(F.col("level") < k, F.col("seq"))).over(w)
        last = F.last(own, ignorenulls=True).over(w)
        rows = rows.withColumn(f"_h{k}", F.when((F.col("level") >= k) & (last["seq"] >= F.coalesce(reset, F.lit(-1))), last["heading"]))
    path = F.filter(F.array(*[F.col(f"_h{k}") for k in range(1, levels + 1)]), lambda x: x.isNotNull())
    return rows.withColumn("path", path).drop(*[f"_h{k}" for k in range(1, levels + 1)])


def filled_sections(rows: DataFrame) -> DataFrame:
    """section: the number of headings so far in the document; texts of a section joined in order."""
    w = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w))
    own = numbered.groupBy("doc_id", "section").agg(F.max(F.when(F.col("is_heading"), F.col("text"))).alias("heading"), F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("seq", "text")))).alias("_t"))
    return own.select("doc_id", "section", "heading", F.array_join(F.transform("_t", lambda x: x["text"]), "\n\n").alias("text"))


def numbered(chunks: DataFrame) -> DataFrame:
    """chunk_index from 0 and chunk_total within each document."""
    w = W.partitionBy("doc_id")
    return chunks.withColumns({"chunk_index": F.row_number().over(w.orderBy("seq")) - 1, "chunk_total": F.count(F.lit(1)).over(w)})


def recommendation_ids(chunks: DataFrame) -> DataFrame:
    """A running number of the document's recommendations, as an id; null for other chunks."""
    is_rec = F.col("chunk_type").isin("recommendation", "practice_point")
    n = F.sum(is_rec.cast("int")).over(W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return chunks.withColumn("recommendation_id", F.when(is_rec, F.concat(F.lit("R"), n.cast("string"))))


def built_chunks(docs: DataFrame, *, most: int = 400, least: int = 60, overlap: int = 50) -> DataFrame:
    """Enriched chunks of documents (doc_id, title, text): sections without those to skip, cut at recommendations, packed by
    words, typed, graded and tagged, numbered in each document."""
    cut = docs.select("doc_id", F.posexplode(sections(F.col("text"), F.col("title"), least)).alias("_s", "section")).where(~X.skipped_section(F.col("section.title")))
    cut = cut.select("doc_id", "_s", F.col("section.title").alias("section_title"), F.posexplode(segments(F.col("section.text"))).alias("_p", "segment"))
    rows = cut.select("doc_id", "_s", "_p", "section_title", F.col("segment.is_match").alias("at_recommendation"), F.posexplode(word_chunks(F.col("segment.text"), most, least, overlap)).alias("_c", "content"))
    place = W.partitionBy("doc_id").orderBy("_s", "_p", "_c")
    text, at = F.col("content"), F.col("at_recommendation")
    rows = rows.withColumns(
        {
            "seq": F.row_number().over(place),
            "chunk_type": X.segment_type(text, at),
            "grade_strength": F.when(at, X.strength(text)),
            "grade_evidence": F.when(at, X.evidence(text)),
            "population_tags": X.population_tags(text),
            "intervention_tags": X.intervention_tags(text),
            "has_dosage": X.has_dosage(text),
            "word_count": S.word_count(text),
            "content_hash": F.substring(S.content_id(text), 1, 32),
        }
    )
    return recommendation_ids(numbered(rows)).drop("_s", "_p", "_c", "seq")


def table_prose(rows: Column) -> Column:
    """A table's rows (arrays of cells): the first as 'a | b', others of its width as 'a: x; b: y' without empty cells."""
    full = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    head = F.get(full, F.lit(0))
    pair = lambda r: F.filter(F.zip_with(head, r, lambda h, v: F.when(v != "", F.concat(h, F.lit(": "), v))), lambda x: x.isNotNull())
    return F.array_join(F.transform(full, lambda r, i: F.when((i > 0) & (F.size(r) == F.size(head)), F.array_join(pair(r), "; ")).otherwise(F.array_join(r, " | "))), "\n")


def font_sections(spans: DataFrame) -> DataFrame:
    """Headings by font size: spans (doc_id, seq, size, text) of 1.2 times the document's commonest size or more; the level by
    the ratio 1.8, 1.5, 1.2."""
    usual = spans.groupBy("doc_id").agg(F.mode(F.round("size")).alias("_usual"))
    ratio = F.col("size") / F.col("_usual")
    return spans.join(usual, "doc_id").withColumn("level", F.when(ratio >= 1.8, 1).when(ratio >= 1.5, 2).when(ratio >= 1.2, 3)).withColumn("is_heading", F.col("level").isNotNull()).drop("_usual")
