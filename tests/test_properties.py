"""Properties of expressions over generated inputs, a batch of cases in one job."""

import random
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import scalars as S
from corpusmill.operators import chunking as K, retrieval as R
from corpusmill.sources import html as H, readers as Rd


def mapped(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def texts(n=150, alphabet="ab[]123 .\n☐"):
    rng = random.Random(7)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_compression_keeps_the_marks(spark):
    """Expanding the ranges again gives the runs' marks in order."""
    values = texts()
    for before, after in zip(values, mapped(spark, R.compressed(F.col("t")), values), strict=True):
        wide = re.sub(r"\[(\d+)-(\d+)\]", lambda m: "".join(f"[{i}]" for i in range(int(m[1]), int(m[2]) + 1)), after)
        assert sorted(re.findall(r"\[\d+\]", wide)) == sorted(f"[{int(x)}]" for x in re.findall(r"\[(\d+)\]", before))
        assert re.sub(r"(\[\d+\])+", "|", wide) == re.sub(r"(\[\d+\])+", "|", before)


def test_renumbering_is_idempotent(spark):
    once = mapped(spark, R.renumbered(F.col("t")), texts())
    assert mapped(spark, R.renumbered(F.col("t")), once) == once


def test_titles(spark):
    values = texts(alphabet="aB'é-/ 1ß")
    assert mapped(spark, S.title_case(F.col("t")), [v.replace("ß", "s") for v in values]) == [v.replace("ß", "s").title() for v in values]


def test_windows_cover_all_words(spark):
    values = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 9, 10, 11, 35)]
    for text, got in zip(values, mapped(spark, K.windows(S.words(F.col("t")), 10, 7), values), strict=True):
        assert set(text.split()) == {w for g in got for w in g.split()}


def test_packing_loses_no_piece(spark):
    values = [". ".join("x " * (i * 5 % 7 + 1) + str(i) for i in range(n)) + "." for n in (1, 5, 40)]
    for text, got in zip(values, mapped(spark, K.packed(K.sentences(F.col("t")), S.word_count, 12), values), strict=True):
        assert " ".join(got).split() == text.split()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/pdivh1 abc&;\"'=", max_size=80))
def test_parser_takes_anything(text):
    for level, heading, body in H.sections_of(text):
        assert 1 <= level <= 6 and body.strip()


def test_event_blocks(spark):
    good = 'event: a\ndata: {"x": 1}\n\n'
    assert [len(x) for x in mapped(spark, Rd.event_blocks(F.col("t")), ["", good, good * 2, good + "event: b\ndata: {", "data: 1\n\n" + good])] == [0, 1, 2, 1, 1]
