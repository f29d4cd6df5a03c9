"""Small inputs that hold the hard cases."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

ENGLISH = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree nearby"
GERMAN = "der schnelle braune fuchs springt über den faulen hund während sieben kluge eulen von der alten eiche zusehen"
HARD_TEXTS = [
    None, "", " ", "\n\t ", "a", "A", "É é", "the\x1cend\x1d!b", "no break space", "don't I'LL 's",
    "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "éå Å", "İstanbul ıÇ ΑΣ σς", "日本語 テキスト 한국어",
    "👩‍👩‍👧 emoji!!! ###", "123 4567 8,9", "   leading and trailing   ", "x" * 5000, "word " * 3000,
    "tab\tsep\x0bvt\x0cff\rcr\nlf", "\x85next line", "&&&***$$$%%%", "\\<\\|", "nul\x00byte",
]


def documents(spark, rows):
    """rows: (id, text) or (id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def hard_documents(spark):
    rows = [(i, t) for i, t in enumerate(HARD_TEXTS)]
    return documents(spark, [*rows, (None, "no id"), (None, None), (7, HARD_TEXTS[7]), (100, ENGLISH), (101, GERMAN, None)])


def with_clashes(df, *names):
    """The table with further columns of the given names."""
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df
