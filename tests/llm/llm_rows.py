"""Rows and tables that the operators' tests share."""

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
TEXTS = [
    None, "", "   \n\t", "one", "one two", "one two three", "One TWO three four five six seven eight nine ten eleven twelve thirteen fourteen",
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "one two three", "É é ß İ ﬁ     x́ 日本語 🙂",
    "same text here", "same text here", "<|endoftext|> and <|startoftext|> inside", "a" * 5000, "!!! ### $$$ 123 4.5.6", LONG,
]
#: Names that operators use inside.
CLASHES = ["fp", "node", "root", "digest", "keep_id", "of_digest", "row_digest", "row_keep", "row_number", "row_fp", "row_root", "known_fp", "of_id", "bad_id", "bad_hash", "quality_score", "key", "score", "n", "component_id", "w", "row"]


def table_of(spark, rows, clashes=True):
    """Rows (doc_id, text) as a documents table with extra columns of clashing names."""
    names = CLASHES if clashes else []
    schema = ", ".join(["doc_id bigint", "text string", "lang string", "source string", "n_chars bigint", *(f"`{c}` string" for c in names)])
    return spark.createDataFrame([(i, t, None, None if i == 3 else "s", None, *(["x"] * len(names))) for i, t in rows], schema)
