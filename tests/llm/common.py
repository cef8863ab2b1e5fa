SF = "/root/testdata/sf0.001"


def documents(spark, rows, extra=False):
    """A documents table of (doc_id, text); ``extra`` adds columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(data, schema)
    if extra:
        for name in ("key", "digest", "row", "kept", "group_size", "winner", "ids", "length", "score", "b", "t", "doc", "first", "base", "grams", "w", "llr", "th", "n", "node", "component", "__base", "__grams", "__rules2", "__key", "__digest", "__k", "__t"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df
