"""The rendering of documents as files of code."""

from pairloom.plans import fixtures as X


def test_a_line_is_looked_at_once_for_both_files(spark, tmp_path, rows):
    texts = ['say "a\\b"\n\n12 no name', "", None, "ab cd ef gh ij"]
    docs = spark.createDataFrame([(i, t, f"src{i % 20}", "en", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, source string, lang string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    files = X.code_files(spark, str(tmp_path))
    limit = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        assert files._jdf.queryExecution().executedPlan().toString().count("regexp_extract(") == 1
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", limit)
    # The same as the files made from every line by itself.
    got = {r.path: r.content and bytes(r.content).decode() for r in files.collect()}
    for i, text in enumerate(texts):
        lines = spark.createDataFrame([(x,) for x in text.split("\n")], "x string") if text is not None else None
        made = lines and [tuple(r) for r in lines.selectExpr(
            X.source_function("x"), X.marker_name("x"), X.decompiled_function("x")).collect()]
        stem = f"src{i}/d{i:06d}/f00"
        assert got[stem + (".c", ".cpp", ".cc")[i % 3]] == (made and "\n".join(m[0] for m in made))
        assert got[stem + ".o.c"] == (made and f"/* doc {i} */\n" + "".join(f"// FUNCTION {m[1]}\n{m[2]}" for m in made))
