"""sf3_bigram_tokens against its SQL on texts of which all words are dropped, and on letters that change in number."""

import duckdb

import __spark_entry__ as entry


def test_bigrams_equal_sql_on_odd_texts(spark, tmp_path):
    texts = ["İstanbul ẞ", None, "", "...", "Kelvin Σ", *["w"] * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in entry.queries()["sf3_bigram_tokens"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(entry.oracle_sql()["sf3_bigram_tokens"]).fetchall())
    assert len(got) < sum(bool(t and t != "...") for t in texts)  # some were dropped whole
