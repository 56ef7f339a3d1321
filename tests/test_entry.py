import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"query_id", "id", "score"} <= set(rows[0].asDict())


def test_results_do_not_depend_on_partitions(spark):
    d = "/root/testdata/sf0.001"
    q = entry.queries()["lex3_bm25"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(tuple(r) for r in q(spark, d).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
