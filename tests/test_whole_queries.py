"""Registered queries read whole tables and texts."""

from litmill.plans import sources


def test_all_messages_are_combined(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in (1, 2) for t in range(40)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sources.QUERIES["src12_combine_messages"](spark, str(tmp_path)).collect()
    combined = "\n".join(r.combined for r in got).split("\n")
    assert sum(r.n_sources for r in got) == len(rows) and all(r[3] in combined for r in rows)
