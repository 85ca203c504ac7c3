"""Training-data operators do the whole of their job."""

import corpus_pipeline
import pyarrow.parquet as pq
from fathomgrid.llm import common, jaccard, language, lines
from pyspark.sql import functions as F


def test_the_middle_of_a_long_run_counts():
    model = language.fit(["the cat and the dog sat on the mat"] * 20 + ["我们 今天 去 学校 学习 中文"] * 20, ["en"] * 20 + ["zh"] * 20)
    head, tail = "the" * 13 + "t", "them"  # its first 40 letters and its last four
    mixed, plain = language.Scorer(model).predict([(head + "我们今天去学校学习中文" * 40 + tail).encode(), (head * 10 + tail).encode()])
    assert model.labels[mixed.argmax()] == "zh" and model.labels[plain.argmax()] == "en"


def test_every_letter_is_in_a_word():
    run = "".join(chr(0x4E00 + i) for i in range(95))
    words = language.WORD.findall(run)
    assert [len(w) for w in words] == [40, 40, 15] and "".join(words) == run
    assert language.WORD.findall("Donaudampfschiffahrt und so") == ["Donaudampfschiffahrt", "und", "so"]


def test_small_hosts_lose_boilerplate(spark):
    rows = [(i, f"own {i}\nmenu", "small") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["kept_text"] for r in lines.drop_boilerplate(docs).collect()} == {f"own {i}" for i in range(4)}
    assert {r["n_removed"] for r in lines.drop_boilerplate(docs, min_pages=5).collect()} == {0}


def test_an_id_with_several_texts_links_them(spark):
    a, b, c = "alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue cyan pink grey"
    rows = [(3, a), (5, a), (5, b), (7, b), (7, ""), (9, c), (9, c), (8, ""), (8, None), (None, c), (11, b), (11, c)]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"]: set() for r in got}
    for r in got:
        found[r["doc_id"]].add(r["component_id"])
    assert len(got) == len(rows)
    assert {i: x for i, x in found.items() if i is not None} == {3: {3}, 5: {3}, 7: {3}, 8: {8}, 9: {3}, 11: {3}}


def test_what_a_stage_returns_is_written_in_small_row_groups(spark, tmp_path):
    text = F.expr("array_join(transform(sequence(1, 160), i -> sha2(concat_ws('/', id, i), 512)), ' ')")
    docs = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("a").alias("source"), F.length(text).cast("long").alias("n_chars"))
    out = corpus_pipeline.dedup_lines(spark, docs, "")
    out.write.parquet(str(tmp_path / "out"))
    for path in (tmp_path / "out", common.materialize(out)._written):
        files = [pq.ParquetFile(p).metadata for p in type(tmp_path)(path).glob("*.parquet")]
        groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
        assert sum(g.num_rows for g in groups) == 2_000 and sum(g.total_byte_size for g in groups) > 3 * common.GROUP_BYTES
        assert max(g.total_byte_size for g in groups) < 2 * common.GROUP_BYTES
