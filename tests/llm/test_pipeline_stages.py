"""How the stages of the pipeline are cut."""

import corpus_pipeline


def test_encoding_and_decoding_do_not_share_a_task(spark):
    rows = [(1, "a b c", "en", "web"), (1, None, "en", "web"), (None, "ünï 漢字 <|endoftext|>", None, "books"), (2, "", "de", None)]
    out = corpus_pipeline.encoded(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got = out.collect()
    assert len(got) == 4 and all(r["decodes"] for r in got)
    assert sorted(r["n_tokens"] for r in got)[:2] == [0, 0]
