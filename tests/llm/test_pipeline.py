"""The pipeline against its stages by hand, and the registered queries."""
import __spark_entry__ as entry
import corpus_pipeline as pipeline
from conftest import SF_SMALL

from faultline.llm import decontaminate, line_dedup, simhash, toxicity


def test_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and {"op1_line_dedup", "op11_url_filter"} <= set(entry.oracle_sql())


def test_stages_in_order_keep_columns_and_take_effect(spark, read):
    docs, columns = read("documents"), read("documents").columns
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    a = pipeline.drop_toxic(spark, docs, SF_SMALL)
    scores = toxicity.report(docs, read("labels")).collect()
    assert a.columns == columns and {r.doc_id for r in a.collect()} == {r.doc_id for r in scores if not r.predicted}
    b = pipeline.dedup_lines(spark, a, SF_SMALL)
    assert b.columns == columns and sorted(map(str, b.collect())) == sorted(map(str, line_dedup.dedup_lines(a).collect()))
    c = pipeline.drop_near_copies(spark, b, SF_SMALL)
    assert c.columns == columns and {r.doc_id for r in c.collect()} == {r.component_id for r in simhash.report(b).collect()}
    d = pipeline.drop_contaminated(spark, c, SF_SMALL)
    clean = {r.doc_id for r in decontaminate.report(c, read("benchmark")).collect() if not r.contaminated}
    assert d.columns == columns and {r.doc_id for r in d.collect()} == clean
    run = pipeline.run(spark, SF_SMALL)
    assert {r.doc_id for r in run.select("doc_id").distinct().collect()} == clean
    assert run.agg({"length": "sum"}).first()[0] == d.count() + sum(r.n for r in _tokens(d))


def _tokens(docs):
    import public_tokenizers
    from pyspark.sql import Row
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [Row(n=len(whole.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
