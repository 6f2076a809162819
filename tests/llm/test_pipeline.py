import __spark_entry__
import corpus_pipeline
from quotemill.llm import language
from quotemill.llm.queries import read

from . import brute
from .test_pieces import expected


def test_pipeline_equals_brute_force(spark, small, documents):
    rows = [(r.doc_id, r.text) for r in language.accepted(documents).select("doc_id", "text").collect()]
    cut = brute.cut_lines(rows)
    rows = [(i, cut[i][2] if t is not None else None) for i, t in rows]
    prints = [brute.fingerprint(t) for _, t in rows]
    owners = brute.components(prints, [i for i, _ in rows])
    rows = [r for r, owner in zip(rows, owners) if r[0] == owner]
    leaked = {d for d, *_ in brute.contained(rows, [(r.item_id, r.text) for r in read(spark, small, "benchmark").collect()])}
    wanted = {(i, *expected(t)) for i, t in rows if i not in leaked}
    got = corpus_pipeline.run(spark, small).collect()
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted


def test_stages_keep_the_columns_and_bear_odd_rows(make, spark, small):
    line = "a line of more than twenty characters"
    rows = [
        (1, f"{line}\nthe cat and the mouse", "en", "s", 10, 1), (2, f"{line}\nthe cat and a mouse", "en", None, None, 1), (3, line, None, "s", 3, 1),
        (4, None, "en", "s", 0, 1), (5, "", "en", "s", 0, 1), (None, "the cat and the mouse", "en", "s", 1, 1), (6, "the cat " * 40_000, "en", "s", 1, 1),
        (6, "the cat " * 40_000, "en", "s", 1, 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id long"
    for docs in (make(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_registered():
    names = __spark_entry__.queries()
    assert names["pipeline"] is corpus_pipeline.run and [n for n, _ in corpus_pipeline.STAGES][2] == "simhash"
    assert {n for n in names if n.startswith("op")} == {
        "op1_topk_search", "op2_html_extraction", "op3_toxicity", "op4_simhash", "op5_piece_ids", "op6_line_dedup",
        "op7_language_id", "op8_chat_formatting", "op9_decontamination", "op10_url_filter",
        "op11_manifest", "op12_conversation_repair", "op13_bpe_ids",
    }
