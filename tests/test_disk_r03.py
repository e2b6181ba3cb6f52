"""Findings of round 3: what a plan deals out."""

import pytest

from gleaner.plans import retrieval_queries as Q


class Taken(Exception):
    pass


def test_no_text_is_dealt_out_for_stretches(spark, sf_dir, monkeypatch):
    """The texts that adjacent_expand searches come from one pass over the documents,
    and are those of strides()."""

    def lexical(queries, documents, k):
        raise Taken(documents)

    monkeypatch.setattr(Q.retrieval, "lexical", lexical)
    with pytest.raises(Taken) as taken:
        Q.adjacent_hits(spark, sf_dir)
    got = taken.value.args[0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan, plan
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {(r["chunk_id"], texts[r["source"]][r["char_start"] : r["char_end"]]) for r in Q.strides(spark, sf_dir).collect()}
    assert {tuple(r) for r in got.select("id", "text").collect()} == want


def test_chunks_deal_out_a_parents_text_once(spark, sf_dir):
    """Numbers decide on sections, parents and chunks: no exchange of the last plan
    carries a child's text, and the parents' texts pass one."""
    from gleaner.plans import queries as P

    plan = P.own_chunks(spark, sf_dir)._jdf.queryExecution()
    spread = [x for x in plan.optimizedPlan().toString().split("\n") if "RepartitionByExpression" in x]
    assert len(spread) == 1, spread
    physical = plan.sparkPlan().toString()
    above = physical[: physical.index("Generate")]
    assert not any(x in above for x in ("Window", "Sort", "Join", "Aggregate", "Repartition")), above


def test_outlined_sections_are_those_of_texts(spark):
    from gleaner.operators import sections

    tiny = "1. One\nx\n2. Two\ny\n3. Three\n" + "long words here " * 9
    texts = ["", "\n\n", "plain\ntext", tiny, "\n \n" + tiny + "\n", tiny + "\n4. Four", "1. One", "1. Ein Wort\n中文\n\n2. Two\n" + "w " * 30]
    docs = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)] + [(None, tiny)], "source string, text string")
    got = sorted(map(tuple, sections.sections_of(docs).collect()), key=str)
    assert got == sorted(map(tuple, sections.merged(sections.raw_sections(docs)).collect()), key=str)
    assert len(got) > 8
