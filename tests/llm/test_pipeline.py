"""The pipeline's stages on a small corpus against their brute-force versions, and the registry."""

from __future__ import annotations

from collections import Counter

import pytest

from tests.llm.test_text_operators import links_of, rules_of, words
from voxtable.llm import quality_rules, registry

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder_of(spark, tmp_path_factory, docs):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    text = next(r.text for r in docs.where("doc_id = 1003").collect())
    item = " ".join(text.split()[100:130])
    spark.createDataFrame([(1, item), (2, "nothing like this is in any of the documents of the small corpus here at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder_of):
    docs = spark.read.parquet(f"{folder_of}/documents.parquet")
    before = docs.collect()

    def after(k):
        nonlocal docs
        docs = pipeline.STAGES[k][1](spark, docs, folder_of)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        return docs.collect()

    good = [r for r in before if not any(f({m: v for m, v in zip(quality_rules.MEASURES, rules_of(r.text))}) for f in quality_rules.RULES.values())]
    one = after(0)
    assert Counter(map(tuple, one)) == Counter(map(tuple, good)) and 0 < len(one) < len(before)
    two = after(1)
    keep = {d for d, _, c in links_of([(r.doc_id, r.text) for r in one], 5, 80, 100) if d == c}
    assert Counter(map(tuple, two)) == Counter(tuple(r) for r in one if r.doc_id in keep or r.doc_id is None)
    three = after(2)
    assert Counter(r.doc_id for r in three) == Counter(r.doc_id for r in two)
    assert sum(len(words(r.text)) for r in three) < sum(len(words(r.text)) for r in two)
    left = Counter()  # word by word: what no window covers that starts in a smaller id
    least = {}
    for r in two:
        w = words(r.text)
        for i in range(len(w) - 12 if r.doc_id is not None else 0):
            least[tuple(w[i : i + 13])] = min(least.get(tuple(w[i : i + 13]), r.doc_id), r.doc_id)
    for r in two:
        w, gone = words(r.text), set()
        for i in range(len(w) - 12 if r.doc_id is not None else 0):
            gone |= set(range(i, i + 13)) if least[tuple(w[i : i + 13])] < r.doc_id else set()
        left[r.doc_id, tuple(x for i, x in enumerate(w) if i not in gone)] += 1
    assert Counter((r.doc_id, tuple(words(r.text))) for r in three) == left
    assert all(r.n_chars == len(r.text) for r in three)
    four = after(3)
    assert {r.doc_id for r in three} - {r.doc_id for r in four} == {1003}
    five = after(4)
    assert {r.doc_id for r in five} == {r.doc_id for r in four}


def test_stages_of_nothing_and_of_odd_rows(spark, folder_of):
    """Empty tables, nulls in every column, repeated rows and further columns with the operators' names."""
    text = " ".join(f"word{k}" for k in range(40))
    odd = [(1, text, None, None, None, 5, "x"), (1, text, None, None, None, 5, "x"), (None, text, "en", "s", 3, None, None), (None, None, None, None, None, None, None), (4, "", "en", "s", 0, 1, "y"), (5, text, "en", "s", 3, 1, "y")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, n_words int, fail_bits string")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        assert stage(spark, docs.where("false"), folder_of).count() == 0, name
        docs = stage(spark, docs, folder_of)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "fail_bits"]
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        if k in (0, 1):
            assert Counter(r.doc_id for r in docs.collect()) == (Counter([1, 1, None, 5]) if k == 0 else Counter([1, 1, None]))
    assert Counter(r.doc_id for r in docs.collect()) == Counter([1, 1, None])


def test_run_and_registry(spark, folder_of):
    rows = pipeline.run(spark, folder_of)
    assert rows.count() > 0 and pipeline.ORACLE_SQL is None
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names if n.startswith("op")] == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
