"""Each stage on its own input against brute force, and the run as a whole."""

import os
import random

import pytest

import corpus_pipeline
from tests.llm.test_llm import brute_classes, brute_hits, brute_lines

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["the", "ing", "and", "er", "ou"]) for _ in range(3))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(3)]
    texts = ["\n".join(" ".join(word() for _ in range(12)) for _ in range(6)) for _ in range(40)]
    texts += [texts[0], texts[1] + " " + word(), texts[2] + "\n" + items[0][1], "12 34", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, str(tmp_path))
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    assert rows(one) == [(i, t) for i, t in enumerate(texts) if t and t != "12 34"]
    two = stages["line_dedup"](spark, one, str(tmp_path))
    assert rows(two) == sorted((i, t) for i, t, n, g in brute_lines(rows(one)) if g < n)
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = stages["near_duplicates"](spark, one, str(tmp_path))
    named = brute_classes(rows(one))
    assert rows(three) == [r for k, r in enumerate(rows(one)) if named[k][1] == r[0]]
    four = stages["decontamination"](spark, one, str(tmp_path))
    assert rows(four) == [r for r, h in zip(rows(one), brute_hits(rows(one), items), strict=True) if not h[4]]
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    five = stages["token_ids"](spark, four, str(tmp_path)).collect()
    assert len(five) == four.count() and all(len(r["token_ids"]) == 4 * r["n_tokens"] for r in five)


def test_near_duplicates_by_five_words(spark, tmp_path):
    """Two copies with five and six words changed far apart: 0.80 or more alike by runs of five words only for the first."""
    def changed(tag, n, words=234):
        text = [f"{tag}{i}" for i in range(words)]
        return " ".join(text), " ".join(f"x{i}" if i % 40 == 20 and i // 40 < n else w for i, w in enumerate(text))

    texts = [*changed("a", 5), *changed("b", 6)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(230)} for t in texts]
    alike = [len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in (0, 2)]
    assert alike[0] >= 0.8 > alike[1]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [0, 2, 3]


@pytest.mark.skipif(not os.path.isdir(D), reason="driver tables are absent")
def test_run(spark):
    out = corpus_pipeline.run(spark, D)
    assert 0 < out.count() <= spark.read.parquet(f"{D}/documents.parquet").count()
    assert out.columns == ["doc_id", "n_tokens", "token_ids"]
