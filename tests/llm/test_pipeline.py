import random

import corpus_pipeline
import public_tokenizers
import pytest

from tessera.llm import quality_crf

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, root, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{root}/{name}.parquet")


def corpus():
    """Sentences and junk, copies, near copies, a benchmark passage, and texts that are null, empty or very long."""
    rng = random.Random(5)
    vocab = [f"word{k}" for k in range(400)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    item = " ".join(some(30))
    rows, labels = [], []
    for k in range(90):
        good = k % 3 > 0
        lines = [" ".join(some(rng.randrange(8, 25))).capitalize() + "." for _ in range(rng.randrange(2, 6))] if good else ["|".join(some(3)) + " $$ 77 >>" for _ in range(rng.randrange(3, 9))]
        rows.append((k, "\n".join(lines)))
        labels.append((k, int(good), 0))
        if good and k % 4 == 0:
            rows.append((200 + k, rows[-1][1].replace("\n", " \n ")))
        if good and k % 5 == 0:
            rows.append((400 + k, rows[k if k < len(rows) else -1][1] if False else "\n".join([*lines, lines[0]])))
        if good and k % 10 == 1:
            rows.append((600 + k, "\n".join([lines[0], item, lines[-1]])))
    rows += [(900, None), (901, ""), (902, "\n".join(rows[1][1] + f" {k}" for k in range(300)))]
    return rows, labels, [(1, item), (2, None)]


def kept(rows, scores, items):
    """What a plain run of the stages keeps."""
    rows = [(i, t) for i, t in rows if scores[i] >= corpus_pipeline.REJECT]
    first = {r[0] for r in brute.exact(rows) if r[3]}
    rows = [(i, t) for i, t in rows if i in first]
    same = {i: c for i, n, c in brute.classes(rows, 5, 80, 100) if n}
    rows = [(i, t) for i, t in rows if same.get(i, i) == i]
    bad = {i for i, *_ in brute.leaks(rows, items)}
    return [(i, t) for i, t in rows if i not in bad]


def test_pipeline(spark, tmp_path):
    import sentencepiece

    rows, labels, items = corpus()
    root = f"file://{tmp_path}"
    table(spark, root, "documents", [(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    table(spark, root, "labels", labels, "doc_id long, quality int, toxic int")
    table(spark, root, "benchmark", items, "item_id long, text string")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    model = quality_crf.train(docs, spark.read.parquet(f"{root}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality_crf.score(docs, model).collect()}
    want = dict(kept(rows, scores, items))
    assert 10 < len(want) < len(rows) - 20
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, root).collect()}
    assert got.keys() == want.keys()
    assert all(got[i]["n_tokens"] == len(sp.encode(t or "")) for i, t in want.items())


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a b"), (None, "a b"), (3, ""), (3, "")]])
def test_stages_of_odd_tables(spark, tmp_path, rows):
    """Empty tables, texts without ids and repeated rows go through all stages; further columns stay up to the last."""
    root = f"file://{tmp_path}"
    table(spark, root, "documents", [(i, t, "en", "s", 0) for i, t in rows], DOCS)
    table(spark, root, "labels", [], "doc_id long, quality int, toxic int")
    table(spark, root, "benchmark", [], "item_id long, text string")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, root).columns == docs.columns, name
    assert corpus_pipeline.run(spark, root).count() <= len(rows)
