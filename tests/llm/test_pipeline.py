from collections import Counter

import corpus_pipeline
import public_tokenizers as P
from helpers import awkward, empty, personal, prose, shingles
from tokenizers import Tokenizer


def test_stages_on_awkward_rows(spark):
    for docs in (awkward(spark), empty(spark)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, "")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == corpus_pipeline.COLUMNS
                docs = spark.createDataFrame(docs.collect(), docs.schema)
        docs.collect()


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, stages = docs, dict(corpus_pipeline.STAGES)
    first = spark.createDataFrame(stages["language_id"](spark, kept, sf_dir).collect(), docs.schema)
    assert first.count() >= 0.99 * docs.count()
    second = spark.createDataFrame(stages["jaccard_join"](spark, first, sf_dir).collect(), docs.schema)
    sets = {r["doc_id"]: shingles(r["text"]) for r in first.collect()}
    left = {r["doc_id"] for r in second.collect()}
    close = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ids = sorted(sets)
    assert not any(close(a, b) for a in left for b in left if a < b)
    assert all(any(close(a, b) for b in ids if b < a) for a in set(ids) - left)
    third = spark.createDataFrame(stages["personal_data"](spark, second, sf_dir).collect(), docs.schema)
    assert not any(personal(r["text"]) for r in third.collect())
    fourth = spark.createDataFrame(stages["mixing"](spark, third, sf_dir).collect(), docs.schema)
    copies = Counter(r["doc_id"] for r in fourth.collect())
    assert max(copies.values()) <= 3 and set(copies) <= left
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    text = {r["doc_id"]: r["text"] for r in fourth.collect()}
    for r in stages["bpe_encoding"](spark, fourth, sf_dir).collect():
        assert r["ids"] == lib.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_texts_of_no_learned_language_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = ["\u1200\u1201\u1203 \u1205\u1206" * 20, "\u16a0\u16a1\u16a2\u16a3 " * 30, "12 34 !!", None]
    more = spark.createDataFrame([(-i - 1, t, None, "s", 1) for i, t in enumerate(odd)], docs.schema)
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs.unionByName(more), sf_dir).collect()}
    assert not any(i < 0 for i in kept) and len(kept) >= 0.99 * docs.count()


def test_rows_without_an_id_of_their_own(spark):
    texts = [prose(i, 40, 9000) for i in range(5)]
    rows = [(2, texts[0]), (2, texts[1]), (1, texts[0] + " more"), (None, texts[2]), (None, texts[3]), (None, texts[1]), (7, None), (7, texts[4])]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    left = stages["jaccard_join"](spark, docs, "")
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(2, texts[1]), (1, texts[0] + " more"), (None, texts[2]), (None, texts[3]), (7, None), (7, texts[4])])
    # One source whose target is its size: every text that has words is taken once, also where ids are null or repeated.
    whole = spark.createDataFrame([(i, prose(50 + k, 16), "en", "a", 1) for k, i in enumerate([None, None, 3, 3, 4])], docs.schema)
    assert Counter(map(tuple, stages["mixing"](spark, whole, "").collect())) == Counter(map(tuple, whole.collect()))


def test_workers_let_go_of_a_model(spark):
    """Before, tasks without a model looked at a copy of what the worker holds, and idle workers held it for ever."""
    import time

    import pyarrow as pa

    from tidemark.llm import common

    def holding(batches):
        from tidemark.llm.common import held

        for b in batches:
            held("test", lambda: "model")
            time.sleep(0.3)
            yield b

    def looking(batches):
        from tidemark.llm.common import _HELD

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(_HELD)] * b.num_rows, pa.int64())], ["id"])

    rows = spark.range(0, 8, 1, 4)
    found = lambda model: sum(r["id"] for r in common.arrow_map(rows, looking, "id long", model=model).collect())
    common.arrow_map(rows, holding, "id long", model=True).collect()
    assert found(True) > 0
    common.arrow_map(rows, holding, "id long", model=True).collect()
    assert found(False) == 0
    common.arrow_map(rows, holding, "id long", model=True).collect()
    time.sleep(common.IDLE_S + 1)
    assert found(True) == 0
