"""Each stage of the pipeline, on what its predecessor kept, against a plain version."""

from collections import Counter

import brute
import numpy as np
import public_tokenizers
from data import documents
from test_models import leaks
from tokenizers import Tokenizer

import corpus_pipeline as cp
from gridwise.llm import mixing, quality_classifier
from gridwise.llm.common import new_folder, read

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_score(text, model):
    """The weights of the text's n-grams, each kind's mean, one sparse vector at a time."""
    (places, values), = quality_classifier.vectors([text or ""])
    return 1 / (1 + np.exp(-(float(model[places].astype(float) @ values) + float(model[-1]))))


def plain_mix(spark, docs):
    """How many words each row gives, by reading every slot of the plan."""
    order = sorted({r["source"] for r in docs}, key=lambda s: (s is None, s or ""))
    of = {s: sorted((r for r in docs if r["source"] == s), key=lambda r: r["doc_id"]) for s in order}
    words = {i: [r["doc_id"] for r in of[s] for _ in brute.words(r["text"])] for i, s in enumerate(order)}
    sizes = [len(words[i]) for i in range(len(order))]
    plan = mixing.pd.DataFrame({"source": mixing.pd.Series(order, dtype=object), "source_no": range(len(order)), "source_size": sizes, "target": mixing.targets(np.array(sizes))})
    want = Counter()
    for r in mixing.slots(spark, plan, mixing.BLOCK_WORDS, mixing.SEED).collect():
        want.update(words[r["source_no"]][r["block"] * mixing.BLOCK_WORDS :][: min(mixing.BLOCK_WORDS, r["n_words"])])
    return want


def test_stages_equal_plain_versions(spark):
    given = [tuple(r) for r in read(spark, SF, "documents").filter("length(text) < 20000").collect()]
    more = [(100_000 + d, t, "xx", ("web", None, "books")[d % 3], len(t or "")) for d, t in documents(8, 90) if d != 14]
    docs = spark.createDataFrame(given + more, SCHEMA).repartition(5)
    rows = docs.collect()

    model = quality_classifier.fit(docs, read(spark, SF, "labels"))
    kept = cp.quality(spark, docs, SF).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in rows if plain_score(r["text"], model) >= 0.5) and 100 < len(kept) < len(rows)

    docs = spark.createDataFrame(kept, SCHEMA).repartition(4)
    heads = {d for d, _, c in brute.jaccard([(r["doc_id"], r["text"]) for r in kept]) if d == c}
    alone = cp.copies(spark, docs, SF).collect()
    assert sorted(map(str, alone)) == sorted(str(r) for r in kept if r["doc_id"] in heads) and len(alone) < len(kept)

    docs = spark.createDataFrame(alone, SCHEMA).repartition(4)
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    leaking = {x[0] for x in leaks([(r["doc_id"], r["text"]) for r in alone], items)}
    clean = cp.leaks(spark, docs, SF).collect()
    assert sorted(map(str, clean)) == sorted(str(r) for r in alone if r["doc_id"] not in leaking)

    docs = spark.createDataFrame(clean, SCHEMA).repartition(4)
    mixed, texts, got = cp.mix(spark, docs, SF).collect(), {r["doc_id"]: r for r in clean}, Counter()
    for r in mixed:
        whole = texts[r["doc_id"]]
        assert r["text"] in whole["text"] and (r["lang"], r["source"], r["n_chars"]) == (whole["lang"], whole["source"], len(r["text"]))
        got[r["doc_id"]] += len(brute.words(r["text"]))
    assert got == plain_mix(spark, clean)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = cp.tokens(spark, spark.createDataFrame(mixed, SCHEMA).repartition(4), SF).collect()
    assert sorted(map(tuple, out), key=lambda r: r[1]) == brute.tokens([(r["doc_id"], r["text"]) for r in mixed], tokenizer)


def test_run_is_its_stages_one_after_another(spark):
    docs = read(spark, SF, "documents").filter("length(text) < 3000")
    folder = new_folder(spark, "small")
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        read(spark, SF, name).write.parquet(f"{folder}/{name}.parquet")
    for _, stage_of in cp.STAGES:
        out = stage_of(spark, docs, folder)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, cp.run(spark, folder).collect()))
