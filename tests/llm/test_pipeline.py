import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import test_bag_minhash as near
from tests.llm import test_suffix_repeats as repeats
from tickloom.llm import bpe_automaton, decontamination, gated_toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, folder):
    """Documents with each kind of defect, planted over clean ones."""
    rng = np.random.default_rng(4)
    names = [f"{a}{b}{c}" for a in ("ba", "ko", "su", "mi") for b in ("ra", "ne", "lo", "ti", "du") for c in ("", "s", "ng", "mer")]
    text = lambda n: " ".join(rng.choice(names, n))
    clean = [text(rng.integers(30, 90)) for _ in range(120)]
    toxic = [text(20) + " grub" + "".join(rng.choice(list("aeiou"), 3)) + " " + text(20) for _ in range(40)]
    copies = [clean[0]] * 3 + [clean[i] + " end" for i in range(1, 6)]
    passage, items = text(60), [text(20) for _ in range(3)]
    shared, leaked = [text(40) + " " + passage + " " + text(40) for _ in range(6)], [text(50) + " " + i + " " + text(10) for i in items]
    texts = clean + toxic + copies + shared + leaked + ["", None]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int(120 <= i < 160)) for i in range(160)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_stages_equal_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = {r[0]: r[1] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        got = out.collect()
        if name == "toxicity":
            scores = gated_toxicity.score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
            given = {i: given[i] for i in (r.doc_id for r in scores if not r.predicted)}
            assert sum(i < 120 for i in given) > 110 and sum(120 <= i < 160 for i in given) < 8
        elif name == "near_duplicates":
            classes = near.brute_classes([(i, t) for i, t in given.items()])
            least = {}
            for i, t in given.items():
                least[classes[i, t or ""]] = min(i, least.get(classes[i, t or ""], i))
            given = {i: t for i, t in given.items() if least[classes[i, t or ""]] == i}
        elif name == "repeated_passages":
            found = repeats.brute(list(given.values()), 200)
            given = {i: t if t is None else b.decode("utf-8", "ignore") for (i, t), (*_, b) in zip(given.items(), found, strict=True)}
            assert sum(f[1] > 0 for f in found) >= 5
        elif name == "benchmark_leaks":
            from tests.llm.test_decontamination import brute_score

            words = [decontamination.word_numbers(x).tolist() for x in items]
            given = {i: t for i, t in given.items() if all(brute_score(w, decontamination.word_numbers(t or "").tolist()) < 0.5 for w in words)}
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            assert {r.doc_id: r.text for r in got} == given and len(got) == len(given)
            out.write.parquet(f"{folder}/stage{k}")
            docs = spark.read.parquet(f"{folder}/stage{k}")
        else:
            encoder, _ = bpe_automaton._worker(bpe_automaton.VOCABULARY)
            assert {r.doc_id: r.n_tokens for r in got} == {i: len(encoder.encode_all([t or ""])[0]) // 4 for i, t in given.items()}
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(whole.collect()) == sorted(got)


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
