import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from weftline.llm import mixing, toxicity  # noqa: E402
from weftline.llm.common import table, written  # noqa: E402


def test_stages_against_plain_python(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "sentencepiece"]
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small_dir), f"test-{name}")
        outs.append(docs)
    clean, unique, apart, mixed, tokens = outs
    assert all(o.columns == columns for o in outs[:-1])
    source = table(spark, small_dir, "documents")
    scored = toxicity.score(source, toxicity.train(source, table(spark, small_dir, "labels"))).collect()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in scored if r.score < 0.5)
    last = {}
    for r in clean.collect():
        k = (r.text or "").translate(brute.UPPER_TO_LOWER)
        last[k] = max(last.get(k, -1), r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(last.values())
    ids = sorted(last.values())
    pairs = [(d, rows[d].text) for d in ids]
    want = sorted(d for (d, t), c in zip(pairs, brute.components(pairs), strict=True) if d == c or not brute.shingles(t))
    assert sorted(r.doc_id for r in apart.collect()) == want
    plan = mixing.choose(*mixing.units(apart)).collect()
    copies = sorted(d for r in plan for d in [r.doc_id] * r.copies)
    assert sorted(r.doc_id for r in mixed.collect()) == copies
    got = tokens.collect()
    assert sorted(r.doc_id for r in got) == copies and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_run(spark, small_dir):
    assert corpus_pipeline.run(spark, small_dir).columns == ["doc_id", "n_tokens", "round_trip", "ids"]
