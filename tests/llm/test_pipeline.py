import hashlib

import corpus_pipeline
from conftest_path import prose
from sedimenta.llm import common
from test_decontaminate import brute as contaminated
from test_jaccard_join import brute as classes
from test_substring_dedup import brute as repeats
from tokenizers import Tokenizer

from sedimenta.llm.pieces import default_vocabulary


def rows():
    base, passage = prose(1, 200).split(), prose(2, 70)
    near = [*base[:100], "edit", *base[101:]]
    texts = [" ".join(base), " ".join(base), " ".join(near), f"{prose(3, 90)} {passage}", f"{passage} {prose(4, 90)}", "123 !!!", None, "", f"{prose(9, 20)} {prose(5, 100)}", passage, f"{prose(6, 500)} {' '.join(prose(9, 20).split()[:13])} {prose(7, 500)}", *[prose(20 + i, 60) for i in range(12)]]
    return [(i, t, ("en", "de")[i % 2], "src", len(t or "")) for i, t in enumerate(texts)]


def test_stages_equal_brute_force(spark, tmp_path):
    items = [(0, " ".join(prose(9, 20).split()))]
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)), "test-pipeline")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(sorted((r.doc_id, r.text) for r in docs.collect()))
    known = [r[:2] for r in rows() if r[0] not in (5, 6, 7)]
    assert seen[0] == known
    kept = {d[1] for d, c, _ in classes(known) if d[1] == c}
    assert seen[1] == [r for r in known if r[0] in kept]
    after = {d: (n, gone, sha) for d, n, gone, sha in repeats(seen[1])}
    assert [d for d, _ in seen[2]] == sorted(d for d, (n, gone, _) in after.items() if not n or gone < n)
    assert all(after[d][1] == 0 or hashlib.sha256(t.encode()).hexdigest() == after[d][2] for d, t in seen[2])
    bad = {d for d, _, hit, *_ in contaminated(seen[2], items) if hit}
    assert {8, 10} <= bad and seen[3] == [r for r in seen[2] if r[0] not in bad]
    lib = Tokenizer.from_file(default_vocabulary())
    out = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert out == [(d, len(lib.encode(t, add_special_tokens=False).ids)) for d, t in seen[3]]
