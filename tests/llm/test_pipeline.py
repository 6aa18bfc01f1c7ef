"""The pipeline's stages on one small corpus."""

import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from codelode.llm.mixing import repetition_rates
from codelode.llm.queries import tokenizer_path


def test_stages(spark, tmp_path):
    base = [" ".join(f"word{(7 * i + 3 * j * j) % 97}x{j % (i + 5)}" for j in range(60 + i)) for i in range(24)]
    shared = " ".join(f"shared{j}" for j in range(40))
    rows = [(i, t + (" " + shared if i in (3, 9) else ""), "en", f"s{i % 2}") for i, t in enumerate(base)]
    rows += [(100, base[5], "en", "s0"), (101, base[6].replace("word", "word", 1) + " extra", "en", "s1"), (102, None, "en", "s0"), (103, "", None, None)]
    toxic = [(200 + i, base[i % 24] + " idiot moron scum" * 3, "en", "s0") for i in range(30)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows + toxic], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(r[0], 0, 1) for r in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, names = docs, []
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        kept, seen[name] = spark.read.parquet(path), {r.doc_id: r for r in spark.read.parquet(path).collect()}
        names.append(name)
        if name != "bpe":
            assert kept.columns == corpus_pipeline.COLUMNS
    assert set(range(24)) <= set(seen["toxicity"]) and len(set(seen["toxicity"]) & {r[0] for r in toxic}) <= 3
    assert {100, 101}.isdisjoint(seen["near_duplicates"]) and set(range(24)) <= set(seen["near_duplicates"])
    assert shared in seen["repeated_passages"][3].text and shared not in seen["repeated_passages"][9].text
    assert {r._source for r in repetition_rates(kept).collect()} <= {"s0", "s1", None}
    tok = Tokenizer.from_file(tokenizer_path())
    for doc, r in seen["bpe"].items():
        text = seen["mixing"][doc].text or ""
        ids = tok.encode(text, add_special_tokens=False).ids
        assert list(memoryview(r.ids).cast("I")) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
