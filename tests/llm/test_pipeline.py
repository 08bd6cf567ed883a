"""The pipeline's stages, each on what the one before has kept."""

import random

import corpus_pipeline
from skein.llm.packing import pieces

from .test_operators import fingerprint


def test_stages(spark, tmp_path):
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefgmnorst") for _ in range(r.randint(2, 8))) for _ in range(900)]
    line = " ".join(r.choices(vocab, k=20))
    good = ["\n".join(" ".join(r.choices(vocab, k=25)) for _ in range(6)) for _ in range(24)]
    texts = [*good, good[3], good[4] + "\n" + line, good[5] + "\n" + line, "too short", None, "again and again " * 60]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    at = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        at.append({r_.doc_id: r_ for r_ in docs.collect()} if k != 4 else docs.collect())
    quality, line_, near, mixed, packed = at
    assert {27, 28, 29}.isdisjoint(quality) and len(quality) == 27
    seen = set()
    for i in sorted(line_):  # a line stays where it stands first
        want = [x for x in (texts[i] or "").split("\n") if x not in seen]
        assert line_[i].text == "\n".join(want) and line_[i].n_chars == len(line_[i].text)
        seen |= set(want)
    first = {}
    for i in sorted(line_):
        first.setdefault(next((f for f in first if (f ^ fingerprint(line_[i].text)).bit_count() <= 4), fingerprint(line_[i].text)), i)
    assert set(near) == set(first.values())
    assert set(mixed) <= set(near)
    kept = spark.read.parquet(str(tmp_path / "3"))
    cut = pieces(kept, __import__("public_tokenizers").path("word_bpe_49k.json"))
    assert sum(p.length for p in packed) == sum(p.length for p in cut.collect())
