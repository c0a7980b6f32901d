"""What a Python worker holds while texts stream through it."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from emberlog.llm import bpe, substring_dedup

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_codec_holds_little_of_a_large_batch(spark, monkeypatch):
    """16 MB of texts in one Arrow batch, as it comes from a partition, are never held as Python objects at once."""
    df = spark.createDataFrame([(0, "")], "doc_id long, text string")
    kept = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: kept.update(f=f) or self)
    bpe.encode_decode(df, WORD, keep=["doc_id"])
    words = random.Random(5).choices(["the", "mixed", "corpus", "of", "documents,", "Unlikely", "wordstock", "42"], k=2000)
    text = " ".join(words)
    texts = [text[i:] for i in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "__text"])
    assert 10 << 20 < batch.nbytes < 32 << 20
    first = next(kept["f"](iter([batch.slice(0, 3)])))
    want = Tokenizer.from_file(WORD).encode(texts[1], add_special_tokens=False).ids
    assert first.column(2)[1].as_py() == b"".join(i.to_bytes(4, "little") for i in want)
    tracemalloc.start()
    rows = sum(rb.num_rows for rb in kept["f"](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts)
    assert peak < 8 << 20, peak


def test_codec_drops_what_other_stages_kept():
    substring_dedup._powers(3, 1 << 16)
    assert substring_dedup._grown
    bpe._codec.cache_clear()
    bpe._codec(WORD, bpe.WordCodec.patterns())
    assert not substring_dedup._grown
    assert len(substring_dedup._powers(3, 100)) == 100
