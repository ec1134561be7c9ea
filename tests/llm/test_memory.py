"""Arrays of a task stay small beside the batch it reads, and files are written for rows only."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from caseloom.llm import packing, suffix
from caseloom.llm.queries import RANKS
from caseloom.llm.spans import text_bytes


def texts(n, words, seed=5):
    rnd = random.Random(seed)
    known = ["".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(1, 9))) for _ in range(4000)]
    return [" ".join(rnd.choice(known) for _ in range(words)) for _ in range(n)]


def peak_mb(steps):
    tracemalloc.start()
    try:
        n = sum(1 for _ in steps)
        return tracemalloc.get_traced_memory()[1] / 1e6, n
    finally:
        tracemalloc.stop()


def test_tokenising_holds_a_step_of_a_batch(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array(texts(1200, 600))], ["doc_id", "text"])
    encoder, size = packing._encoder(RANKS), batch.column(1).nbytes
    list(packing.token_steps(batch.slice(0, 5), encoder, {}, 0, "<u2"))
    peak, n = peak_mb(packing.token_steps(batch, encoder, {}, 0, "<u2"))
    assert size > 4e6 and n > 5 and peak < 70
    whole = [r for b in packing.token_steps(batch, encoder, {}, 0, "<u2") for r in b.to_pylist()]
    monkeypatch.setattr(packing, "STEP_BYTES", 8 << 20)
    at_once = list(packing.token_steps(batch, encoder, {}, 0, "<u2"))
    assert len(at_once) == 1 and at_once[0].to_pylist() == whole
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder._mergeable_ranks, special_tokens={})
    text = batch.column(1)[7].as_py()
    assert np.frombuffer(whole[7]["ids"], "<u2").tolist() == [*library.encode_ordinary(text), 0]


def test_anchors_hold_a_piece_of_a_batch():
    data, off = text_bytes(pa.array(texts(1000, 600)))
    strings = suffix.Strings()
    peak, n = peak_mb(suffix.text_anchors(data, off, strings))
    assert len(data) > 3e6 and n > 10 and peak < 30


def test_nothing_is_written_for_large_keys_where_there_are_none(spark, monkeypatch):
    shared = " ".join(f"passage{k}" for k in range(60))
    rows = spark.createDataFrame([(k, f"{'x' * k} own{k} {shared} end{k}") for k in range(12)], "uid long, text string")
    names, store = [], suffix.stored
    monkeypatch.setattr(suffix, "stored", lambda df, name, *rest: (names.append(name), store(df, name, *rest))[1])
    found = {}
    for group in (4096, 3):
        names.clear()
        out = suffix.repeated_ranges(rows, group=group).collect()
        found[group] = {r.uid: {p for a in r.ranges for p in range(a.low, a.high + 1)} for r in out}
        assert ({"large", "strings", "counts"} <= set(names)) == (group == 3)
        assert group == 3 or not {"large", "strings", "counts"} & set(names)
    inside = {u: {p for p in places if 0 <= p <= len(shared) + u + 20} for u, places in found[4096].items()}
    assert inside == {u: {p for p in places if 0 <= p <= len(shared) + u + 20} for u, places in found[3].items()}
    assert len(inside) == 12 and all(inside.values())
