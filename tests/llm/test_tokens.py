"""Packing's token ids: one library call for a step of texts, the same ids as one call for each pre-token."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from caseloom.llm import packing
from caseloom.llm.queries import RANKS
from caseloom.llm.spans import numbered_spans, span_hashes


class Counted:
    """An encoder that counts the calls made to it."""

    def __init__(self, encoder):
        self.encoder, self.calls = encoder, 0

    def __getattr__(self, name):
        found = getattr(self.encoder, name)
        if not name.startswith("encode"):
            return found

        def call(*args, **named):
            self.calls += 1
            return found(*args, **named)

        return call


def steps(texts, encoder=None):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    out = packing.token_steps(batch, encoder or packing._encoder(RANKS), packing.added_tokens(RANKS), 0, "<u2")
    return [np.frombuffer(ids, "<u2").tolist() for step in out for ids in step.column(3).to_pylist()]


def test_a_step_makes_few_library_calls():
    encoder = Counted(packing._encoder(RANKS))
    steps([" ".join(f"Word{k * k} other{k}" for k in range(j, j + 50)) for j in range(100)], encoder)
    assert encoder.calls <= 4


@pytest.mark.parametrize("odd", ["", "\U0010ffff", "x\U0010ffff y", "\0", "a\0b \0", "é !", "\U0010fffe"])
def test_ids_are_the_library_s_with_separators_in_texts(odd):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [odd, None, f"one {odd}two{odd}", "", f"{odd}{odd}<|endoftext|>{odd}", "plain  words\n don't"]
    assert steps(texts) == [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert steps([None, ""]) == [[0], [0]] and steps([]) == []


@pytest.mark.parametrize("n", [1, 7, 8, 9, 400, 5000])
def test_spans_are_numbered_by_their_bytes(n):
    rng = np.random.default_rng(n)
    data = rng.integers(0, 2, n).astype(np.uint8)
    cuts = np.unique(np.append(rng.integers(0, n + 1, n // 6), [0, n]))
    starts, ends = cuts[:-1], cuts[1:]
    for hashes in (span_hashes(data, starts, ends), np.zeros(len(starts), np.uint64), (ends - starts).astype(np.uint64) % np.uint64(3)):
        which, first = numbered_spans(data, starts, ends, hashes)
        texts = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        assert [texts[first[k]] for k in which] == texts
        assert len(first) == len(set(texts)) == len(set(which.tolist()))
