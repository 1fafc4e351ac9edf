import random
from pathlib import Path

import numpy as np
import pytest

from weftline.llm import pieces

spm = pytest.importorskip("sentencepiece")
if not Path(pieces.MODEL).exists():
    pytest.skip("no model", allow_module_level=True)


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.model_bytes())


def texts():
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdeinorst") for _ in range(n))
    mixed = ["".join(r.choice("ab  cdethin▁\n\x00é日🤦") for _ in range(r.randint(0, 90))) for _ in range(300)]
    return [*mixed, word(30_000), "ab" * 15_000, "日本語テキスト" * 3_000, " ".join(word(r.randint(1, 200)) for _ in range(900)), " " * 9_000, "x", "", "a", "ing" * 50 + " " + "🤦" * 70]


@pytest.mark.parametrize(("at_once", "whole", "middle"), [(200_000, 500_000, 20_000), (64, 200, 70), (1_000, 300, 100)])
def test_sections_windows_and_regions_change_nothing(monkeypatch, library, own, at_once, whole, middle):
    """Texts longer than a section, chunks longer than a window and regions beyond the dictionary give the library's ids."""
    monkeypatch.setattr(pieces, "AT_ONCE", at_once)
    monkeypatch.setattr(pieces, "TEXTS", whole)
    monkeypatch.setattr(pieces, "MIDDLE", middle)
    monkeypatch.setattr(pieces, "REMEMBERED", 20_000)
    given = texts()
    for _ in range(2):  # the second time from memory, in part
        for t, ids in zip(given, own.encode(given), strict=True):
            assert ids.tolist() == library.encode(t), t[:80]
            assert own.decode(ids) == t.replace("▁", " ")
    assert own.young_bytes <= 20_000 + 300 * (2 * whole + 64)


def test_suffix_array_against_sorting():
    r = np.random.default_rng(2)
    for n, kinds, depth in [(0, 1, 4), (1, 1, 4), (200, 2, 16), (300, 40_000, 16), (150, 3, 5)]:
        codes = r.integers(0, kinds, n).astype(np.uint32)
        got = [tuple(codes[i : i + depth]) for i in pieces.suffix_array(codes, depth)]
        assert got == sorted(tuple(codes[i : i + depth]) for i in range(n))


def test_slices_cover_a_batch():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (k * 50_000 % 900_001) for k in range(50)])], names=["k", "t"])
    got = list(pieces.slices(batch, 1))
    assert [k for b in got for k in b.column(0).to_pylist()] == list(range(50))
    assert all(b.num_rows == 1 or sum(map(len, b.column(1).to_pylist())) <= pieces.TEXTS for b in got)
    assert list(pieces.slices(batch.slice(0, 0), 1)) == []
