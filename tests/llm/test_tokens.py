"""Token counts, splicing and packing against the vocabulary's own library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.texts import LONG, ODD, documents, empty
from tipoff.llm.encoding import Encoder, read_vocabulary, splice, stable_boundary
from tipoff.llm.packing import Packer, hilbert_key, pack
from tipoff.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(*read_vocabulary(PATH))


HARD = [
    LONG, "x" * 5000, " " * 5000, "a  b   c \n\n d" * 300, "word " * 2000, "<|endoftext|>" * 400,
    "it's they'll <|endoftext|> we've wide no-break 日本語 " * 90, "\U0001f600 emoji é" * 300, "12345 6789 " * 400,
]


@pytest.mark.parametrize("text", HARD, ids=range(len(HARD)))
@pytest.mark.parametrize("chunk,overlap", [(64, 4), (257, 16), (1000, 300), (1 << 16, 1 << 9)])
def test_spliced_ids_are_those_of_the_whole_text(library, text, chunk, overlap):
    encode = lambda part: (lambda e: (e.ids, e.offsets))(library.encode(part, add_special_tokens=False))
    text = text[:40_000] if chunk < 2000 else text
    assert splice(encode, text, chunk, overlap) == library.encode(text, add_special_tokens=False).ids


def test_boundaries_need_visible_neighbours():
    assert stable_boundary("ab cd", 0, 5) == 2
    assert stable_boundary("ab  cd", 0, 6) is None
    assert stable_boundary(" ab", 0, 3) is None
    assert stable_boundary("ab ", 0, 3) is None


def test_ranked_form_gives_the_library_ids(library, encoder):
    texts = [t for t in ODD if t] + HARD
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder._fast is not None
    assert encoder.ids(texts) == want
    assert encoder.library_ids(texts, 500, 20) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    path = public_tokenizers.path(name)
    got = token_counts(documents(spark, extra=True), path, limit=5).collect()
    texts = [t or "" for t in ODD for _ in range(2)]
    if name.endswith("json"):
        tool = Tokenizer.from_file(path)
        want = [len(tool.encode(t, add_special_tokens=False).ids) for t in texts]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    assert sorted((r.doc_id, r.n_tokens, r.n_bytes, r.over_limit) for r in got) == sorted(
        (i // 2, n, len(t.encode()), n > 5) for i, (n, t) in enumerate(zip(want, texts))
    )
    assert token_counts(empty(spark), path).count() == 0


def test_hilbert_neighbours_touch():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = hilbert_key(points, bits=3)
    assert sorted(keys) == list(range(side**3))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_open_sequence_ends_in_powers_of_two():
    packer = Packer(16, 0)
    pieces = list(packer.add("a", np.arange(21, dtype="<u4"))) + list(packer.add("b", np.arange(6, dtype="<u4")))
    pieces += packer.finish()
    lengths = defaultdict(int)
    for p in pieces:
        lengths[p[5]] += p[2]
    assert list(lengths.values()) == [16, 8, 2, 1]
    assert list(packer.finish()) == []


@pytest.mark.parametrize("extra", [False, True])
def test_every_id_is_in_one_piece(spark, library, extra):
    rows = pack(documents(spark, extra=extra), PATH, length=64, with_ids=True).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in enumerate(ODD)}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        assert bytes(r.ids) == part.tobytes()
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, want in ids.items():  # each text is there twice
        covered = np.zeros(len(want), int)
        for start, length in seen[i]:
            covered[start:start + length] += 1
        assert (covered == 2).all()
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64 and end & (end - 1) == 0


def test_packing_nothing(spark):
    assert pack(empty(spark), PATH).count() == 0
