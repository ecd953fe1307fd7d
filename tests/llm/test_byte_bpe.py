import hashlib
import random

import pytest

from spotlake.llm.byte_bpe import ByteBpe, round_trips

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
PIECES = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", " ", "  ", "\n", "\t", "a", "é", "ß", "漢", "1", "²", "٣", "!", "...", "-----", "<|endoftext|>", "\x1c", "😀", " the", "aaaaaaa", "S", "'S", "\r\n", "_", "ſ", "\0", "Ⅷ"]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


def test_like_the_library(library):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", "a" * 5000, "-" * 3001]
    bpe = ByteBpe(PATH)
    for text, ids, (said, back) in zip(texts, ByteBpe(PATH).encode(texts), bpe.round_trip(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and said == ",".join(map(str, want))
        assert back.decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False) == bpe.decode(want)


def test_one_instance_for_both():
    bpe = ByteBpe(PATH)
    (said, _), ids = next(bpe.round_trip(["hello there"])), bpe.encode(["hello there"])[0]
    assert said == ",".join(map(str, ids.tolist()))
    bpe = ByteBpe(PATH)
    assert bpe.encode(["hello there"])[0].tolist() == ids.tolist() and next(bpe.round_trip(["hello there"]))[0] == said


def test_rows(odd, none, library):
    got = round_trips(odd, PATH).collect()
    assert len(got) == odd.count() and round_trips(none, PATH).count() == 0
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].n_tokens == by_id[2].n_tokens == 0
    for i, text in ((5, "x" * 200_000), (6, "lorem ipsum " * 30_000), (8, "é漢字 😀 ½ token=abcdefgh12")):
        want = library.encode(text, add_special_tokens=False).ids
        assert by_id[i].n_tokens == len(want) and by_id[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert by_id[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
