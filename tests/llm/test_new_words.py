"""What encoders do with words they have not met: as the libraries, and at a cost that does not grow with what they remember."""

import os
import random

import numpy as np
import public_tokenizers

from stagewise.llm import align, bpe, tokenfile

RANKS, PATTERN, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Looked(dict):
    """A memory that may be asked for words, but not walked."""

    def walked(self, *_):
        raise AssertionError("the memory was walked through")

    __iter__ = keys = items = values = walked


def made_up(n, letters, signs, longest=14):
    rng = random.Random(n)
    return ["".join(rng.choices(letters, k=rng.randrange(1, longest))) + "".join(rng.choices(signs, k=rng.choice((0, 0, 1, 3)) if signs else 0)) for _ in range(n)]


def test_token_files_words_are_looked_up_not_walked():
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(WORDS), tokenfile.WordIds(WORDS)
    ids.known = Looked()
    texts = [" ".join(made_up(n, "abcdefghijklmnopqrstuvwxyzéèçñüßµªÿ", ".,%$'<>")) for n in (1, 700, 2000, 5000)]
    for _ in range(2):
        for text, got in zip(texts, ids.encode(texts), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_words_written_one_after_another_keep_their_ids():
    """Words of letters are encoded many at a time; each has the ids of the tokenizer's model."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    t, ids = Tokenizer.from_file(WORDS), tokenfile.WordIds(WORDS)
    words = sorted({w.encode() for w in made_up(4000, "etaoinshrdluéßÿ", "", 40)})
    spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    for n in (0, 1, tokenfile.TOGETHER, tokenfile.TOGETHER + 1, len(words)):
        want = [[x.id for x in t.model.tokenize(spell(w.decode())[0][0])] for w in words[:n]]
        assert [np.frombuffer(x, "<u2").tolist() for x in ids.of_letters(words[:n])] == want


def test_models_with_other_marks_are_not_respelt():
    ids = tokenfile.WordIds(WORDS)
    model = {"type": "BPE", "vocab": {"a": 0, "a</w>": 1}, "merges": [], "end_of_word_suffix": "</w>"}
    for change in ({}, {"end_of_word_suffix": None}, {"type": "WordLevel"}, {"dropout": 0.1}, {"ignore_merges": True}):
        assert ids.spell(model | change) is None


def test_bpe_looks_words_up_and_contracts_as_tiktoken():
    """Short words of every size up to the bound, of few letters, of awkward bytes, and of pieces whose parts rank after the whole."""
    import tiktoken

    ranks = bpe.load_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    late = [t.decode() for t, r in ranks.items() if t.isalpha() and t.isascii() and any(t[:i] in ranks and t[i:] in ranks and max(ranks[t[:i]], ranks[t[i:]]) > r for i in range(1, len(t)))]
    rng = random.Random(4)
    words = ["".join(rng.choices(a, k=rng.randrange(1, bpe.LONG + 2))) for a in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "aéñ", "日本語", "%$#") for _ in range(150)]
    words += ["".join(rng.choices(late, k=rng.randrange(2, 9))) for _ in range(600)] + [" " + w for w in made_up(600, "etaoinsh", "")]
    words += ["a" * n for n in range(1, bpe.LONG + 3)]
    b = bpe.Bpe(ranks, PATTERN)
    b.known = Looked()
    want = [enc.encode_ordinary(w) for w in words]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in b.encode(words)] == want
    ids = [np.array(x, "<u4").tobytes() for x in want]
    assert b.decode(ids) == [w.encode() for w in words]
    assert b.decode([]) == [] and b.decode([b"", ids[0], b""]) == [b"", words[0].encode(), b""] and b.decode([b""]) == [b""]
    assert b.encode([]) == [] and b.encode(["", ""]) == [b"", b""]


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_aligned_pieces_are_encoded_many_at_a_time_by_one_thread():
    """What comes of them is what comes of whole texts, those included that the second tokenizer does not give back."""
    both, whole = align.Aligner(BYTES, PIECES), align.Aligner(BYTES, PIECES)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    both.first, whole.cuts = Counted(both.first), False
    rng = random.Random(12)
    words = made_up(3000, "etaoinshé日", ".,\n")
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 90))) for _ in range(250)]
    both.texts(texts)
    assert both.first.texts < len(both.number) / 20
    awkward = [*words[:40], "", " ", "\t", "\x00", "▁", "ﬁ", "é", "a  b", " x", "x　", " y", "z ", "<s>", "\x85"]
    texts += ["", " ", "  ", " a", "a ", "a  b", "a \nb", "a\n b", "a 　b", "▁ a"]
    texts += [" ".join(rng.choices(awkward, k=rng.randrange(1, 9))) for _ in range(600)]
    got, want = both.texts(texts), whole.texts(texts)
    assert None in got.groups[250:] and got.groups == want.groups
    for x, y in zip(got, want, strict=True):
        assert np.array_equal(x, y) or x == want.groups
    assert [both.pieces(t) for t in texts] == [align.CUT.split(t) for t in texts]
