import random

import pytest

from lexiform.sources.sentencepiece import MARK, from_json

hf = pytest.importorskip("tokenizers")


def oracle(prepend):
    """A vocabulary of bytes, some characters and the merges of a few words, without the letter q."""
    vocab = {"<unk>": 0} | {f"<0x{b:02X}>": b + 1 for b in range(256)}
    for c in MARK + "abcdefghilmnorstuwé中":
        vocab.setdefault(c, len(vocab))
    merges = []
    for a, b in [("t", "h"), ("th", "e"), (MARK, "the"), ("i", "n"), ("in", "g"), (MARK, "a"), (MARK, MARK), (MARK + MARK, MARK + MARK), ("o", "r"), ("e", "r"), ("é", "中"), ("a", "n"), ("an", "d")]:
        vocab.setdefault(a + b, len(vocab))
        merges.append((a, b))
    t = hf.Tokenizer(hf.models.BPE(vocab, merges, unk_token="<unk>", byte_fallback=True))
    t.normalizer = hf.normalizers.Sequence(([hf.normalizers.Prepend(MARK)] if prepend else []) + [hf.normalizers.Replace(" ", MARK)])
    t.decoder = hf.decoders.Sequence([hf.decoders.Replace(MARK, " "), hf.decoders.ByteFallback(), hf.decoders.Fuse()] + ([hf.decoders.Strip(" ", 1, 0)] if prepend else []))
    return t


@pytest.mark.parametrize("prepend", [False, True])
def test_equals_oracle(prepend):
    t, rng = oracle(prepend), random.Random(1)
    mine = from_json(t.to_str())
    alphabet = ["the", "and", " ", "  ", "a", "ing", "é中", "é", "q", "🙂", "\n", "or", "er", "x"]
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30)))
        ids = t.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids, text
        assert mine.decode(ids) == t.decode(ids, skip_special_tokens=False) == text


def test_refusals():
    with pytest.raises(ValueError):
        from_json('{"model": {"type": "BPE", "vocab": {}, "merges": []}}')
    with pytest.raises(ValueError, match="normalizer"):
        from_json('{"model": {"type": "BPE", "byte_fallback": true, "vocab": {}}, "normalizer": {"type": "Precompiled"}}')


def test_character_map_equals_oracle():
    import sentencepiece

    from lexiform.functions.charsmap import CharsMap

    blob = charsmap(sentencepiece)
    mine, other, rng = CharsMap(blob), hf.normalizers.Precompiled(blob), random.Random(2)
    alphabet = ["a", "é", "é", "ﬁ", "①", "㍿", "　", "Å", "\u0000", "\t", "\r\n", "​", "한", "ᄒ", "ᅡ", "ᆫ", "🙂", "👨‍👩‍👧", "ﷺ", "½", "x", " ", "が"]
    for _ in range(2000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 12)))
        assert mine.normalize(t) == other.normalize_str(t), t
    with pytest.raises(ValueError):
        CharsMap(b"\xff\xff\x00\x00")


def charsmap(sentencepiece):
    """The map of a built-in rule: field 2 of the normalizer's part (field 3) of the model message."""
    data = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()

    def fields(b):
        at = 0

        def number():
            nonlocal at
            n = shift = 0
            while True:
                c = b[at]
                at += 1
                n |= (c & 127) << shift
                shift += 7
                if c < 128:
                    return n

        while at < len(b):
            key = number()
            if key & 7 == 2:
                n = number()
                at += n
                yield key >> 3, b[at - n : at]
            elif key & 7 == 0:
                yield key >> 3, number()
            else:
                at += 4 if key & 7 == 5 else 8

    norm = dict(fields(data))[3]
    return dict(fields(norm))[2]


@pytest.mark.parametrize("scheme", ["never", "first", "always"])
def test_added_tokens_and_metaspace_equal_oracle(scheme):
    t = oracle(False)
    t.normalizer = hf.normalizers.Sequence([hf.normalizers.Replace("é", "e")])
    t.pre_tokenizer = hf.pre_tokenizers.Metaspace(prepend_scheme=scheme, split=False)
    t.add_special_tokens([hf.AddedToken("<s>", special=True, normalized=False)])
    t.add_tokens([hf.AddedToken("<é>", normalized=True), hf.AddedToken("<r>", rstrip=True, normalized=False), hf.AddedToken("<l>", lstrip=True, normalized=False)])
    mine, rng = from_json(t.to_str()), random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["the", " ", "<s>", "<é>", "<e>", "<r>", "<l>", "and", "é", "  "]) for _ in range(rng.randrange(0, 9)))
        assert mine.encode(text) == t.encode(text, add_special_tokens=False).ids, text
    assert mine.decode(mine.encode("a<s>"), skip_special=True).strip() == "a"
