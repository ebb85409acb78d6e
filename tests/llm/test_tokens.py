"""Token ids against the library, text by text."""

import random
import re

import pytest

P = pytest.importorskip("public_tokenizers")
from tracefield.llm import tokens  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

USUAL = [chr(i) for i in range(0x2100) if not tokens.UNUSUAL.match(chr(i))]
ODD = ["İ", "̇", "K", "ΑΣ ", " ", "\x0b", " ", "<|endoftext|>", "\U0001f44d", "日本"]


def differing(kind: str, name: str, texts: list[str]) -> list[str]:
    library = Tokenizer.from_file(P.path(name))
    ids, lengths = tokens.encoder(P.path(name), kind)(texts)
    out, at = [], 0
    for text, n in zip(texts, lengths.tolist(), strict=True):
        if ids[at : at + n].tolist() != library.encode(text, add_special_tokens=False).ids:
            out.append(text)
        at += n
    return out


BOTH = pytest.mark.parametrize("kind, name", [("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")])


@BOTH
def test_every_usual_character_between_letters(kind, name):
    assert len(USUAL) > 400
    texts = [before + c + after for c in [*USUAL, *ODD] for before in ("ab", "a ", "1", "'") for after in ("cd", " c", "2", "'s")]
    assert differing(kind, name, texts) == []


@BOTH
def test_random_texts(kind, name):
    r = random.Random(11)
    pool = [*USUAL, *"etaoin shrdlu" * 20, *"  \n.,'" * 10]
    texts = ["".join(r.choices(pool, k=r.randrange(40))) for _ in range(9_000)]
    texts += ["".join(r.choices([*pool, *ODD * 5], k=r.randrange(60))) for _ in range(2_000)]
    texts = [re.sub("<\\|", "<", t) if r.random() < 0.5 else t for t in texts]
    assert differing(kind, name, texts) == []
