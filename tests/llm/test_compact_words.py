"""Words by Arrow, plain words without the pre-tokenizer, Re-Pair on narrow and wide ids."""

import random

import numpy as np
import pytest

from strokelake.llm import grammar, tokens

LETTERS = "abcdefghijklmnopqrstuvwxyzéñ"
BITS = ["Wörd", "foo,", "  ", "\n", "\n\n", " ", "\t", "x1", "don't", "<|endoftext|>", "日本", "\xa0", "a.b", "\x00", "naïve.", "\r", "...", ":;", "İ", "ß", "　", "µ", "ª"]


def library(own, texts):
    return [np.asarray(own.tool.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_plain_words_cost_neither_python_steps_nor_the_pre_tokenizer(monkeypatch):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice(LETTERS) for _ in range(rng.randint(3, 12))) for _ in range(5000)})
    texts = [" ".join(words[:2500]), "\n".join(w.title() for w in words[2500:]), ", ".join(words[::-1])]
    own = tokens.Encoder(tokens.default_path("byte_bpe_50k.json"))
    want = library(own, texts)
    sent, raw = [], own.raw
    monkeypatch.setattr(own, "raw", lambda pieces: sent.extend(pieces) or raw(pieces))
    assert own.encode(texts) == want
    assert len("".join(sent)) < 100
    known = own.store
    assert len(known.words) > 5000 and known.words.nbytes + known.ids.nbytes + known.sizes.nbytes < 60 * len(known.words)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("special", [False, True])
def test_odd_texts_equal_the_library(name, special):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += ["".join(rng.choice(["Foo", "bar,", "É.", "\n", " ", "x;", " "]) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    own = tokens.Encoder(tokens.default_path(name), special)
    own.limit = 300  # words change generations
    want = library(own, texts)
    got = [ids for at in range(0, len(texts), 100) for ids in own.encode(texts[at : at + 100])]
    assert got == want


def test_tokens_across_words_forbid_the_shortcut():
    assert tokens._words_stay_apart({"Ġa": 0, "ĠĠ": 1, "ĠÂłĠÂł": 2, "ĊĠ": 3})
    assert not tokens._words_stay_apart({"aĠb": 0})
    assert not tokens._words_stay_apart({"ÃłĠ": 0})


@pytest.mark.parametrize("lift", [0, 1 << 20])
def test_narrow_and_wide_ids_make_one_grammar(lift):
    rng = np.random.default_rng(2)
    docs = [(rng.integers(0, 6, rng.integers(0, 90)) + lift).astype("<u4").tobytes() for _ in range(60)]
    shard = grammar.Shard(grammar.encode_shard(docs, least=4, most_rules=500))
    assert shard.documents() == docs and len(shard.rules) > 10
    assert [shard.document(i).astype("<u4").tobytes() for i in range(len(docs))] == docs
    assert shard.sizes().tolist() == [len(d) // 4 for d in docs]
