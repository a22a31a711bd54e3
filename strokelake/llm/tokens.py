"""Token ids of whole texts by a public tokenizer file.

Ids come from the ``tokenizers`` library. Its vocabulary models work word by word, so each task encodes
a word once and keeps its ids: a text is the concatenation of its words' ids. Texts are cut only where
both pre-tokenizers always cut (before a single space, around a single line end); any text with other
white space is cut at fewer places, and what is left between cuts goes to the library as it stands.

Words are cut, made distinct and looked up by Arrow, ids are gathered by numpy, so no word costs a step of Python; known words
take about 40 bytes each. New plain words of a byte-level vocabulary go to the library's model without the pre-tokenizer,
where no token of the vocabulary can reach across the space between two words.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept per generation and worker process. A full generation becomes the old one, from which words still in use move on;
#: so memory is bounded whatever the corpus holds.
STORE_LIMIT = 80_000
RAW = "\0"
#: White space other than single spaces and single line ends between words, and ``RAW``.
ODD = r"[\x00\t\r\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|  | \n|\n[ \n]| $"
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
TAILS = ".,;:"
LETTERS = "[A-Za-zªµºÀ-ÖØ-öø-ÿ]+"
PLAIN = f"^{LETTERS}[.,;:]?$"
HEADED = f"^[\\x00\n]{LETTERS}[.,;:]?$"
ALONE = f"^\\x00{LETTERS}$"
#: Words that the model gets in one call where no token reaches from one to the next.
TOGETHER = 64
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, special_as_text: bool = False) -> "Encoder":
    """One encoder per worker process, file and treatment of the special tokens' strings in texts."""
    key = path, special_as_text
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = special_as_text
        shape = json.loads(self.tool.to_str())
        self.special = tuple(t["content"] for t in shape.get("added_tokens", []))
        pre = shape.get("pre_tokenizer") or {}
        vocab = self.tool.get_vocab()
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not shape.get("normalizer"):
            self.kind, mark = "spaced", lambda t: t.startswith("Ġ")
        elif json.dumps(pre).count('"Removed"') and shape["model"].get("end_of_word_suffix") == "</w>":
            self.kind, mark = "words", lambda t: t.endswith("</w>")
        else:
            self.kind, mark = "whole", lambda t: False
        #: ids that begin (spaced) or end (words) a word
        self.edge = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, i in vocab.items():
            self.edge[i] = mark(token)
        self.bare = Tokenizer(self.tool.model) if self.kind == "spaced" and _words_stay_apart(vocab) else None
        self.limit = STORE_LIMIT
        self.store = self.old = Known()

    def raw(self, pieces: list[str]) -> list[bytes]:
        found = self.tool.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole" or not texts:
            return self.raw(texts)
        words, ends = self._cut(texts)
        distinct = words.dictionary_encode()
        ids, sizes = gathered(*self._word_ids(distinct.dictionary), distinct.indices.to_numpy())
        edges = (4 * np.append(0, np.cumsum(sizes))[ends]).tolist()
        out = ids.tobytes()
        return [out[a:b] for a, b in zip([0, *edges], edges)]

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, one after the other, and the number of words up to the end of each text."""
        if self.kind == "words":
            lists = pc.split_pattern(pa.array([self._prepared(t) for t in texts], pa.large_string()), " ")
            return lists.flatten(), lists.offsets.to_numpy()[1:]
        plain = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(plain, ODD)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(plain, token))
        plain = plain.filter(pc.invert(odd))
        lists = pc.split_pattern(_after_raw(pc.replace_substring(plain, "\n", " \n")), " ")
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(odd):
            return lists.flatten(), lists.offsets.to_numpy()[1:]
        cut = [[RAW + piece for piece in SAFE_CUT.split(texts[i])] for i in odd]
        ready = np.delete(np.arange(len(texts)), odd)
        sizes = np.zeros(len(texts), np.int64)
        sizes[ready] = np.diff(lists.offsets.to_numpy())
        sizes[odd] = [len(c) for c in cut]
        words = pa.concat_arrays([lists.flatten(), pa.array(list(chain.from_iterable(cut)), pa.large_string())])
        owner = np.concatenate([np.repeat(ready, sizes[ready]), np.repeat(odd, sizes[odd])])
        return words.take(pa.array(np.argsort(owner, kind="stable"))), np.cumsum(sizes)

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has.

        A plain word is looked up without the mark behind it and, where it stands behind a line end, without that.
        """
        plain = pc.match_substring_regex(words, PLAIN)
        bare, head = words, np.zeros(len(words), bool)
        if self.bare is not None:
            headed = pc.match_substring_regex(words, HEADED)
            head = pc.and_(headed, pc.starts_with(words, "\n")).to_numpy(zero_copy_only=False)
            plain = pc.or_(plain, headed)
            bare = pc.if_else(headed, _after_raw(pc.utf8_slice_codeunits(words, 1)), words)
        tail = pc.if_else(plain, pc.index_in(pc.utf8_slice_codeunits(words, -1), pa.array(list(TAILS), words.type)), None)
        keys = pc.if_else(plain, pc.ascii_rtrim(bare, TAILS), bare).dictionary_encode()
        found = self._looked_up(keys.dictionary)
        more, extra = _flat(self.raw(["\n", *TAILS]))
        n = len(found.sizes)
        sizes = np.concatenate([found.sizes, extra, [0]])
        none = len(sizes) - 1
        tail = tail.fill_null(none - n - 1).to_numpy(zero_copy_only=False).astype(np.int64) + n + 1
        parts = np.stack([np.where(head, n, none), keys.indices.to_numpy(), tail], 1)
        ids, sizes = gathered(np.concatenate([found.ids, more]), sizes, parts.ravel())
        return ids, sizes.reshape(-1, 3).sum(1)

    def _looked_up(self, words: pa.Array) -> "Known":
        """``words`` with their ids, from the store or learnt; the store then has them."""
        if len(self.store.words) > self.limit:
            self.old, self.store = self.store, Known()
        at = pc.index_in(words, self.store.words)
        missing = pc.is_null(at)
        new = words.filter(missing)
        if len(new):
            before = pc.index_in(new, self.old.words)
            moved = self.old.taken(before.drop_null().to_numpy())
            self.store = self.store.and_also(moved).and_also(self._learnt(new.filter(pc.is_null(before))))
            at = pc.index_in(words, self.store.words)
        return self.store.taken(at.to_numpy())

    def _prepared(self, text: str) -> str:
        """Words between spaces; lower-cased first where that is the same letter by letter."""
        if text.isascii() or _latin(text):
            if not any(s in text for s in self.special):
                text = text.lower()
        return text.replace("\n", " ")

    def _learnt(self, new: pa.Array) -> "Known":
        """Words that are not stored: plain words joined in a few calls, the rest one by one.

        Where texts are cut before spaces, a word stands for itself behind one; ``RAW`` and a piece: the piece as it is. A line end
        and a word: both, without a space.
        """
        plain = pc.match_substring_regex(new, PLAIN)
        words, new = new.filter(plain), new.filter(pc.invert(plain))
        out = Known()
        if self.bare is not None:
            alone = pc.match_substring_regex(new, ALONE)
            first, new = new.filter(alone), new.filter(pc.invert(alone))
            if len(first):
                found = self._without_space([w[1:] for w in first.to_pylist()])
                out = out.and_also(Known(first, np.concatenate(found), np.array([len(f) for f in found])))
        spaced = self.kind == "spaced"
        whole = [w if not spaced or w[:1] == "\n" else w[1:] if w[:1] == RAW else " " + w for w in new.to_pylist()]
        out = out.and_also(Known(new, *_flat(self.raw(whole))))
        for at in range(0, len(words), 20_000):
            out = out.and_also(self._learnt_plain(words.slice(at, 20_000)))
        return out

    def _without_space(self, runs: list[str]) -> list[np.ndarray]:
        """Ids by the model alone of plain words, joined by spaces or single."""
        runs = "\n".join(runs).encode().decode("latin-1").translate(BYTE_LEVEL).split(BYTE_LEVEL[10])
        return [np.asarray(e.ids, "<u4") for e in self.bare.encode_batch_fast(runs, add_special_tokens=False)]

    def _learnt_plain(self, words: pa.Array) -> "Known":
        ids = self._joined(words)
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):  # a word that the vocabulary treats otherwise: no shortcut
            lead = " " if self.kind == "spaced" else ""
            return Known(words, *_flat(self.raw([lead + w for w in words.to_pylist()])))
        cuts = np.append(edges, len(ids)) if self.kind == "spaced" else np.append(0, edges + 1)
        return Known(words, ids, np.diff(cuts))

    def _joined(self, words: pa.Array) -> np.ndarray:
        """Ids of the words with a space before each."""
        each = len(words) if self.bare is None else TOGETHER
        edges = pa.array([*range(0, len(words), each), len(words)], pa.int32())
        runs = [" " + run for run in pc.binary_join(pa.ListArray.from_arrays(edges, words.cast(pa.string())), " ").to_pylist()]
        if self.bare is None:
            return np.frombuffer(self.raw(runs)[0], "<u4")
        return np.concatenate(self._without_space(runs))


class Known:
    """Words with their ids, which stand one after the other."""

    def __init__(self, words: pa.Array | None = None, ids: np.ndarray | None = None, sizes: np.ndarray | None = None):
        self.words = pa.array([], pa.large_string()) if words is None else words
        self.ids = np.zeros(0, "<u4") if ids is None else ids
        self.sizes = np.zeros(0, np.int32) if sizes is None else sizes.astype(np.int32)

    def and_also(self, more: "Known") -> "Known":
        return Known(pa.concat_arrays([self.words, more.words]), np.concatenate([self.ids, more.ids]), np.concatenate([self.sizes, more.sizes]))

    def taken(self, at: np.ndarray) -> "Known":
        return Known(self.words.take(pa.array(at, pa.int64())), *gathered(self.ids, self.sizes, at))


def gathered(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of ``ids``, where runs of ``sizes`` follow each other: their ids one after the other, and their sizes."""
    starts = np.cumsum(sizes) - sizes
    sizes = sizes[at]
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    kind = np.int32 if max(len(ids), total) < 1 << 31 else np.int64
    places = np.repeat((starts[at] - (stops - sizes)).astype(kind), sizes)
    places += np.arange(total, dtype=kind)
    return ids[places], sizes


def _after_raw(texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(RAW, texts.type), texts, pa.scalar("", texts.type))


def _flat(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], np.int32)


def _byte_level() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LEVEL = _byte_level()
LEVEL_BYTES = {letter: byte for byte, letter in BYTE_LEVEL.items()}


def _words_stay_apart(vocab: dict[str, int]) -> bool:
    """Whether no token holds a space behind what may be the end of a plain word."""
    space = BYTE_LEVEL[32]
    for token in vocab:
        at = token.find(space, 1)
        while at > 0:
            before = bytes(LEVEL_BYTES.get(c, 0xFF) for c in token[:at]).decode("utf-8", "replace")[-1]
            if before.isalpha() or before == "\ufffd":
                return False
            at = token.find(space, at + 1)
    return True


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def encode_texts(texts: list[str], path: str, end_id: int | None, special_as_text: bool = False, stored: int = STORE_LIMIT) -> list[bytes]:
    """Ids of each text as bytes, with the end id appended. ``stored`` bounds the words kept per generation (about 40 bytes each)."""
    tail = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
    own = encoder(path, special_as_text)
    own.limit = stored
    return [ids + tail for ids in own.encode(texts)]


def release_encoders() -> None:
    """Forget the encoders of this worker process; tasks that do not encode call it, since workers are reused."""
    _ENCODERS.clear()
