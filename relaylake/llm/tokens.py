"""Token ids of whole texts, equal to the public tokenizers library's.

Both vocabularies cut a text into pre-tokens before any merge. The merges
themselves run in tiktoken, which applies the same ranked merges several times
faster; it is used only for characters whose class and case are the same in
every Unicode version (up to U+024F). All other parts, and those with a special
token's string, go to the tokenizers library itself.

The word vocabulary drops white space, and a piece ends where its characters'
class changes. So the pieces of all texts of a slice are found in arrays, and
tiktoken encodes those that the worker hasn't met, each with a mark at its end,
in one call. Texts with other characters are cut at white space, each distinct word encoded
once per worker.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa

_ODD = re.compile("[^\x00-ɏ]|<\\|")
# Characters that str.split() takes for white space and the library doesn't.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a printable Latin-1
    byte stands for itself, the others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _vocabulary(path: str) -> tuple[dict[str, int], set[str]]:
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    return whole["model"]["vocab"], {t["content"] for t in whole["added_tokens"]}


BLANK, LETTER, NUMBER, OTHER = range(4)
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_CLASSES = 0x2C70  # lower-casing characters up to U+024F gives none from here on


def character_classes() -> np.ndarray:
    import regex

    kinds = [regex.compile(x).match for x in (r"\s", r"\p{L}", r"\p{N}")]
    return np.array([next((k for k, fits in enumerate(kinds) if fits(chr(c))), OTHER) for c in range(_CLASSES)], dtype=np.uint8)


def piece_ends(chars: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which characters are the last of a piece of ``PIECES``; the last
    character is blank."""
    last = np.empty(len(chars), dtype=bool)
    last[-1] = False
    np.not_equal(kind[1:], kind[:-1], out=last[:-1])
    last |= kind == NUMBER
    last &= kind != BLANK
    # 's, 're …: from an apostrophe that begins a piece
    at = np.flatnonzero(chars == 0x27)
    at = at[(at == 0) | (kind[at - 1] != OTHER)]
    next_, after = chars[at + 1], chars[np.minimum(at + 2, len(chars) - 1)]
    n = np.isin(next_, [ord(c) for c in "stmd"]).astype(np.int64)
    for a, b in ("re", "ve", "ll"):
        n[(next_ == ord(a)) & (after == ord(b))] = 2
    at, n = at[n > 0], n[n > 0]
    last[at] = False
    last[at + n] = True
    return last


class WordEncoder:
    """Ids (little-endian unsigned 32 bit) under a lower-casing word vocabulary
    with word ends (``word_bpe_49k.json``)."""

    END = b"\xff"  # never part of UTF-8; stands for the mark of a word's end
    PIECE, NEXT = "\x01", "\x02"  # marks; texts that have them are encoded by words

    def __init__(self, path: str, max_words: int = 500_000):
        import regex
        import tiktoken

        self.tokenizer = load_tokenizer(path)
        vocab, special = _vocabulary(path)
        letters = byte_letters()
        ranks = {}
        for token, rank in vocab.items():
            if token not in special:
                ended = token.endswith("</w>")
                body = bytes(letters[c] for c in (token[:-4] if ended else token))
                ranks[body + self.END * ended] = rank
        # ranks of pairs (byte, end) must come before all merges, as they do here
        self.merge = tiktoken.Encoding("words", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(PIECES).findall
        piece, following = self.PIECE.encode(), self.NEXT.encode()
        self.next_id = max(vocab.values()) + 1
        marked = {t.replace(self.END, piece): r for t, r in ranks.items() if piece not in t and following not in t}
        self.distinct = tiktoken.Encoding("pieces", pat_str=r"[^\x01]+\x01|\x02", mergeable_ranks=marked | {following: self.next_id}, special_tokens={})
        self.by_words = re.compile(f"{_ODD.pattern}|[{self.PIECE}{self.NEXT}]").search
        self.kinds = character_classes()
        self._forget()
        self.max_words = max_words
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, by the merges alone where the characters allow."""
        known, merge, end = self.known, self.merge, self.END
        if _ODD.search(" ".join(words)):
            rest = [w for w in words if _ODD.search(w)]
            words = [w for w in words if not _ODD.search(w)]
            for i in range(0, len(rest), 10_000):
                known.update(zip(rest[i:i + 10_000], self._library(rest[i:i + 10_000])))
        for word in words:
            lower = word.lower()
            if lower.isalpha():
                known[word] = array("I", merge(lower.encode() + end)).tobytes()
            else:
                known[word] = array("I", [i for piece in self.pieces(lower) for i in merge(piece.encode() + end)]).tobytes()

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        """One ``bytes`` of ids for each whole text."""
        if not texts:
            return []
        joined = "".join(x + self.NEXT for x in texts)
        plain = joined.isascii() or int(np.frombuffer(joined.encode("utf-32-le"), np.uint32).max()) < 0x250
        if plain and joined.count(self.NEXT) == len(texts) and self.PIECE not in joined and "<|" not in joined:
            return self._ids_by_pieces(joined)
        odd = {i for i, x in enumerate(texts) if self.by_words(x)}
        by_words = iter(self._ids_by_words([texts[i] for i in sorted(odd)]))
        others = iter(self._ids_by_pieces("".join(x + self.NEXT for i, x in enumerate(texts) if i not in odd)))
        return [next(by_words if i in odd else others) for i in range(len(texts))]

    def _ids_by_pieces(self, texts: str) -> list[bytes]:
        """Of texts that each end with ``NEXT``."""
        chars = np.frombuffer(texts.lower().encode("utf-32-le"), np.uint32)
        text_ends = np.flatnonzero(chars == ord(self.NEXT))
        kind = self.kinds[chars]
        kind[text_ends] = BLANK
        last = piece_ends(chars, kind) if len(chars) else np.empty(0, dtype=bool)
        first = np.append(0, np.searchsorted(np.flatnonzero(last), text_ends))  # pieces before each text
        inside = kind != BLANK
        packed = chars[inside]
        width = 1 + (packed >= 0x80) + (packed >= 0x800)
        ends = np.append(0, np.cumsum(width, dtype=np.int64)[last[inside]])
        data = packed.tobytes().decode("utf-32-le").encode()
        coded = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        place = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        start = self.starts[place]
        n = self.starts[place + 1] - start
        at = np.append(0, np.cumsum(n))
        out = self.met_ids[np.repeat(start - at[:-1], n) + np.arange(at[-1])]
        return [out[a:b].tobytes() for a, b in zip(at[first[:-1]].tolist(), at[first[1:]].tolist())]

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Each distinct piece's place among those met: its ids are
        ``met_ids[starts[place]:starts[place + 1]]``."""
        if len(self.met) > self.max_words:
            self._forget()
        place = np.fromiter(map(self.met.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            place[new] = np.arange(len(self.met), len(self.met) + len(new))
            self.met.update(zip(fresh, place[new].tolist()))
            ids = self.distinct.encode_to_numpy("".join(x + self.PIECE + self.NEXT for x in fresh), disallowed_special=()).astype("<u4")
            stops = np.flatnonzero(ids == self.next_id)
            self.starts = np.append(self.starts, self.starts[-1] + stops - np.arange(len(stops)))  # without the marks before
            self.met_ids = np.append(self.met_ids, ids[ids != self.next_id])
        return place

    def _forget(self) -> None:
        self.met: dict[str, int] = {}
        self.met_ids, self.starts = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _ids_by_words(self, texts: Sequence[str]) -> list[bytes]:
        if len(self.known) > self.max_words:
            self.known.clear()
        known = self.known
        cut = [[x] if _SEPARATORS.search(x) else x.split() for x in texts]
        new = set().union(*cut).difference(known)
        if new:
            self._learn(list(new))
        return [b"".join(map(known.__getitem__, words)) for words in cut]


class ByteCounter:
    """Numbers of tokens under a byte-level vocabulary (``byte_bpe_50k.json``),
    strings of special tokens handled as the library's default."""

    def __init__(self, path: str):
        import tiktoken

        self.tokenizer = load_tokenizer(path)
        vocab, special = _vocabulary(path)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): r for t, r in vocab.items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.special = max((len(s) for s in special), default=0)
        self.plain = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def counts(self, texts: Sequence[str]) -> list[int]:
        out = [-1 if _ODD.search(x) else len(self.plain(x)) for x in texts]
        odd = [i for i, n in enumerate(out) if n < 0]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)):
            out[i] = len(e)
        return out
