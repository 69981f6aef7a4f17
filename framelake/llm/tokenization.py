"""Byte-pair tokenizers read from a ``tokenizers`` JSON file, taken apart so that merging is done once per distinct piece.

A tokenizer first normalizes a text and cuts it into pre-tokens ("pieces"), which its model then encodes one by one.
``WordTokenizer`` does the first half exactly as the library does, with a short way for texts of plain characters;
``TextEncoder`` numbers the distinct pieces, has a ``PieceEncoder`` encode those not seen before, and puts ids together.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries that a worker keeps before it starts afresh; bounds its memory, changes no result.
CACHE_ENTRIES = 600_000

#: Texts of these characters are in composed form, and Python lower-cases them as the library does.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
#: A character that makes a text another than plain, as Arrow's expressions write it.
_NOT_PLAIN = r"[^\t-\r -~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]"
_PLAIN_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-zß-öø-ÿ0-9]+")
#: The same over many words, each on a line of its own.
_LINED_PIECES = re.compile(_PLAIN_PIECES.pattern + "|\n")
#: The split rule for which _PLAIN_PIECES stands.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level BPE uses for each byte: itself if visible, else the next free one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(256)
    return {b: chr(b if b in visible else next(spare)) for b in range(256)}


class WordTokenizer:
    """Splits texts into words and words into pieces, as the tokenizer in ``path`` does before it merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = spec["model"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._bytes = byte_alphabet()
        self.plain = self._is_known(spec)
        self.tokens = [""] * self.library.get_vocab_size(with_added_tokens=True)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.tokens[i] = token

    @staticmethod
    def _is_known(spec: dict) -> bool:
        """Whether _PLAIN_PIECES finds what the library would."""
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", ())]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", ())
        return (
            norm == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and (steps[0]["pattern"].get("Regex"), steps[0]["behavior"], steps[0]["invert"]) == (_KNOWN_SPLIT, "Removed", True)
            and not steps[1]["use_regex"]
            and not steps[1]["add_prefix_space"]
            and all("<|" in x["content"] for x in spec.get("added_tokens") or ())
        )

    def is_odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts (none null) are not plain, or may hold special tokens."""
        if not self.plain:
            return np.ones(len(texts), dtype=bool)
        odd = pc.or_(pc.match_substring_regex(texts, _NOT_PLAIN), pc.match_substring(texts, "<|"))
        return odd.to_numpy(zero_copy_only=False).astype(bool)

    def units(self, text: str) -> list[str | int]:
        """What a text is looked up by, in order: words of plain texts; else pieces behind a NUL, and ids of special tokens."""
        if self.plain and "<|" not in text and _PLAIN.fullmatch(text):
            return text.lower().split()
        out: list[str | int] = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                norm = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                out += ["\0" + p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)] if self.library.pre_tokenizer else ["\0" + norm]
        return out

    def spelled(self, piece: str) -> str:
        """A piece of a plain word in byte-level characters."""
        return piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._bytes)

    def pieces(self, unit: str) -> list[str]:
        """The pre-tokens of a unit that is no id, in byte-level characters."""
        return [unit[1:]] if unit[0] == "\0" else [self.spelled(p) for p in _PLAIN_PIECES.findall(unit)]

    def pieces_of_words(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pre-tokens of plain words, the number of each in turn, and which word it is of."""
        found = pa.array(_LINED_PIECES.findall("\n".join(words)), pa.string()).dictionary_encode()
        distinct, at = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        if "\n" not in distinct:
            return [self.spelled(p) for p in distinct], at, np.zeros(len(at), dtype=np.int64)
        line = distinct.index("\n")
        ends = at == line
        del distinct[line]
        return [self.spelled(p) for p in distinct], (at - (at > line))[~ends], np.cumsum(ends)[~ends]

    def decode(self, ids: Iterable[int]) -> str:
        """What the library's ``decode(ids, skip_special_tokens=False)`` returns; ids without a token add nothing."""
        if self.library.decoder is not None:
            return self.library.decode(list(map(int, ids)), skip_special_tokens=False)
        ids = list(ids)
        if ids and not (0 <= min(ids) and max(ids) < len(self.tokens)):
            ids = [i for i in ids if 0 <= i < len(self.tokens)]
        return " ".join(filter(None, map(self.tokens.__getitem__, ids)))


#: Turns distinct pieces into the little-endian 32-bit ids of each.
PieceEncoder = Callable[[list[str]], list[bytes]]


def library_encoder(tokenizer: WordTokenizer) -> PieceEncoder:
    """Pieces through the library's own model."""
    model = tokenizer.library.model

    def encode(pieces: list[str]) -> list[bytes]:
        found = [[t.id for t in model.tokenize(p)] for p in pieces]
        return _cut(np.fromiter(itertools.chain.from_iterable(found), dtype="<u4"), list(map(len, found)))

    return encode


def _cut(ids: np.ndarray, counts) -> list[bytes]:
    """Consecutive runs of ``counts`` ids each, as little-endian bytes."""
    data = ids.astype("<u4").tobytes()
    cut = [0, *(np.cumsum(counts) * 4).tolist()]
    return [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]


class _Codes(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def numbered_units(tokenizer: WordTokenizer, texts: pa.Array, number: Callable[[str | int], int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all units of texts (none null), one after another, and how many each text has.

    Each distinct word of the plain texts is numbered once; repeats are told apart in Arrow.
    """
    odd = tokenizer.is_odd(texts)
    words = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(pa.array(~odd)) if odd.any() else texts))
    flat = words.flatten().dictionary_encode()
    known = np.fromiter(map(number, flat.dictionary.to_numpy(zero_copy_only=False)), dtype=np.int64, count=len(flat.dictionary))
    plain = known[flat.indices.to_numpy()] if len(flat) else np.empty(0, dtype=np.int64)
    sizes = np.diff(words.offsets.to_numpy())
    if not odd.any():
        return plain, sizes
    counts = np.zeros(len(texts), dtype=np.int64)
    counts[~odd] = sizes
    others = []
    for i in np.flatnonzero(odd).tolist():
        units = tokenizer.units(texts[i].as_py())
        counts[i] = len(units)
        others.append(np.fromiter(map(number, units), dtype=np.int64, count=len(units)))
    out = np.empty(int(counts.sum()), dtype=np.int64)
    of_odd = np.repeat(odd, counts)
    out[of_odd] = np.concatenate(others)
    out[~of_odd] = plain
    return out, counts


class TextEncoder:
    """Ids of whole texts, with each distinct piece encoded once per worker (until the table is full)."""

    def __init__(self, tokenizer: WordTokenizer, encode: PieceEncoder, entries: int = CACHE_ENTRIES):
        self.tokenizer, self._encode, self._entries = tokenizer, encode, entries
        self._clear()

    def _clear(self) -> None:
        self._codes = _Codes()
        self._table, self._ends = np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64)  # ids of all units, and where each unit's end

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of all texts (none null), one after another, and where each text's end."""
        if len(self._codes) > self._entries:
            self._clear()
        gc.disable()  # hundreds of thousands of small live objects, none in a cycle
        try:
            numbers, counts = numbered_units(self.tokenizer, texts, self._codes.__getitem__)
            self._learn()
        finally:
            gc.enable()
        starts, sizes = self._ends[:-1][numbers], np.diff(self._ends)[numbers]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        return self._table[spread(starts, sizes)], upto[np.cumsum(counts)]

    def ids(self, texts: list[str]) -> Iterable[bytes]:
        """Little-endian 32-bit ids of each text, in order."""
        flat, ends = self.coded(pa.array(texts, pa.string()))
        data, at = flat.tobytes(), 0
        for end in (ends * 4).tolist():
            yield data[at:end]
            at = end

    def _learn(self) -> None:
        """Put all numbered units in the table."""
        done = len(self._ends) - 1
        if done == len(self._codes):
            return
        new = list(itertools.islice(self._codes, done, None))
        is_word = np.fromiter((isinstance(u, str) and u[:1] not in ("", "\0") for u in new), dtype=bool, count=len(new))
        pieces, at, of = self.tokenizer.pieces_of_words([u for u, word in zip(new, is_word.tolist(), strict=True) if word])
        rest = [u for u, word in zip(new, is_word.tolist(), strict=True) if not word]  # special tokens, pieces of odd texts and nothing
        odd = [u[1:] for u in rest if isinstance(u, str) and u]
        coded = self._encode(pieces + odd)
        held = iter(coded[len(pieces) :])
        others = [b"" if u == "" else u.to_bytes(4, "little") if isinstance(u, int) else next(held) for u in rest]
        counts = np.zeros(len(new), dtype=np.int64)
        counts[~is_word] = [len(x) // 4 for x in others]
        ids, starts, sizes = _joined(coded[: len(pieces)])
        counts[is_word] = np.bincount(of, sizes[at], minlength=int(is_word.sum())).astype(np.int64)
        flat = np.empty(int(counts.sum()), dtype="<u4")
        word_ids = np.repeat(is_word, counts)
        flat[word_ids] = ids[spread(starts[at], sizes[at])]
        flat[~word_ids] = np.frombuffer(b"".join(others), dtype="<u4")
        self._table = np.concatenate((self._table, flat))
        self._ends = np.concatenate((self._ends, self._ends[-1] + np.cumsum(counts)))


def _joined(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all, where each begins, and how many it has."""
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4
    return np.frombuffer(b"".join(coded), dtype="<u4"), np.cumsum(sizes) - sizes, sizes


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of ``sizes``, one run after another."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return at


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file."""
    return WordTokenizer(path)


@functools.lru_cache(maxsize=2)
def library_text_encoder(path: str) -> TextEncoder:
    t = word_tokenizer(path)
    return TextEncoder(t, library_encoder(t))
