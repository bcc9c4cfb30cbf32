"""Encoders over public tokenizer files, used inside Python tasks.

An ``Encoder`` gives what the tokenizer's own library gives (``tokenizers``
for .json, ``sentencepiece`` for .model), without begin, end or added special
tokens. For tokenizers that drop white space before they look for tokens, no
token reaches across a blank or line feed; there each distinct word of a task
is encoded by the library once and remembered, up to ``MEMO`` words.

Most words are letters with ASCII marks behind them. Such a tokenizer always
cuts between the two, so both parts are remembered on their own, the letters
in lower case if the file lower-cases; new ones go through the library's model joined by blanks, and
the model's word-end mark tells them apart again.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: words remembered by one Python worker; a full memo is emptied
MEMO = 400_000

#: letters whose lower case and composed form are one letter each, then marks
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]*)").fullmatch
_LETTERS = [c for c in map(chr, range(0xC0, 0x100)) if c not in "\u00d7\u00f7"]


class _Memo(dict):
    """Word -> number; a new word gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.new = []
        self.sizes, self.begins, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, word):
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def put(self, sizes: np.ndarray, flat: np.ndarray):
        """Store the ids of the words noted since the last call."""
        self.begins = np.concatenate((self.begins, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, flat))
        self.new = []

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids of the numbered words, joined."""
        n = self.sizes[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.begins[at] - ends + n, n) + np.arange(total)]


def _drops_blanks(spec: dict) -> bool:
    """True if the file says: only per-character normalisation and white space
    mapping, then keep nothing but runs without white space."""
    norms = spec.get("normalizer") or {}
    norms = norms.get("normalizers", [norms] if norms else [])
    pres = spec.get("pre_tokenizer") or {}
    pres = pres.get("pretokenizers", [pres] if pres else [])
    plain = all(n["type"] in ("NFC", "Lowercase") or
                n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in norms)
    first = pres[0] if pres else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    runs = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    return plain and runs and " " not in pattern and pattern.endswith("[^\\s\\p{L}\\p{N}]+") and "\\s" not in pattern[:-16]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.path = path
        if path.endswith(".model"):
            import sentencepiece
            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.drops_blanks = False
        else:
            from tokenizers import Tokenizer
            self.sp, self.tok = None, Tokenizer.from_file(path)
            self.tok.no_truncation()
            self.tok.no_padding()
            with open(path) as f:
                spec = json.load(f)
            self.drops_blanks = _drops_blanks(spec)
            self._word_model(spec)
        self.words, self.parts = _Memo(), _Memo()

    def _word_model(self, spec: dict) -> None:
        """The library's model alone, for normalised letters already in the
        byte alphabet, if its tokens mark the ends of words."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        norms = spec.get("normalizer") or {}
        self.lowers = any(n["type"] == "Lowercase" for n in norms.get("normalizers", [norms] if norms else []))
        mark = spec["model"].get("end_of_word_suffix")
        pres = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.plain = None
        if self.drops_blanks and mark and len(pres) == 2 and pres[1]["type"] == "ByteLevel":
            self.plain = Tokenizer.from_file(self.path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.alphabet = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in _LETTERS})
            vocab = self.plain.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(mark)]] = True

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, normalised."""
        mapped = [w if w.isascii() else w.translate(self.alphabet) for w in words]
        texts = [" ".join(mapped[a:a + 500]) for a in range(0, len(mapped), 500)]
        got = [np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(got) if got else np.zeros(0, np.uint32)
        stops = np.flatnonzero(self.ends[flat]) + 1
        if len(stops) != len(words) or len(words) and stops[-1] != len(flat):
            return self._library(words)
        return np.diff(np.concatenate(([0], stops))), flat

    def _learn(self) -> None:
        """Encode the words noted since the last call."""
        new = self.words.new
        if not new:
            return
        if self.plain is None:
            self.words.put(*self._library(new))
            return
        if len(self.parts) > MEMO:
            self.parts = _Memo()
        at = np.empty((len(new), 2), np.int64)
        number = self.parts.__getitem__
        for i, w in enumerate(new):
            m = _PLAIN(w)
            at[i] = (number(m[1].lower() if self.lowers else m[1]), number(m[2])) if m else (number(w), number(""))
        parts = self.parts.new
        # a normalised word of letters in the parts may also have come whole: both readings agree
        kind = np.array([bool((m := _PLAIN(p)) and not m[2] and (p == p.lower() or not self.lowers)) for p in parts], bool)
        sizes, where = np.zeros(len(parts), np.int64), [np.flatnonzero(kind), np.flatnonzero(~kind)]
        made = [self._letters([parts[i] for i in where[0]]), self._library([parts[i] for i in where[1]])]
        for w, (n, _) in zip(where, made):
            sizes[w] = n
        flat = np.empty(int(sizes.sum()), np.uint32)
        begins = np.cumsum(sizes) - sizes
        for w, (n, ids) in zip(where, made):
            flat[np.repeat(begins[w] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        self.parts.put(sizes, flat)
        self.words.put(self.parts.sizes[at].sum(axis=1), self.parts.take(at.ravel()))

    def _numbers(self, text: str) -> np.ndarray:
        words = text.replace("\n", " ").split(" ")
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the first character of each token."""
        if self.sp:
            pieces = self.sp.encode(text, return_type="proto").pieces
            data = np.frombuffer(text.encode() + b" ", np.uint8)
            chars = np.cumsum((data & 0xC0) != 0x80) - 1  # the library counts bytes
            return np.array([p.id for p in pieces], np.uint32), chars[np.array([p.begin for p in pieces], np.int64)]
        e = self.tok.encode(text, add_special_tokens=False)
        return np.array(e.ids, np.uint32), np.array([a for a, _ in e.offsets], np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts."""
        if self.sp:
            return [np.array(x, np.uint32) for x in self.sp.encode(texts, num_threads=1)]
        if not self.drops_blanks:
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.words.take(at) for at in self._looked_up(texts)]

    def _looked_up(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > MEMO:
            self.words = _Memo()
        numbers = [self._numbers(t) for t in texts]
        self._learn()
        return numbers

    def counts(self, texts: list[str]) -> list[int]:
        """How many ids whole texts have."""
        if not self.drops_blanks:
            return [len(x) for x in self.ids(texts)]
        return [int(self.words.sizes[at].sum()) for at in self._looked_up(texts)]


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
