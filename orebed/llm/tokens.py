"""Whole-text token ids from a public tokenizer file, with a memo over words.

The library encodes about one megabyte a second.  Vocabularies of two kinds
split a text at white space before any merge is applied, so that the ids of a
text are the ids of its words in order.  For these each worker process keeps a
bounded memo from a word (with the blank before it, where the vocabulary keeps
blanks) to its ids; the library encodes every word that the memo lacks.  Texts
whose white space could make a difference are given to the library whole, and
so are all texts where the file is of neither kind.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

import numpy as np

#: Bytes that the memo of one worker process takes at most.
MEMO_BYTES = 96 << 20
#: Misses of a full memo, for each word that it holds, after which it begins anew.
MEMO_PATIENCE = 4
#: ... and what an entry takes besides its characters and ids.
ENTRY_BYTES = 200
#: Longer words are encoded but not kept.
MEMO_WORD_CHARS = 48

#: White space other than the blank and the line feed, and separators on which
#: Python and the library differ; a text with any of them is cut with care.
_OTHER_BLANKS = re.compile("[\t\v\f\r\0\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: For a vocabulary that drops white space only the separators matter.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: The pre-token of a vocabulary that drops white space, as its file has it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters, then ASCII signs: two pre-tokens at most, whichever the vocabulary.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)\Z")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary, by its rule:
    printable Latin-1 bytes stand for themselves, the rest count up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """From a word to the bytes of its ids; a word that it lacks is encoded.

    When full it keeps what it has: the words met first are mostly the common
    ones.  It begins anew once it has missed often enough to be out of date.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.bytes = self.missed = 0

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= MEMO_WORD_CHARS:
            size = ENTRY_BYTES + len(word) + len(ids)
            if self.bytes + size <= MEMO_BYTES:
                self[word] = ids
                self.bytes += size
            else:
                self.missed += 1
                if self.missed > MEMO_PATIENCE * len(self):
                    self.clear()
                    self.bytes = self.missed = 0
        return ids


def _kind(file: dict) -> str | None:
    """How a tokenizer file may be cut at words: ``blanks`` keeps the blank before a word with it,
    ``words`` drops white space; None for any other file."""
    model = file.get("model", {})
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file.get("added_tokens", [])):
        return None
    before, shape = file.get("normalizer"), file.get("pre_tokenizer") or {}
    if before is None and shape.get("type") == "ByteLevel" and not shape["add_prefix_space"] and shape["use_regex"] and not model.get("end_of_word_suffix"):
        return "blanks"
    steps, parts = (before or {}).get("normalizers", []), shape.get("pretokenizers", [])
    if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"]:
        return None
    same = steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " " and parts[0]["pattern"] == {"Regex": WORD_PATTERN}
    same &= parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
    return "words" if same else None


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    ``path`` names a file for the ``tokenizers`` library.  Special strings
    inside texts are handled as the library does by default.  A null text
    counts as empty.  No begin or end token is added and nothing is cut.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.kind = _kind(json.load(f))
        self.drops_blanks = self.kind == "words"
        self.merge = self.library.model.tokenize
        self.letters = _byte_letters()
        self.memo = _Memo(self._word)

    def direct(self, text: str) -> bytes:
        """The library's ids of a text, without the memo."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        plain = _PLAIN.match(word)
        if plain is None:
            return self.direct(word)
        ids: list[int] = []
        for part in plain.groups():
            if part:
                part = part.lower() if self.drops_blanks else part
                part = part.encode().decode("latin-1").translate(self.letters)
                ids += [t.id for t in self.merge(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _words(self, text: str) -> list[str] | None:
        """The pieces whose ids can be joined, or None if the text must stay whole."""
        if self.drops_blanks:
            return None if _SEPARATORS.search(text) else text.split()
        pairs = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        if pairs or _OTHER_BLANKS.search(text):
            # Cut only before a blank that has no white space on either side.
            return re.split(r"(?<=[^\s\x1c-\x1f])(?= [^\s\x1c-\x1f])", text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = self._words(text) if self.kind else None
        return self.direct(text) if words is None else b"".join(map(self.memo.__getitem__, words))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a file; worker processes reuse it over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def version_digest(path: str) -> str:
    """Names a vocabulary file, the library's version and the options it is used with."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|tokenizers {tokenizers.__version__}|add_special_tokens=False".encode()).hexdigest()


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the files are never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)
