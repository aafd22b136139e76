"""Token ids of whole texts, piece by piece.

Both layouts of public BPE vocabularies in LAYOUTS never let a token cross from a non-space to a following space, so a text's ids
are the ids of its chunks (a word with the white space before it) put together. Distinct chunks are few compared with
running words; a task encodes each of them once and joins bytes. A vocabulary of any other layout gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Entries of a worker's cache before it starts anew (about 150 bytes each).
CACHE_ENTRIES = 1_000_000

_RUNS = re.compile(r"\s\s\s")
_CHUNKS = re.compile(r"\s*\S+|\s+")
#: White space to Python but not to the tokenizers' patterns: such texts are encoded as one chunk.
_ODD = re.compile("[\0\x1c-\x1f]")
#: Stands before a chunk that has no blank put in front.
_TAG = "\0"
#: A plain word: what leads it (a mark for none, a line end, or nothing for a blank), Latin letters, and ASCII signs
#: but for the apostrophe (of contractions) and the less-than sign (of special tokens).
_PLAIN_WORD = re.compile("([\\0\\n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\\[-`{-~]*)")
#: Byte-level vocabularies write each byte as a character: printable ones as they are, others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_BLANK, _NEWLINE = _BYTE_CHARS[32], _BYTE_CHARS[10]


#: How the public vocabularies that texts may be cut for normalize and split a text.
LAYOUTS = (
    {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
    {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    },
)


class _Known(dict):
    """Ids of chunks; those not met yet are learnt."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = ids = self.encoder.learn(chunk)
        return ids


class Encoder:
    """Encodes texts to little-endian uint32 ids, as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known(self)
        self.tokenize = self.tokenizer.model.tokenize
        self.signs: dict[str, array] = {}
        #: Case is folded and white space dropped, or both are part of tokens.
        self.folds = self.tokenizer.normalizer is not None
        settings = json.loads(self.tokenizer.to_str())
        #: Whether texts may be cut into chunks.
        self.cuts = {k: settings[k] for k in LAYOUTS[0]} in LAYOUTS

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if not self.cuts:
            return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        find, out = self.known.__getitem__, []
        for text in texts:
            out.append(b"".join(map(find, _folded_chunks(text) if self.folds else _chunks(text))))
        return out

    def learn(self, chunk: str) -> bytes:
        """Ids of a chunk: of plain words by the vocabulary's model, of others by the whole tokenizer.

        In both vocabularies a plain word (with the blank before it, if blanks count) and its tail are what the text is
        split into before the model, and folding case or composing such letters depends on nothing around them.
        """
        found = _PLAIN_WORD.fullmatch(chunk)
        if not found:
            return array("I", self.tokenizer.encode(_plain(chunk), add_special_tokens=False).ids).tobytes()
        lead, word, tail = found.groups()
        if not word.isascii():
            word = (word.lower() if self.folds else word).encode().decode("latin-1").translate(_BYTE_CHARS)
        elif self.folds:
            word = word.lower()
        ids = array("I", [x.id for x in self.tokenize(word if lead or self.folds else _BLANK + word)])
        if tail:
            ids += self.sign(tail)
        if lead == "\n" and not self.folds:
            ids = self.sign(_NEWLINE) + ids
        return ids.tobytes()

    def sign(self, chars: str) -> array:
        found = self.signs.get(chars)
        if found is None:
            found = array("I", [x.id for x in self.tokenize(chars)])
            if len(self.signs) < 100_000:
                self.signs[chars] = found
        return found


def _folded_chunks(text: str) -> list[str]:
    """Chunks where case is folded and white space dropped: any blank or line end may part them."""
    if "<|" in text or "\0" in text:
        return [_TAG + text]
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        pass
    else:
        text = text.lower()  # of these letters, folded one by one in any case
    return text.replace("\n", " ").split(" ")


def _chunks(text: str) -> list[str]:
    if not text:
        return []
    if "\0" in text or "<|" in text or _RUNS.search(text) or text[-2:].isspace():
        return [_TAG + text] if "<|" in text or _ODD.search(text) else [_TAG + x for x in _CHUNKS.findall(text)]
    # cut before each blank and line end, which of runs of two leaves each its own; _plain puts the blanks back
    first, *rest = text.replace("\n", " \n").split(" ")
    return [_TAG + first, *rest] if first else rest


def _plain(chunk: str) -> str:
    if chunk[:1] == _TAG:
        return chunk[1:]
    return chunk if chunk[:1] == "\n" else " " + chunk


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, with what it has cached."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
