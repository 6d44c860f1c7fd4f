"""Exact token ids of whole texts from a public tokenizer file, encoding each distinct piece once.

The ``tokenizers`` library spends microseconds per word. Texts repeat their words, so a text is cut
where the tokenizer itself always cuts, and the ids of each distinct cut are kept:

* *spaced* vocabularies (byte-level, a word carries the space before it): between a visible ASCII or
  Latin-1 character and a single space followed by another such character;
* *plain* vocabularies (white space dropped, lower case): at every space;
* inside those chunks between a run of Latin letters and a run of common punctuation.

Chunks outside these rules, and files of any other kind, go to the library as they are.
"""

from __future__ import annotations

import json
import re
from array import array

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r".,!?;:|&$#%*"
VISIBLE = "!-~À-ÿ"
SIMPLE = re.compile(rf" ?[{LETTERS}]+[{MARKS}]*(?:\n[{LETTERS}]+[{MARKS}]*)*").fullmatch
WORD = re.compile(rf"([{LETTERS}]+)([{MARKS}]*)").fullmatch
PIECES = re.compile(rf" ?[{LETTERS}]+|[{MARKS}]+|\n").findall
PLAIN_EDGES = re.compile(rf"[{VISIBLE}](?:.*[{VISIBLE}])?", re.S).fullmatch
SAFE_SPACES = re.compile(rf"(?<=[{VISIBLE}])(?= [{VISIBLE}])").split
#: Entries kept per worker before a cache starts again.
CACHED = 500_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the others follow from code point 256 on in byte order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Coder:
    """Ids as little-endian unsigned 32-bit integers, four bytes per token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.kind = kind_of(json.load(f))
        self.letters = byte_letters()
        self.chunks: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of one run of letters or marks, straight from the library's merge model."""
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= CACHED:
                self.pieces.clear()
            plain, letters = self.kind == "plain", self.letters
            shown = piece.lower() if plain else piece
            if not (plain and shown.isascii()):  # visible ASCII stands for itself
                shown = "".join([letters[b] for b in shown.encode()])
            got = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            self.pieces[piece] = got
        return got

    def chunk(self, chunk: str) -> bytes:
        if SIMPLE(chunk):
            pieces = PIECES(chunk)
            if self.kind == "plain":
                pieces = [p for p in pieces if p != "\n"]
            return b"".join([self.piece(p) for p in pieces])
        return self.library(chunk)

    def ids(self, text: str) -> bytes:
        """All ids of a text; equal to encoding it whole."""
        if not text:
            return b""
        if self.kind == "other":
            return self.library(text)
        chunks = text.split(" ")
        known = self.chunks
        if self.kind == "plain":
            try:
                return b"".join(map(known.__getitem__, chunks))
            except KeyError:
                self.learn(chunks)
                return b"".join(map(known.__getitem__, chunks))
        try:
            found = [known[c] for c in chunks[1:]]
        except KeyError:
            self.learn(chunks)
            found = [known[c] for c in chunks[1:]]
        if None in found or not PLAIN_EDGES(chunks[0]):
            return b"".join([self.chunk(c) for c in SAFE_SPACES(text)])
        return self.chunk(chunks[0]) + b"".join(found)

    def learn(self, chunks: list[str]) -> None:
        known = self.chunks
        if len(known) >= CACHED:
            known.clear()
        if self.kind != "plain":
            for c in chunks:
                if c not in known:
                    known[c] = self.chunk(" " + c) if PLAIN_EDGES(c) else None
            return
        pieces, piece = self.pieces, self.piece
        for c in chunks:
            if c in known:
                continue
            if found := WORD(c):  # most chunks by far; a word's case makes no difference
                word, marks = found.groups()
                word = word.lower()
                ids = pieces.get(word)
                if ids is None:
                    ids = piece(word)
                known[c] = ids + piece(marks) if marks else ids
            else:
                known[c] = self.chunk(c) if c else b""


def kind_of(config: dict) -> str:
    """``spaced``, ``plain`` or ``other`` by what the file's normalizer and pre-tokenizer do."""
    if (config.get("model") or {}).get("type") != "BPE" or config["model"].get("dropout"):
        return "other"
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"]
           for t in config.get("added_tokens", [])):
        return "other"
    normalizer, pre = config.get("normalizer"), config.get("pre_tokenizer") or {}
    if normalizer is None and pre.get("type") == "ByteLevel":
        return "spaced" if pre.get("use_regex") and not pre.get("add_prefix_space") else "other"
    steps = [n.get("type") for n in (normalizer or {}).get("normalizers", [])]
    cuts = [p.get("type") for p in pre.get("pretokenizers", [])]
    pattern = (pre.get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex", "")
    if steps == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"] \
            and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
        return "plain"
    return "other"


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The worker's coder of a tokenizer file; workers live on from task to task."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
