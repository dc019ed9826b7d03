"""Token ids of whole texts with a public vocabulary, through a bounded cache of pieces.

Both vocabularies cut a text at white space before they merge, so the ids of a
text are those of its white-space chunks, one after the other. Texts of ASCII
and Latin-1 letters are cut further, where the vocabulary's own pattern cuts
them, which leaves fewer distinct pieces: numpy finds the cuts of many texts at
once, and Arrow the distinct pieces. A worker has the tokenizer encode each
piece once and remembers its ids as bytes, as long as it is in use. Texts with
an added token of the file (``<|endoftext|>``) are encoded whole, as the
library does by default, so the token has its own id. The tokenizer file is a
parameter and is read where the task runs.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from quillspark.llm.common import stores

#: Pieces of a generation, twice as many for a byte-level vocabulary; a worker remembers two generations.
CACHE = 250_000
#: Plain pieces which are put into the vocabulary's characters as one text.
JOINED = 500
#: Characters of a text which are cut into pieces at once.
PART = 1 << 20

# White_Space of Unicode.
_W = "\t-\r \x85\xa0  -     　"
#: A word keeps the blank before it; of more white space the last character is apart.
_WITH_BLANK = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+").findall
_WITHOUT = re.compile(f"[^{_W}]+").findall
#: str.split also cuts at these, which are no White_Space.
_SEPARATORS = re.compile("[\x1c-\x1f]").search

# Letters of ASCII and Latin-1 have no other form and do not combine with each other.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[\t\n\r -~{_L}]*").fullmatch
_ENDING = "'(?:s|t|re|ve|m|ll|d)"
_PIECES_WITH_BLANK = re.compile(rf" ?[{_L}]+|{_ENDING}| ?[0-9]+| ?[^{_L}0-9\s]+|\s+(?!\S)|\s+").findall
_PIECES_WITHOUT = re.compile(rf"{_ENDING}|[{_L}]+|[0-9]|[^{_L}0-9\s]+").findall


# Bytes of plain texts in Latin-1 by class; a zero ends each text.
_END, _BLANK, _SPACE, _LETTER, _DIGIT, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
for _chars, _c in ((b"\0", _END), (b" ", _BLANK), (b"\t\n\r", _SPACE), (b"0123456789", _DIGIT)):
    _CLASS[list(_chars)] = _c
_CLASS[[b for b in range(256) if re.match(f"[{_L}]", chr(b))]] = _LETTER
_PLAIN_BYTES = bytes(b for b in range(1, 256) if _PLAIN(chr(b)))


def _plain_bytes(text: str) -> bytes | None:
    """A plain text in Latin-1; none if it is not plain."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if data.translate(None, _PLAIN_BYTES) else data


def _cuts(data: np.ndarray, blank_closes: bool, digits_apart: bool) -> np.ndarray:
    """Where the pieces of plain texts begin, each text with a zero after it: as _PIECES_WITH_BLANK finds them.

    With ``blank_closes`` false an apostrophe after a blank may begin an ending, and
    with ``digits_apart`` each digit is a piece, as _PIECES_WITHOUT finds them; white space stays with the pieces.
    """
    kind = _CLASS[data]
    n = len(kind)
    run = np.empty(n + 1, bool)
    run[0] = run[n] = True
    white = (kind == _BLANK) | (kind == _SPACE)
    np.not_equal(kind[1:], kind[:-1], out=run[1:n])
    run[1:n] &= ~(white[1:] & white[:-1])
    begins = run[:n] | (kind == _END)
    if digits_apart:
        begins |= kind == _DIGIT
    # the last of some white space before a word is apart, and a blank goes with the word
    after = np.flatnonzero(white[:-1] & ~white[1:] & (kind[1:] != _END))
    begins[after] = True
    begins[after[kind[after] == _BLANK] + 1] = False
    # endings: an apostrophe alone, at the begin of a piece
    at = np.flatnonzero(data == 39)
    at = at[run[at] & run[at + 1]]
    if blank_closes:
        at = at[begins[at]]
    padded = np.append(data, np.zeros(3, np.uint8))
    one, two = padded[at + 1], padded[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for found, size in ((at[short], 2), (at[long], 3)):
        begins[found + 1] = False
        begins[found + size] = True  # a text's end stands there at the latest
    return np.flatnonzero(begins)


#: Both vocabularies cut before a blank between two letters, whatever stands around them.
_CUT = re.compile("(?<=[a-z]) (?=[a-z])").search


def parts(text: str, size: int = PART) -> list[str]:
    """The text in parts of about ``size`` characters which are encoded apart; a stretch without such a place stays whole."""
    out, at = [], 0
    while len(text) - at > size and (cut := _CUT(text, at + size)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def _words(text: str) -> list[str]:
    return _WITHOUT(text) if _SEPARATORS(text) else text.split()


class ChunkTokenizer:
    """``keeps_blanks``: the vocabulary has tokens for white space (byte-level BPE); else it drops it and lower-cases.

    ``added``: the file's added tokens have their own ids; else they are text as any other.
    """

    def __init__(self, path: str, keeps_blanks: bool, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # plain pieces in their final case are what the model gets, but for the characters which stand for bytes
        self.model = self.tokenizer.model
        in_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.in_bytes = {c: in_bytes.pre_tokenize_str(chr(c))[0][0] for c in _PLAIN_BYTES}
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.added_begin = {re.match(r"\W*", n)[0] for n in names}
        self.added = re.compile("|".join(map(re.escape, names)), re.IGNORECASE).search
        self.keeps_blanks = keeps_blanks
        self.split = _WITH_BLANK if keeps_blanks else _words
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit into 16 bits")

    def pieces(self, text: str) -> list[str]:
        """Parts of a text which the vocabulary encodes apart: its chunks, those of plain letters cut further."""
        if _PLAIN(text):
            return _PIECES_WITH_BLANK(text) if self.keeps_blanks else _PIECES_WITHOUT(text.lower())
        out: list[str] = []
        for c in self.split(text):
            out += self.pieces(c) if _PLAIN(c) else [c]
        return out

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def has_added(self, text: str) -> bool:
        """Whether a text may have an added token, in any case, as normalisation may lower-case."""
        return any(b in text for b in self.added_begin) and self.added(text) is not None

    def _encode_whole(self, text: str) -> np.ndarray:
        """Ids of a text as the library gives them by default."""
        self.tokenizer.encode_special_tokens = False
        try:
            return np.array(self._encode([text])[0], np.uint16)
        finally:
            self.tokenizer.encode_special_tokens = True

    def _encode_joined(self, group: list[str]) -> list[bytes]:
        """Ids of each plain piece: the vocabulary's pattern cuts it no further, so the model takes it as it is."""
        tokens = map(self.model.tokenize, "\0".join(group).translate(self.in_bytes).split("\0"))
        return [array("H", [t.id for t in x]).tobytes() for x in tokens]

    def _learn(self, pieces: set[str]) -> None:
        """Have the ids of all these pieces at hand."""
        if len(self.known) + len(pieces) > CACHE * (1 + self.keeps_blanks):  # the older half goes, but what is still used moves up
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        plain, alone = [], []
        for p in pieces - known.keys():
            if (got := before.get(p)) is not None:
                known[p] = got
            elif _PLAIN(p):
                plain.append(p)
            else:
                alone.append(p)
        for at in range(0, len(plain), JOINED):
            group = plain[at : at + JOINED]
            known.update(zip(group, self._encode_joined(group), strict=True))
        for at in range(0, len(alone), 20_000):
            group = alone[at : at + 20_000]
            known.update((p, array("H", ids).tobytes()) for p, ids in zip(group, self._encode(group), strict=True))

    def ids_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text as uint16; null and empty texts have none. New pieces of all texts are encoded together.

        A very long text is taken part by part, so that its pieces are never held all at once.
        """
        if any(t and len(t) > 2 * PART for t in texts):
            return [np.concatenate([self._ids_of([p])[0] for p in parts(t)]) if t else np.zeros(0, np.uint16) for t in texts]
        return self._ids_of(texts)

    def _ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece."""
        got = list(map(self.known.get, pieces))
        if gaps := [k for k, ids in enumerate(got) if ids is None]:
            self._learn({pieces[k] for k in gaps})
            for k in gaps:
                got[k] = self.known[pieces[k]]
        return got

    def _ids_of_plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each plain text, in Latin-1."""
        joined = b"\0".join(texts) + b"\0"
        if not self.keeps_blanks:
            joined = joined.decode("latin-1").lower().encode("latin-1")
        data = np.frombuffer(joined, np.uint8)
        begins = _cuts(data, self.keeps_blanks, not self.keeps_blanks)
        offsets = np.append(begins, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        _, bounds, chars = found.dictionary.buffers()
        bounds, chars = np.frombuffer(bounds, np.int32, len(found.dictionary) + 1).tolist(), str(chars, "latin-1")
        names = [chars[a:b] for a, b in zip(bounds, bounds[1:])]
        if not self.keeps_blanks:
            names = [p.strip() for p in names]
        used = [k for k, p in enumerate(names) if p and p != "\0"]
        ids = [b""] * len(names)
        for k, x in zip(used, self._ids_of_pieces([names[k] for k in used]), strict=True):
            ids[k] = x
        out = pa.array(ids, pa.binary()).take(found.indices)
        ends = np.frombuffer(out.buffers()[1], np.int32)[np.flatnonzero(data[begins] == 0)] // 2
        values = np.frombuffer(out.buffers()[2] or b"", np.uint16)
        return [values[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _ids_of(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        plain: dict[int, bytes] = {}
        rest: dict[int, list[str]] = {}
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.has_added(t):
                out[i] = self._encode_whole(t)
            elif (data := _plain_bytes(t)) is not None:
                plain[i] = data
            else:
                rest[i] = self.pieces(t)
        if plain:
            for i, ids in zip(plain, self._ids_of_plain(list(plain.values())), strict=True):
                out[i] = ids
        if rest:
            got = self._ids_of_pieces([p for x in rest.values() for p in x])
            at = 0
            for i, x in rest.items():
                out[i] = np.frombuffer(b"".join(got[at : at + len(x)]), np.uint16)
                at += len(x)
        return out


def slices(column, rows: int = 1000, size: int = 4 << 20):
    """Texts of an Arrow column in lists of bounded rows and characters."""
    held, n = [], 0
    for x in column:
        held.append(x.as_py())
        n += len(held[-1] or "")
        if len(held) >= rows or n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


_open: dict[tuple[str, bool], ChunkTokenizer] = {}
stores["tokens"] = _open.clear


def tokenizer(path: str, keeps_blanks: bool) -> ChunkTokenizer:
    """The worker's tokenizer for a file; opened once."""
    if (path, keeps_blanks) not in _open:
        _open[path, keeps_blanks] = ChunkTokenizer(path, keeps_blanks, added=True)
    return _open[path, keeps_blanks]
