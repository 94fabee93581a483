"""Whole texts to token ids with the tokenizers library, one call per distinct piece.

A text is cut where the tokenizer's own pattern always cuts, so the ids of the
text are the ids of its pieces in order. A task keeps the ids of the pieces it
has met; the library sees each of them once as long as it comes again soon
enough. Texts with anything for which the cut is not certain go to the library
whole.
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a worker process gives to the pieces it keeps. Past it the store starts anew; the last one stays until
#: the next is full, and pieces met meanwhile go from it into the new one.
KEPT_BYTES = 64 << 20
#: About what one kept piece takes besides its own characters, and the characters of the longest one kept.
_ENTRY, _LONG = 240, 100

# A sign, but for the apostrophe, right behind a letter. It comes first in the pattern, so the search skips to it.
_LETTER_MARK = re.compile(r"[,.!?;:#$%&*](?<=[^\W\d_].)")
# White space other than blank and line feed, and NUL.
_ODD_SPACE = re.compile(r"[^\S \n]")
# Letters whose lower case depends on what is around or is longer, separators that libraries see differently.
_ODD_LETTER = re.compile("[\x00\x1c-\x1fΣİ]")
# The same, for a search by sign.
_ODD_SIGNS = ("<|", *"\x00\x1c\x1d\x1e\x1f", "Σ", "İ")
# Letters without an upper case, a longer form or marks of their own.
_PLAIN_LETTERS = "".join(map(chr, [*range(97, 123), *range(223, 247), *range(248, 256)]))
_PLAIN_WORD = re.compile(f"[{_PLAIN_LETTERS}]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[97:123] = True
_IS_MARK = np.zeros(256, dtype=bool)
_IS_MARK[np.frombuffer(b",.!?;:#$%&*", dtype=np.uint8)] = True
_RUNS = ("  ", " \n", "\n ", "\n\n", "\x00", "<|")


def cut_byte_level(text: str) -> list[str] | None:
    """Pieces for a byte-level tokenizer: a blank goes with the word after it. None: not certain.

    Not certain are runs of white space, white space of other kinds, and what may open a special token.
    """
    if any(x in text for x in _RUNS) or _ODD_SPACE.search(text):
        return None
    text = _LETTER_MARK.sub("\x00\\g<0>", text)
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")


def cut_lower_words(text: str) -> list[str] | None:
    """Pieces for a lower-casing tokenizer that drops white space. None: not certain."""
    if "<|" in text or _ODD_LETTER.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
        return None
    return _LETTER_MARK.sub(" \\g<0>", text.lower()).split()


def lower_words(texts: list[str]) -> pa.ListArray:
    """Words of each text between ASCII white space, A-Z lower-cased, cut where a sign is right behind an ASCII letter.

    Works on the bytes of all texts end to end. A list may hold empty words, and
    words that ``cut_lower_words`` cuts further.
    """
    joined = pa.array(texts, type=pa.string())
    offsets = np.frombuffer(joined.buffers()[1], dtype=np.int32, count=len(texts) + 1).astype(np.int64)
    data = _LOWER[np.frombuffer(joined.buffers()[2] or b"", dtype=np.uint8, count=offsets[-1])]
    cuts = np.flatnonzero(_IS_MARK[data[1:]] & _IS_LETTER[data[:-1]]) + 1
    data = np.insert(data, cuts, 32)
    offsets = (offsets + np.searchsorted(cuts, offsets)).astype(np.int64)
    cut = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data))
    return pc.ascii_split_whitespace(cut)


class Encoder:
    """Encodes texts with one tokenizer file; ids come as bytes of little-endian numbers.

    ``separator`` has no ids of its own and may stand between any two pieces.
    ``special`` says whether the texts of special tokens are these tokens, as
    the library takes them unless told otherwise, or ordinary text.
    """

    def __init__(self, path: str, cut, dtype: str, separator: str | None = None, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.cut, self.dtype, self.separator = cut, dtype, separator
        # Functions of this package travel to the workers by value, so what is to outlive a task
        # is held by a module of the process itself.
        holder = sys.modules.setdefault("weftgraph_kept", types.ModuleType("weftgraph_kept"))
        name = f"{path}|{special}"
        if name not in holder.__dict__:
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = not special
            # How the steps before the model spell letters, if they leave a word of them whole.
            before, split, spelling = tokenizer.normalizer, tokenizer.pre_tokenizer, None
            if split is not None:
                def spelled(word: str) -> list[str]:
                    return [x for x, _ in split.pre_tokenize_str(before.normalize_str(word) if before else word)]

                each = [spelled(c) for c in _PLAIN_LETTERS]
                if spelled(_PLAIN_LETTERS) == ["".join(x for one in each for x in one)] and each[:26] == [[c] for c in _PLAIN_LETTERS[:26]]:
                    spelling = {ord(c): "".join(one) for c, one in zip(_PLAIN_LETTERS, each)}
            holder.__dict__[name] = tokenizer, spelling
        self.tokenizer, self.spelling = holder.__dict__[name]
        self.stores: list[dict[str, bytes]] = holder.__dict__.setdefault(f"{name}|{dtype}", [{}, {}])
        self.used: list[int] = holder.__dict__.setdefault(f"{name}|{dtype}|used", [0])

    @property
    def kept(self) -> dict[str, bytes]:
        return self.stores[0]

    def _keep(self, pieces: list[str], ids: list[bytes]) -> None:
        self.kept.update(zip(pieces, ids))
        self.used[0] += sum(map(len, pieces)) + sum(map(len, ids)) + _ENTRY * len(pieces)

    def _make_room(self) -> None:
        """Start a new store if the one in use is full; the one before goes."""
        if self.used[0] > KEPT_BYTES:
            self.stores[:] = [{}, self.stores[0]]
            self.used[0] = 0

    def _found_again(self, pieces) -> None:
        """Keep on the pieces that only the last store has."""
        last = self.stores[1]
        again = [p for p in pieces if p in last] if last else []
        self._keep(again, [last[p] for p in again])

    def _call(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of single pieces; many of them in one call if something without ids can part them."""
        if self.separator is None:
            return self._call(pieces)
        if self.spelling is None:
            return self._parted(pieces)
        # Words of plain letters are one word each, and reach the model as spelled.
        call, spelling, width = self.tokenizer.model.tokenize, self.spelling, np.dtype(self.dtype).itemsize
        plain = [_PLAIN_WORD.fullmatch(p) is not None for p in pieces]
        ids: list[int] = []
        ends = [0]
        for p, own in zip(pieces, plain):
            if own:
                ids += [x.id for x in call(p if p.isascii() else p.translate(spelling))]
                ends.append(len(ids))
        flat, places = np.array(ids, dtype=self.dtype).tobytes(), [width * e for e in ends]
        found = (flat[a:b] for a, b in zip(places, places[1:]))
        rest = iter(self._parted([p for p, own in zip(pieces, plain) if not own]))
        return [next(found) if own else next(rest) for own in plain]

    def _parted(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that may be several words, told apart by their places in the joined text."""
        out = []
        for begin in range(0, len(pieces), 2000):
            part = pieces[begin : begin + 2000]
            found = self.tokenizer.encode(self.separator.join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(p) + len(self.separator) for p in part[:-1]])
            first = np.searchsorted(np.array([a for a, _ in found.offsets], dtype=np.int64), np.append(starts, 1 << 60))
            ids, width = np.array(found.ids, dtype=self.dtype).tobytes(), np.dtype(self.dtype).itemsize
            places = (first * width).tolist()
            out += [ids[a:b] for a, b in zip(places, places[1:])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        self._make_room()
        pieces = [self.cut(t) for t in texts]
        fresh = set()
        for p in pieces:
            if p is not None:
                fresh.update(p)
        fresh.difference_update(self.kept)
        self._found_again(fresh)
        fresh.difference_update(self.kept)
        long = [p for p in fresh if len(p) > _LONG]
        fresh.difference_update(long)
        new = list(fresh)
        self._keep(new, self._pieces(new))
        get = self.kept.__getitem__
        if long:
            once = dict(zip(long, self._pieces(long)))
            get = lambda p: once[p] if p in once else self.kept[p]
        whole = iter(self._call([t for t, p in zip(texts, pieces) if p is None]))
        return [next(whole) if p is None else b"".join(map(get, p)) for p in pieces]

    def encode_words(self, texts: list[str]) -> list[bytes]:
        """``encode`` for ``cut_lower_words``, with a Python step for each distinct word of the texts, not for each word."""
        sure = [not any(x in t for x in _ODD_SIGNS) and (t.isascii() or unicodedata.is_normalized("NFC", t)) for t in texts]
        lists = lower_words([t for t, s in zip(texts, sure) if s])
        coded = lists.values.dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self._make_room()
        found = list(map(self.kept.get, words))
        open_places = [i for i, x in enumerate(found) if x is None]
        self._found_again(words[i] for i in open_places)
        new = self._learn([w for w in (words[i] for i in open_places) if w not in self.kept])
        for i in open_places:
            found[i] = new[words[i]] if words[i] in new else self.kept[words[i]]
        flat, width = np.frombuffer(b"".join(found), dtype=self.dtype), np.dtype(self.dtype).itemsize
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // width
        starts, counts = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(starts[codes] - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
        bounds = (ends[lists.offsets.to_numpy()] * width).tolist()
        parts = (ids[a:b] for a, b in zip(bounds, bounds[1:]))
        whole = iter(self._call([t for t, s in zip(texts, sure) if not s]))
        return [next(parts) if s else next(whole) for s in sure]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are not kept, all of which are kept but those of long ones; a word that is cut further has those of its pieces."""
        one, many = [], {}
        for w in words:
            if _PLAIN_WORD.fullmatch(w):
                one.append(w)
            else:
                many[w] = self.cut(w)
        pieces = {p for found in many.values() for p in found}
        self._found_again(pieces.difference(self.kept))
        known = self.kept
        new = list({*one, *(p for p in pieces if p not in known)})
        coded = dict(zip(new, self._pieces(new)))
        for w, found in many.items():
            if w not in coded and w not in known:
                coded[w] = b"".join(coded[p] if p in coded else known[p] for p in found)
        short = [w for w in coded if len(w) <= _LONG]
        self._keep(short, [coded[w] for w in short])
        return coded
