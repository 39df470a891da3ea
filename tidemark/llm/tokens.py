"""Token ids of texts by a public tokenizer, word by word.

The word tokenizer drops white space and never joins across it, so a text's ids are the ids
of its words one after the other, and a worker keeps the ids of words that it
has met.  Only ASCII white space splits here; other white space stays within a word, where the tokenizer itself splits.
New words of plain letters are encoded many at a time, since each ends with the one token that is marked
as a word's end; ASCII signs after a letter are tokens of their own, so texts are cut there before
words are looked up, and a word is met once, whatever signs follow it.  Texts that may name a special token stay as they are; there such words come
from their letters' ids and their signs'.

Defined results: an empty text has no ids (callers read null as empty); a text of any length is encoded whole; equal words have equal ids.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.frames import KEPT

#: Bytes of words and ids that a worker keeps: those met since the last turn, and as many from before it.  A bound on memory, not on results.
KEPT_BYTES = 40 << 20
#: What an entry takes besides.
ENTRY_BYTES = 170
#: Words over this length (bytes) aren't kept.
KEPT_LENGTH = 64
WORD_END = "</w>"
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A letter before an ASCII sign but the apostrophe: the tokenizer cuts there.
LETTER_SIGN = r"([a-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
#: ASCII signs but the apostrophe, which begins endings such as 's.
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)


class WordIds(dict):
    """UTF-8 word -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.held = 0
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)

    def text_ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of whole texts, a string array: each distinct word of them is looked up once.

        The tokenizer lowers letters itself; only special tokens' names must not arise from that.
        """
        named = pc.match_substring(texts, "<|")
        low = pc.replace_substring_regex(pc.ascii_lower(texts), LETTER_SIGN, r"\1 \2")
        if pc.any(named).as_py():
            low = pc.if_else(named, texts, low)
        words = pc.ascii_split_whitespace(low)
        coded = words.flatten().dictionary_encode()
        ids = self.word_list(coded.dictionary.cast(pa.binary()).to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        each = sizes[which]
        ends = np.concatenate(([0], np.cumsum(each)))
        at = np.repeat(starts[which] - ends[:-1], each) + np.arange(ends[-1])
        data = np.frombuffer(b"".join(ids), "<u4")[at]
        offsets = words.offsets.to_numpy()
        cuts = ends[offsets - offsets[0]].tolist()
        return [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def word_list(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct words."""
        ids = list(map(self.get, words))
        at = [i for i, x in enumerate(ids) if x is None]
        if at:
            found = self.learn({words[i] for i in at})
            for i in at:
                ids[i] = found[words[i]]
        return ids

    def encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        odd: list[bytes] = []
        for at in range(0, len(words), 2048):
            plain = []
            for w in words[at : at + 2048]:
                (plain if w.isalpha() or PLAIN.fullmatch(w.decode()) else odd).append(w)
            ids = np.asarray(self.tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(plain):
                odd += plain
                continue
            data = ids.tobytes()
            found.update(zip(plain, [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)] if stops else (), strict=True))
        for at in range(0, len(odd), 2048):
            part = odd[at : at + 2048]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                found[w] = np.asarray(e.ids, "<u4").tobytes()
        return found

    def learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that aren't among those met lately; keeps the short ones."""
        known = {w: self.older[w] for w in new if w in self.older}
        self.keep(known)
        found = known | self.made(new - known.keys())
        if self.held > KEPT_BYTES:
            self.older = dict(self)
            self.clear()
            self.held = 0
        return found

    def keep(self, found: dict[bytes, bytes]) -> None:
        short = {w: ids for w, ids in found.items() if len(w) <= KEPT_LENGTH}
        self.update(short)
        self.held += ENTRY_BYTES * len(short) + sum(map(len, short)) + sum(map(len, short.values()))

    def made(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Ids of new words."""
        parts = {}
        for w in new:
            letters = w.rstrip(SIGNS)
            if letters != w and letters[-1:].islower() and b"<|" not in w:
                parts[w] = letters, w[len(letters) :]
        known = {x: self[x] for pair in parts.values() for x in pair if x in self}
        found = self.encoded(list({x for pair in parts.values() for x in pair if x not in known} | (new - parts.keys())))
        for w, pair in parts.items():
            found[w] = b"".join(found[x] if x in found else known[x] for x in pair)
        self.keep(found)
        return found


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


KEPT["tokens"] = word_ids.cache_clear
