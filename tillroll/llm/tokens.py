"""Token ids of whole texts by the tokenizers library, with the ids of repeated chunks kept.

Both vocabularies end a pre-token wherever a non-blank character is followed by
a space or line break, and wherever an ASCII letter or digit is followed by ASCII
punctuation; such punctuation up to the next blank is one pre-token, unless it holds an
apostrophe.  So the chunks between such places can be encoded one by one and their
ids put together.  Texts are encoded many at a time, each distinct chunk among
them once.  A word of letters alone is one pre-token of a byte-level vocabulary, with the space before
it; the library's model is asked for it, without the pre-tokenizer.  A worker process keeps the ids of chunks it has seen (two
generations of at most ``KEEP`` or ``BYTE_KEEP``).  Texts holding any other white space, the
mark ``GLUED``, or a string that the tokenizer treats as one special token, are encoded whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

KEEP = 400_000
_LONG = 64  # a chunk of more characters is not kept
# The same for byte-level vocabularies: a word costs so little there that only those likely to come again are worth their memory.
BYTE_KEEP, _BYTE_LONG = 300_000, 13
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_TAIL = r"([A-Za-z0-9])([!-&(-/:-@\[-`{-~]+(?:[ \n]|\z))"  # for RE2
CHARS = 5_000_000  # texts of about so many characters are encoded together; more cost memory, fewer time
GLUED = "\x01"  # begins the key of punctuation that stands at the end of a word
# White space besides space and line break, as Python or Unicode see it, and characters that may count as such.
_OTHER_BLANK = [c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n"] + ["\u180e", "\u200b", "\u2060", "\ufeff"]
# A line break or nothing, then letters; only those that Unicode has long had, which every library's tables know.
_WORD = re.compile("\n?[" + "".join(c for c in map(chr, range(0x10000)) if c.isalpha() and unicodedata.ucd_3_2_0.category(c)[0] == "L") + "]+")
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
# How byte-level vocabularies write each byte: as itself, or from U+0100 on where that is no visible character.
_SHOWN = dict(zip([*_PLAIN, *sorted({*range(0x100)} - {*_PLAIN})], [*_PLAIN, *range(0x100, 0x200)]))
_SPACE, _BREAK = chr(_SHOWN[ord(" ")]), chr(_SHOWN[ord("\n")])


def _glued(texts: list[str]) -> pa.Array:
    """The texts with a space and GLUED before punctuation that ends a word."""
    return pc.replace_substring_regex(pa.array(texts, pa.string()), _TAIL, rf"\1 {GLUED}\2")


class Encoder:
    """A chunk's key is the chunk itself, without its space where one space and then a non-blank begin it, or with GLUED."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        self.byte_level = (isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
                           and self.tokenizer.normalizer is None)
        self.keep, self.long = (BYTE_KEEP, _BYTE_LONG) if self.byte_level else (KEEP, _LONG)
        self.whole = [GLUED, *_OTHER_BLANK, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, keys: list[str]) -> list[bytes]:
        """``_ids`` of keys that match ``_WORD``, by the model alone."""
        tokenize = self.tokenizer.model.tokenize
        first = [t.id for t in tokenize(_BREAK)]
        shown = " ".join(keys).encode().decode("latin-1").translate(_SHOWN | {ord(" "): " "}).split(" ")
        return [array("I", [*first, *[t.id for t in tokenize(w[1:])]] if w[0] == _BREAK else [t.id for t in tokenize(_SPACE + w)]).tobytes()
                for w in shown]

    def _add(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct keys that are not in ``seen``; those worth keeping go there."""
        found = list(map(self.older.get, keys))
        new = [k for k, ids in zip(keys, found) if ids is None]
        words = [k for k in new if (k.isascii() and k.isalpha()) or _WORD.fullmatch(k)] if self.byte_level else []
        made = dict(zip(words, self._word_ids(words))) if words else {}
        rest = [k for k in new if k not in made] if made else new
        made.update(zip(rest, self._ids([k[1:] if k[0] == GLUED else k if k[0] in " \n" else " " + k for k in rest])))
        found = [made[k] if ids is None else ids for k, ids in zip(keys, found)]
        self.seen.update((k, ids) for k, ids in zip(keys, found) if len(k) <= self.long)
        return found

    def _spaced(self, text: str) -> list[str]:
        """The first chunk (empty if the text begins with a blank) and the keys of the others, for any run of blanks."""
        first, *rest = _CHUNK.findall(text)
        keys = [c[1:] if len(c) > 1 and c[0] == " " and c[1] not in " \n" else c for c in rest]
        if first[0] not in " \n":
            return [first, *keys]
        return ["", first[1:] if len(first) > 1 and first[0] == " " and first[1] not in " \n" else first, *keys]

    def encode(self, texts: list[str]) -> list[bytes]:
        """All ids of each text as little-endian unsigned 32-bit integers."""
        out = [b""] * len(texts)
        whole, spaced, single = [], [], []  # single: every blank stands alone, inside the text
        for i, t in enumerate(texts):
            if any(s in t for s in self.whole):
                whole.append(i)
            elif t:
                odd = "  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[0] in " \n" or t[-1] in " \n"
                (spaced if odd else single).append(i)
        for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = ids
        if not single and not spaced:
            return out
        split = pc.split_pattern(pc.replace_substring(_glued([texts[i] for i in single]), "\n", " \n"), " ")
        rest = [self._spaced(t) for t in _glued([texts[i] for i in spaced]).to_pylist()]
        firsts = self._ids(pc.list_element(split, 0).to_pylist() + [r[0] for r in rest])
        # A first chunk's place in the list of all chunks holds a key like any other, and gets its own ids below.
        flat = pa.concat_arrays([split.flatten(), pa.array([k or "." for r in rest for k in r], pa.string())]).dictionary_encode()
        counts = np.concatenate([pc.list_value_length(split).to_numpy(), [len(r) for r in rest]]).astype(np.int64)
        start = np.cumsum(counts) - counts
        codes = flat.indices.to_numpy().astype(np.int64)
        keys = flat.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
        codes[start] = len(keys) + np.arange(len(counts))
        known = list(map(self.seen.get, keys))
        if missing := [n for n, ids in enumerate(known) if ids is None]:
            for n, ids in zip(missing, self._add([keys[n] for n in missing])):
                known[n] = ids
        found = pa.array([*known, *firsts], pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8)
        ids = memoryview(found.buffers()[2] or b"")
        for i, x, y in zip([*single, *spaced], ends[start].tolist(), ends[start + counts].tolist()):
            out[i] = bytes(ids[x:y])
        if len(self.seen) > self.keep:
            self.older, self.seen = self.seen, {}
        return out


@cache
def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file: worker processes serve many tasks."""
    return Encoder(path)
