"""Byte-level BPE of whole batches of texts, as the ``tokenizers`` library has it.

The merges never cross the words that the vocabulary's pattern finds, so each different word of a batch is encoded once. Words are found for all
characters at once, from their classes; Arrow numbers the different ones, and the ids of all places are gathered.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Texts of so many bytes are encoded at once.
BATCH_BYTES = 4 << 20
SPECIAL = b"<|endoftext|>"
LETTER, NUMBER, SPACE, OTHER, ODD = range(5)
JSON_NAME, RANKS_NAME = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

#: Texts with white space beyond ASCII or a special token's string go to the reference library.
_UNUSUAL = regex.compile(r"[^\S\x09-\x0D\x20]|[\x1c-\x1f]|<\|endoftext\|>")
#: Runs of one character class that the faster library would search at length.
_LONG_RUN = regex.compile(r"\s{1000}")


@lru_cache(maxsize=2)
def byte_bpe_libraries(json_name: str = JSON_NAME, ranks_name: str = RANKS_NAME):
    """The encoding of the vocabulary's ranks and the tokenizer of its JSON file."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(ranks_name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(public_tokenizers.path(json_name))


@lru_cache(maxsize=1)
def byte_bpe_encoder(json_name: str = JSON_NAME, ranks_name: str = RANKS_NAME) -> Callable[[str], np.ndarray]:
    """Text => ids (uint32), as the ``tokenizers`` library has them for ``json_name``.

    The vocabulary's ranks give the same ids at several times the speed, so ordinary texts
    go that way; tests compare the two.
    """
    # named without arguments, the libraries are loaded once for all who take the defaults
    fast, slow = byte_bpe_libraries(*() if (json_name, ranks_name) == (JSON_NAME, RANKS_NAME) else (json_name, ranks_name))

    def encode(text: str) -> np.ndarray:
        if _UNUSUAL.search(text) or _LONG_RUN.search(text):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    return encode


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of each code point below 2^16 and, for all above, ODD.

    A code point is ODD if its class may differ between libraries: if it had another category, or none, in an early version of
    Unicode, or is white space beyond ASCII. Texts that hold one go to the library as they are.
    """
    early, out = unicodedata.ucd_3_2_0.category, np.full((1 << 16) + 1, ODD, np.uint8)
    for i in range(1 << 16):
        kind = unicodedata.category(chr(i))
        if kind == early(chr(i)) and kind not in ("Cn", "Cs", "Zs", "Zl", "Zp") and not 0x1C <= i <= 0x1F and i != 0x85:
            out[i] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    out[[*range(9, 14), 32]] = SPACE
    return out


def word_starts(points: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a word begins at each character; ``first`` marks those that begin a text.

    A word is a run of one class, with one blank before it if there is one; of other white space before it, the last character is a word, and so are
    those that come earlier. An apostrophe that begins a word and the letters s, t, m, d, re, ve or ll after it are a word too.
    """
    space = classes == SPACE
    starts = first.copy()
    starts[1:] |= classes[1:] != classes[:-1]
    last = np.zeros_like(space)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    starts |= last
    starts[1:] &= ~(last & (points == 0x20))[:-1]
    at = np.flatnonzero((points == 0x27) & starts)
    if len(at):
        after = np.r_[points, 0, 0]
        begins = np.r_[first, True, True]
        one = np.where(begins[at + 1], 0, after[at + 1])
        two = np.where(begins[at + 1] | begins[at + 2], 0, after[at + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for some, length in ((at[short], 2), (at[long], 3)):
            starts[some + 1] = False
            starts[some[some + length < len(starts)] + length] = True
    return starts


class ByteBpe:
    """Encodes Arrow arrays of texts."""

    def __init__(self, *names: str):
        self.encode, (self.fast, _) = byte_bpe_encoder(*names), byte_bpe_libraries(*names)
        (self.newline,) = self.encode("\n")

    def batch(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text, in order; a null is an empty text."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, ends, values = texts.buffers()
        offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else []
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
            data = values[offsets[at] : offsets[to]].to_pybytes() if values else b""
            if len(data) > 2 * BATCH_BYTES:  # one text, for which arrays of all characters would take too much memory
                yield self.encode(data.decode())
            else:
                yield from self._some(data, offsets[at : to + 1] - offsets[at])
            at = to

    def _some(self, data: bytes, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Texts that lie one behind another in ``data``."""
        points = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(data, np.uint8)
        bytes_at = np.flatnonzero((raw & 0xC0) != 0x80) if len(points) < len(raw) else np.arange(len(raw))
        classes = character_classes()[np.minimum(points, 1 << 16)]
        begin = np.searchsorted(bytes_at, offsets)  # in characters
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(begin, np.flatnonzero(classes == ODD), "right") - 1] = True
        # the library knows the string of its special token in any text
        if SPECIAL in data:
            odd |= np.array([SPECIAL in data[a:b] for a, b in zip(offsets, offsets[1:])])
        if odd.any():
            texts = [data[a:b] for a, b in zip(offsets, offsets[1:])]
            others = [x for x, o in zip(texts, odd) if not o]
            found = self._some(b"".join(others), np.cumsum([0, *map(len, others)]))
            yield from (self.encode(x.decode()) if o else next(found) for x, o in zip(texts, odd))
            return
        first = np.zeros(len(points) + 1, bool)
        first[begin[:-1]] = True
        starts = np.flatnonzero(word_starts(points, classes, first[:-1])) if len(points) else np.array([], np.int64)
        bounds = np.append(bytes_at[starts] if len(starts) else starts, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        word = coded.indices.to_numpy()
        flat, base, sizes = self._words(coded.dictionary)
        each = sizes[word]
        ends = np.cumsum(each)
        out = flat[np.repeat(base[word] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.r_[0, ends][np.searchsorted(starts, begin)]
        for a, b in zip(cuts, cuts[1:]):
            yield out[a:b]

    def _words(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different words, where those of each begin, and how many it has."""
        # words part from each other at a line's end, which is an id of its own beside all but white space
        blank = pc.match_substring_regex(words, r"^[\x09-\x0D ]+$")
        plain, blanks = words.filter(pc.invert(blank)), words.filter(blank).to_pylist()
        lines = pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain)
        joined = pc.binary_join(lines, b"\n")[0].as_py().decode()
        ids = self.fast.encode_to_numpy(joined, disallowed_special=()).astype(np.uint32, copy=False)
        between = ids == self.newline
        cuts = np.r_[-1, np.flatnonzero(between), len(ids)] if len(plain) else np.array([-1])
        others = [self.encode(x.decode()) for x in blanks]
        sizes = np.empty(len(words), np.int64)
        is_blank = blank.to_numpy(zero_copy_only=False)
        sizes[~is_blank], sizes[is_blank] = np.diff(cuts) - 1, [len(x) for x in others]
        order = np.argsort(np.r_[np.flatnonzero(~is_blank), np.flatnonzero(is_blank)], kind="stable")
        flat = np.concatenate([ids[~between], *others])
        # where each word's ids begin: the blank ones stand behind all others
        put = np.r_[sizes[~is_blank], sizes[is_blank]]
        return flat, (np.cumsum(put) - put)[order], sizes
