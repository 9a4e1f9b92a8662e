"""Token ids of whole texts by a public tokenizer, with a cache of chunks between ASCII white space.

The vocabulary's pre-tokenizer drops white space and never joins across it, so a text's ids are those of its
chunks, one after the other. Ids fit in 16 bits. A word of letters, with ASCII marks behind it, is two
pre-tokens; the words that a worker doesn't know yet are merged by tiktoken, several times as fast, under the
same file's merges. Both give the same ids if every token is what its own text encodes to: then a token can't
meet another split of its text, and both merge the lowest and leftmost pair first. The tests check that of
the vocabulary.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from .common import Words, vocabulary_path, each_slice

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
#: Chunks that a worker remembers; it forgets all of them when it has more.
MOST_KNOWN = 500_000
#: Bytes of text whose chunks are looked up together.
SLICE = 3 << 20
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def letters(word: str) -> bool:
    """True if the word is surely one pre-token that lower case and NFC leave alone but for its capitals."""
    return word.isalpha() and (word.isascii() or (max(word) < "ɐ" and "İ" not in word))


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: the byte itself where it prints, else the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def lowered(data: bytes) -> bytes:
    """In lower case, if every character is of Latin-1: there each keeps its length. Else as it is."""
    text = data.decode()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return data
    return text.lower().encode()


class Encoder:
    """many(texts): the ids of each, as little-endian 16-bit bytes."""

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        if plain:  # the strings of special tokens are then ordinary text
            self.tokenizer.encode_special_tokens = True
        self.special = () if plain else tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}
        with open(path) as f:
            model = json.load(f)["model"]
        byte = {v: k for k, v in byte_letters().items()}

        def raw(token: str) -> bytes:  # a word's end is a byte that UTF-8 doesn't have
            return bytes(byte[c] for c in token.removesuffix(END)) + b"\xff" * token.endswith(END)

        ids = {raw(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
        order = [bytes([k]) for k in range(256)] + [x for k in range(256) if (x := bytes([k, 255])) in ids] + [raw("".join(pair if isinstance(pair, list) else pair.split(" "))) for pair in model["merges"]]
        ranks = {x: k for k, x in enumerate(dict.fromkeys(order))}
        self.ids = np.array([ids.get(x, 0) for x in ranks], "<u2")
        self.merge = tiktoken.Encoding("words", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def learn(self, chunks: list[str]) -> None:
        known, merge = self.known, self.merge
        stems = [c.rstrip(MARKS) for c in chunks]
        plain = [s.isalpha() and (s.isascii() or letters(s)) for s in stems]
        new = list({s for s, ok in zip(stems, plain) if ok and s not in known})
        flat, sizes = [], []
        for w in new:
            flat += (f := merge(w.lower().encode() + b"\xff"))
            sizes.append(len(f))
        ids, ends = self.ids[np.array(flat, np.int64)].tobytes(), (2 * np.cumsum(sizes)).tolist()
        known.update(zip(new, [ids[a:b] for a, b in zip([0, *ends], ends)]))
        for c, s, ok in zip(chunks, stems, plain):
            if not ok:
                known[c] = self.raw(c)
            elif s != c:
                tail = c[len(s) :]
                if tail not in known:
                    known[tail] = self.raw(tail)
                known[c] = known[s] + known[tail]

    def chunks(self, chunks: list[str]) -> list[bytes]:
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        got = list(map(self.known.get, chunks))
        if None in got:
            missing = [k for k, x in enumerate(got) if x is None]
            self.learn([chunks[k] for k in missing])
            for k in missing:
                got[k] = self.known[chunks[k]]
        return got

    def many(self, buf: np.ndarray, off: np.ndarray) -> Iterator[bytes]:
        """Of each of the UTF-8 texts, in order. Equal chunks of a slice are looked up once."""
        for i, j, part, cut in each_slice(buf, off, SLICE):
            data = part.tobytes()
            special = [s.encode() for s in self.special if s.encode() in data]
            texts = [data[cut[k] : cut[k + 1]].decode() if special else "" for k in range(j - i)]
            if not special:
                data = lowered(data)
            w = Words(part, cut)
            _, first, at = np.unique(w.hashes(), return_index=True, return_inverse=True)
            odd = np.flatnonzero(~w.same(first[at]))  # another word's hash: these are looked up one by one
            first, at[odd] = np.append(first, odd), len(first) + np.arange(len(odd))
            each = self.chunks([data[a:b].decode() for a, b in zip(w.start[first].tolist(), w.end[first].tolist())])
            size = np.fromiter(map(len, each), np.int64, len(each)) // 2
            every, begin = np.frombuffer(b"".join(each), "<u2"), np.cumsum(size) - size
            n = size[at]
            ends = np.cumsum(n)
            ids = every[np.repeat(begin[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = (2 * np.append(0, ends)[w.first]).tolist()
            raw = ids.tobytes()
            for k in range(j - i):
                if special and any(s in texts[k] for s in self.special):
                    yield self.raw(texts[k])
                else:
                    yield raw[bounds[k] : bounds[k + 1]]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str | None = None, plain: bool = False) -> Encoder:
    """This process's encoder for a vocabulary file."""
    path = path or vocabulary_path(VOCABULARY)
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]
