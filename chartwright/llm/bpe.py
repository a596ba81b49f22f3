"""Token ids of whole texts by a public byte-level BPE tokenizer, a record batch at a time.

Texts are cut at blanks by Arrow, which also numbers the distinct pieces; only those go through Python: an
unseen one is split into the tokenizer's words, and an unseen word goes to the tokenizers library's model.
Words are remembered within a bound. Cutting at a blank between two characters that aren't white space is
safe: the vocabulary's pre-tokenizer gives such a blank to the word behind it and never joins over it.
Texts with any other arrangement of white space are split by the pre-tokenizer's own pattern as a whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WS = r"[\x09-\x0d \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]"
#: Texts that can't be cut at blanks: white space at an end or next to white space, or of an odd kind.
UNEVEN = rf"^{_WS}|{_WS}$|{_WS}{_WS}|[\x1c-\x1f]"
MARKS = frozenset(".,;:!?|")
#: Words kept by one Python worker, about 200 bytes each.
MEMORY = 800_000
#: Bytes of text encoded at a time; a longer text is encoded alone.
SLICE = 12 << 20
_OPEN: dict[str, Encoder] = {}


class _Words(dict):
    """A word of the pre-tokenizer -> its ids, found by the model when first asked for."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown = self._shown_bytes()
        self.id_bytes = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def _shown_bytes(self) -> dict[int, str]:
        """The character that stands for each byte in the vocabulary, learnt from the pre-tokenizer itself."""
        out = {}
        for code in [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x10000, 0x400), *range(0x10000, 0x110000, 0x4000)]:
            out.update(zip(chr(code).encode(), self.as_bytes(chr(code))[0][0], strict=True))
        return out

    def __missing__(self, word: str) -> bytes:
        seen = word.encode().decode("latin-1").translate(self.shown)
        out = self[word] = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(seen)])
        return out


class Encoder:
    """Texts to unsigned 32-bit ids, those of the library's encode(text, add_special_tokens=False).

    A text that holds the string of an added token goes to that encode as a whole, as the library cuts such
    strings out before anything else.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words, self.tokenizer = _Words(path), Tokenizer.from_file(path)
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    @staticmethod
    def open(path: str) -> Encoder:
        """One encoder for each vocabulary and Python worker."""
        if path not in _OPEN:
            _OPEN[path] = Encoder(path)
        return _OPEN[path]

    def encode(self, text: str, blank: str = "") -> bytes:
        """Little-endian ids of a text, with a blank before it or without."""
        words = self.words
        if text.isalpha():
            return words[blank + text]
        if text[:-1].isalpha() and text[-1] in MARKS:
            return words[blank + text[:-1]] + words[text[-1]]
        return b"".join([words[w] for w in words.split(blank + text)])

    def encode_batch(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]. Null texts count as empty; end_id closes each."""
        parts, at = [], 0
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, side="right")))
            parts.append(self._slice(texts.slice(at, to - at), end_id))
            at = to
        if not parts:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        counts = np.concatenate([c for _, c in parts])
        return np.concatenate([i for i, _ in parts]), np.concatenate(([0], np.cumsum(counts)))

    def _slice(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > MEMORY:
            self.words.clear()
        n = len(texts)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        uneven = pc.match_substring_regex(texts, UNEVEN)
        special = pa.repeat(pa.scalar(False), n)
        for content in self.added:
            special = pc.or_(special, pc.match_substring(texts, content))
        uneven = pc.or_(uneven, special)
        pieces = pc.split_pattern(pc.if_else(uneven, "", texts), " ")
        ends = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        place, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        table = [self.encode(x, " ") if x else b"" for x in names]
        first = place[ends[:-1]]
        whole = special.to_pylist()
        for i, odd in enumerate(uneven.to_pylist()):  # a text's first piece has no blank before it
            if whole[i]:
                table.append(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes())
            else:
                table.append(self.encode(texts[i].as_py() if odd else names[first[i]]))
        table.append(b"" if end_id is None else int(end_id).to_bytes(4, "little"))
        width = np.fromiter(map(len, table), np.int64, len(table)) // 4
        begin, flat = np.cumsum(width) - width, np.frombuffer(b"".join(table), "<u4")
        row = np.repeat(np.arange(n), np.diff(ends))
        order = np.empty(len(place) + n, np.int64)
        order[np.arange(len(place)) + row] = place
        order[ends[:-1] + np.arange(n)] = len(names) + np.arange(n)
        order[ends[1:] + np.arange(n)] = len(table) - 1
        long = width[order]
        until = np.cumsum(long)
        ids = flat[np.repeat(begin[order] - until + long, long) + np.arange(until[-1])]
        total = until[ends[1:] + np.arange(n)]
        return ids, np.diff(total, prepend=0)
