"""Token ids of whole texts, by the tokenizers library, one encoding per distinct piece of a word.

The word BPE vocabulary splits at white space and drops it, so a text's ids are the ids of its
words one after another. Inside a word of plain characters it splits between letters, digits and
punctuation, so the word's ids are those of these pieces, in lower case. Encoding each distinct piece
once and gathering the ids with numpy gives the same ids as encoding the text, at a fraction of the
time. The cache is cleared when it is full.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Ends each document in the id stream.
END_ID = 1

_encoders: dict[tuple[str, int], WordEncoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What a byte of a word is. A word with an OTHER byte is one piece and goes through the whole tokenizer.
BLANK, LETTER, MARK, DIGIT, OTHER = range(5)


def byte_kinds() -> np.ndarray:
    """The kind of each byte. Apostrophes begin contractions, "<" and "|" stand in special tokens; bytes beyond ASCII are
    judged in pairs (`kinds_of`)."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[32] = BLANK
    kinds[33:127] = MARK
    kinds[list(b"'<|")] = OTHER
    kinds[48:58] = DIGIT
    kinds[65:91] = kinds[97:123] = LETTER
    return kinds


KINDS = byte_kinds()
#: White space of the word rule as blanks.
BLANKS = bytes(32 if 9 <= k <= 13 else k for k in range(256))
LOWER = np.array([k + 32 if 65 <= k <= 90 else k for k in range(256)], np.uint8)


def kinds_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte's kind, and the bytes in lower case, for a text that ends with a blank. Letters are those of ASCII and
    U+00C0 to U+00FF: their boundaries and lower case need no Unicode rules beyond those of single characters."""
    kinds, low = KINDS[text], LOWER[text]
    leads = np.flatnonzero(text == 0xC3)
    if len(leads):
        second = text[leads + 1]
        letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        leads, second = leads[letter], second[letter]
        kinds[leads] = kinds[leads + 1] = LETTER
        low[leads + 1] = second + np.where(second <= 0x9E, 32, 0).astype(np.uint8)
    return kinds, low


def spans(data: np.ndarray | bytes, offsets: np.ndarray) -> pa.DictionaryArray:
    """The strings between neighbouring offsets, each distinct one numbered."""
    column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])
    return column.dictionary_encode()


def pieces_of(words: pa.LargeBinaryArray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The pieces of distinct words that end with a blank each, one after another; where each word's pieces end among them; and
    whether each piece is one for the whole tokenizer."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    text = np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]]
    kinds, low = kinds_of(text)
    begins = kinds != np.concatenate([np.zeros(1, np.uint8), kinds[:-1]])
    begins |= kinds == DIGIT
    begins &= kinds != BLANK
    other = np.zeros(len(words), bool)
    other[np.searchsorted(offsets, np.flatnonzero(kinds == OTHER), side="right") - 1] = True
    whole = np.repeat(other, np.diff(offsets))
    np.copyto(low, text, where=whole)
    begins[whole] = False
    begins[offsets[:-1][other]] = True
    first = np.flatnonzero(begins)
    ends = np.searchsorted(first, offsets[1:])
    word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    packed = low[kinds != BLANK]  # each word loses its one blank
    return spans(packed, np.append(first - word, len(packed))), ends, other[word]


def byte_characters() -> np.ndarray:
    """The byte-level alphabet's code points: printable bytes stand for themselves, the rest for
    256 and up. The space stays a space here, as the separator."""
    points = np.arange(256, dtype="<u4")
    rest = np.r_[0:33, 127:161, 173]
    points[rest] = 256 + np.arange(len(rest))
    points[32] = 32
    return points


class Index(dict):
    """Numbers pieces as they are first asked for."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = k = len(self)
        self.new.append(piece)
        return k


class WordEncoder:
    """Ids of the pieces of words. Plain pieces go to the library's model in one text, cut at spaces; all others
    go through the whole tokenizer one by one."""

    def __init__(self, path: str, cache_words: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.alphabet = byte_characters()
        self.clear()

    def clear(self) -> None:
        self.index = Index()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self, pieces: list[bytes], other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new pieces, one after another, and how many each has."""
        lengths = np.zeros(len(pieces), np.int64)
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * 2
        plain = np.flatnonzero(~other).tolist()
        if plain:
            text = self.alphabet[np.frombuffer(b" ".join([pieces[k] for k in plain]), np.uint8)].tobytes().decode("utf-32-le")
            ids[0] = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids[0]]) + 1
            if len(ends) != len(plain):
                raise ValueError("the vocabulary does not mark where words end")
            lengths[plain] = np.diff(ends, prepend=0)
        if len(plain) < len(pieces):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[k].decode("utf-8", "replace") for k in np.flatnonzero(other).tolist()], add_special_tokens=False)]
            ids[1] = np.array([i for own in found for i in own], np.uint32)
            lengths[other] = [len(own) for own in found]
        flat = np.zeros(len(ids[0]) + len(ids[1]), np.uint32)
        behind = np.repeat(other, lengths)
        flat[~behind], flat[behind] = ids
        return flat, lengths

    def add(self, at: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keeps the ids of the pieces numbered from `at` on."""
        end, last = self.used + len(ids), at + len(lengths)
        while last > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : end] = ids
        self.lengths[at:last] = lengths
        self.starts[at:last] = self.used + np.cumsum(lengths) - lengths
        self.used = end

    def numbers(self, pieces: pa.DictionaryArray, other: np.ndarray) -> np.ndarray:
        """The number of each piece in the cache; new ones are learned."""
        codes, distinct = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        new, self.index.new = self.index.new, []
        if new:
            apart = np.zeros(len(distinct), bool)
            apart[codes] = other
            apart = apart[at >= known]
            for k in range(0, len(new), 10_000):
                self.add(known + k, *self.learn(new[k : k + 10_000], apart[k : k + 10_000]))
        return at[codes]

    def encode(self, texts: list[bytes], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for each text where its ids end among them (its end id included)."""
        from docproof.llm._common import ragged

        if len(self.index) > self.cache_words:
            self.clear()
        data = b" ".join([*texts, b""]).translate(BLANKS)
        blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
        words = spans(data, np.append(0, blanks))
        pieces, last, other = pieces_of(words.dictionary)
        at = self.numbers(pieces, other)
        lengths = self.lengths[at]
        sums = np.append(0, np.cumsum(lengths))[np.append(0, last)]  # where each distinct word's ids end
        flat = self.flat[ragged(self.starts[at], lengths)]
        codes = words.indices.to_numpy()
        lengths = np.diff(sums)[codes]
        ids = flat[ragged(sums[codes], lengths)]
        upto = np.searchsorted(blanks, np.cumsum([len(text) + 1 for text in texts])) + 1
        ends = np.append(0, np.cumsum(lengths))[upto]
        if end_id is None:
            return ids, ends
        return np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(texts) + 1)


def encoder(path: str, cache_words: int = 600_000) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    key = (path, cache_words)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, cache_words)
    return _encoders[key]
