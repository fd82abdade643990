"""Distinct-chunk tables over public tokenizers.

Texts are cut where no token can cross; the distinct chunks of a batch are looked up in a table that encodes
each new one once, and the ids of the texts are put together from the chunks' ids by position. The table
lives as long as the Python worker and is bounded (MAX_CHUNKS); a full one keeps its first two thirds, which
hold the frequent chunks. Texts whose cuts would not be safe (runs of spaces, control characters) take the
exact slower path, and so does every text of a tokenizer file that does not agree with its table on PROBES.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT, release

MAX_CHUNKS = 1_000_000
MAX_CHUNK_CHARS = 200
UNSAFE, ABSENT = -1, -2
#: Texts on which a table has to agree with its library before it is used.
PROBES = ["A Plain wörd, (and) its \"marks\"... don't e.g. well-known x2 3.14 CamelCase\n\nnew  line\ttab ", " ÀÉÎ straße naïve; co-op/and_or #tag @name 50% a+b=c", "", " ", "I'll we've IT'S 'quoted' end.) 日本語 ½ é"]
#: Characters of texts that are cut and numbered at once.
BATCH_CHARS = 500_000

def shared(kind, path: str, most: int = MAX_CHUNKS):
    """One table of at most so many chunks for each worker process and model file."""
    key = (kind.__name__, path)
    release(key)
    if key not in KEPT:
        KEPT[key] = kind(path)
    KEPT[key].most = most
    return KEPT[key]


class _Chunks:
    """chunk text -> the number of its entry, UNSAFE where it is not safe as a chunk. Entries hold ids side by
    side in one array; entry 0 is empty."""

    def __init__(self, path: str):
        self.path, self.most = path, MAX_CHUNKS
        self.forget()

    def forget(self) -> None:
        self.table: dict[str, int] = {}
        self.begin, self.width, self.entries = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 1
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def cut(self, texts: pa.LargeStringArray) -> pa.LargeListArray:
        raise NotImplementedError

    def cut_slowly(self, text: str) -> list[str] | None:
        """Chunks for any text, or None if it must be encoded whole."""
        raise NotImplementedError

    def unsafe(self, chunk: str) -> bool:
        raise NotImplementedError

    def encode_all(self, chunks: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode_joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for many safe chunks, by one call of the library."""
        raise NotImplementedError

    def encode_whole(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def enter(self, chunks: list[str], ids: np.ndarray, width: np.ndarray) -> None:
        n, m = self.entries + len(chunks), self.used + len(ids)
        if n > len(self.begin):
            self.begin, self.width = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.begin, self.width))
        if m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(m, np.uint32)])
        self.width[self.entries : n] = width
        self.begin[self.entries : n] = self.used + np.cumsum(width) - width
        self.flat[self.used : m] = ids
        self.table.update(zip(chunks, range(self.entries, n), strict=True))
        self.entries, self.used = n, m

    def shrink(self) -> None:
        """What came first is the most frequent: two thirds stay."""
        self.table = dict(islice(self.table.items(), self.most * 2 // 3))
        self.entries = max(0, max(self.table.values(), default=0)) + 1
        self.used = int(self.begin[self.entries - 1] + self.width[self.entries - 1])

    def gathered(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries one after another, and where each ends."""
        width = self.width[entries]
        ends = np.cumsum(width)
        return self.flat[np.repeat(self.begin[entries] - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)], ends

    def learn(self, chunks: list[str]) -> None:
        """Distinct chunks that are new."""
        for at in range(0, len(chunks), 20_000):
            self.take(chunks[at : at + 20_000])

    def take(self, chunks: list[str]) -> None:
        good = self.safe_ones(chunks)
        if good:
            self.enter(good, *self.encode_joined(good))

    def safe_ones(self, chunks: list[str]) -> list[str]:
        good = [c for c in chunks if not self.unsafe(c)]
        if len(good) < len(chunks):
            self.table.update(dict.fromkeys(set(chunks).difference(good), UNSAFE))
        return good

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes."""
        on = gc.isenabled()
        gc.disable()  # millions of entries, none of them in a cycle, need no tracing again and again
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Chunks are cut, numbered and put together again by arrays; only the distinct ones of a batch are
        looked up in the table."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            start, size = at, 0
            while at < len(texts) and size < BATCH_CHARS:
                size += len(texts[at])
                at += 1
            part = texts[start:at]
            if len(self.table) > self.most:
                self.shrink()
            lists = self.cut(pa.array(part, pa.large_string()))
            coded = lists.flatten().dictionary_encode()
            place, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            found = np.fromiter(map(self.table.get, names, repeat(ABSENT)), np.int64, len(names))
            gaps = np.flatnonzero(found == ABSENT).tolist()
            missed = [names[i] for i in gaps]
            self.learn([c for c in missed if len(c) <= MAX_CHUNK_CHARS])
            found[gaps] = np.fromiter(map(self.table.get, missed, repeat(UNSAFE)), np.int64, len(gaps))
            bad = found < 0
            ids, ends = self.gathered(np.where(bad, 0, found)[place])
            bounds = lists.offsets.to_numpy()
            slow = np.diff(np.concatenate([[0], np.cumsum(bad[place])])[bounds]) > 0
            raw, ends = ids.tobytes(), (np.concatenate([[0], ends])[bounds] * 4).tolist()
            out += [self._slow(t) if s and t else raw[x:y] if t else b"" for t, s, x, y in zip(part, slow.tolist(), ends, ends[1:], strict=False)]
        return out

    def _slow(self, text: str) -> bytes:
        cut = self.cut_slowly(text)
        if cut is None:
            return np.array(self.encode_whole(text), dtype="<u4").tobytes()
        miss = [c for c in set(cut) if self.table.get(c, UNSAFE) < 0]
        known = dict(zip(miss, (np.array(i, dtype="<u4").tobytes() for i in self.encode_slow(miss)), strict=True))
        for c in set(cut).difference(miss):
            known[c] = self.gathered(np.array([self.table[c]]))[0].tobytes()
        return b"".join(known[c] for c in cut)

    def encode_slow(self, chunks: list[str]) -> list[list[int]]:
        return self.encode_all(chunks)


def _side_by_side(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)


class _Library(_Chunks):
    """A tokenizers file; special strings in a text count as ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        # the same model over words that are split already
        self.bare = Tokenizer(self.lib.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\x01")
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.visible = {ord(c): shown.pre_tokenize_str(c)[0][0] for c in [" ", *map(chr, range(0xC0, 0x100))]}
        names = sorted(self.lib.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.length, self.closes = np.zeros(names[-1][1] + 1, np.int64), np.zeros(names[-1][1] + 1, bool)
        for name, i in names:
            self.length[i], self.closes[i] = len(name), name.endswith("</w>")
        self.lib.encode_special_tokens = True
        # another file may split words in other places: then texts are encoded whole
        want = [np.array(i, dtype="<u4").tobytes() for i in self.encode_all(PROBES)]
        self.whole = False
        try:
            self.whole = self.encode(PROBES) != want
        except ValueError:
            self.whole = True
        if not self.whole:  # a word meets the model once, so that its own cache of words would be filled for nothing
            getattr(self.bare.model, "_resize_cache", lambda size: None)(0)
        self.forget()

    def encode(self, texts):
        return [np.array(i, dtype="<u4").tobytes() for i in self.encode_all(texts)] if self.whole else super().encode(texts)

    #: Stands between joined chunks; encodes to one id that no safe chunk has.
    between = ""

    def encode_all(self, chunks):
        return [e.ids for e in self.lib.encode_batch_fast(chunks, add_special_tokens=False)] if chunks else []

    #: A word of plain Latin letters (not those that are letters in some libraries only), perhaps behind a
    #: space, and marks that the word pattern splits from it.
    _plain = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)\Z").match

    #: A spelling of a plain word that has the same ids.
    form = staticmethod(str)

    def simple(self, chunks: list[str]) -> list[str]:
        """Most of those that are a plain word in that spelling and nothing else, found quickly."""
        return [c for c in chunks if c.isascii() and c[1:].isalpha() and (c[0] == " " or c[0].isalpha())]

    def take(self, chunks):
        """Plain words and their marks are put together from the ids of both, others go to the library."""
        table, match, form = self.table, self._plain, self.form
        simple = self.simple(chunks)
        made, new, marks, rest = [], dict.fromkeys(simple), {}, []
        for c in set(chunks).difference(simple) if len(simple) < len(chunks) else ():
            m = match(c)
            if m is None:
                rest.append(c)
                continue
            word, tail = m.groups()
            word = form(word)
            if word not in table:
                new[word] = None
            if word != c:
                made.append((c, word, tail))
                if tail and tail not in table:
                    marks[tail] = None
        rest = [c for c in rest if c not in marks]
        for words in ([w for w in new if w.isascii()], [w for w in new if not w.isascii()]):
            if words:
                self.enter(words, *self._words(words))
        self.enter([*marks], *_side_by_side(self.encode_all([*marks])))
        if good := self.safe_ones(rest):
            self.enter(good, *self._library(good))
        if made:
            whole, stems, tails = zip(*made, strict=True)
            known = {tail: self.table[tail] if tail else 0 for tail in set(tails)}
            both = np.empty(2 * len(made), np.int64)
            both[::2] = np.fromiter(map(self.table.__getitem__, stems), np.int64, len(made))
            both[1::2] = np.fromiter(map(known.__getitem__, tails), np.int64, len(made))
            ids, ends = self.gathered(both)
            self.enter(whole, ids, np.diff(ends[1::2], prepend=0))

    def _words(self, words):
        """Words of Latin letters, perhaps behind a space: the file's model over split parts."""
        text = "\x01".join(words)
        text = text.replace(" ", self.visible[32]) if text.isascii() else text.translate(self.visible)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = self.borders(ids, words)
        if len(ends) != len(words) or ends[-1] != len(ids):
            raise ValueError("word borders were lost")
        return ids, np.diff(ends, prepend=0)

    def _library(self, chunks):
        mark = self.encode_all([self.between])[0]
        ids = np.array(self.encode_all([self.between.join(chunks)])[0], np.uint32)
        at = np.flatnonzero(ids == mark[0])
        if len(mark) != 1 or len(at) != len(chunks) - 1:
            return _side_by_side(self.encode_all(chunks))
        return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1


class ByteChunks(_Library):
    """Byte-level BPE whose word pattern lets one leading space belong to a word.

    A cut before a space that follows a non-space is always a pattern border.
    """

    _any = re.compile(r"\s*\S+|\s+$")
    _odd = re.compile(r"[\x00-\x08\x0b-\x1f]")

    between = "\t"

    def borders(self, ids, words):
        size = [len(w.encode()) for w in words]
        return np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(size)) + 1  # a byte is a character of a name

    def cut(self, texts):  # a null character of the text itself leaves an empty chunk or one that cannot be told
        texts = pc.if_else(pc.match_substring(texts, "\0"), pa.scalar("\0\0", texts.type), pc.replace_substring(texts, " ", "\0 "))
        return pc.split_pattern(texts, "\0")

    def unsafe(self, chunk):
        odd = not chunk or chunk[-1].isspace() or (chunk[0].isspace() and chunk[0] != " ") or chunk[1:2].isspace()
        return odd or bool(self._odd.search(chunk)) or "\t" in chunk

    def cut_slowly(self, text):
        return None if self._odd.search(text) else self._any.findall(text)


class WordChunks(_Library):
    """BPE that drops white space: every space or line feed is a border."""

    between = " \x01 "

    def borders(self, ids, words):
        return np.flatnonzero(self.closes[ids]) + 1

    form = staticmethod(str.lower)

    def simple(self, chunks):
        return [c for c in chunks if c.isascii() and c.islower() and c.isalpha()]

    def cut(self, texts):
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def unsafe(self, chunk):
        return "\x01" in chunk

    def cut_slowly(self, text):
        return text.replace("\n", " ").split(" ")


class PieceChunks(_Chunks):
    """SentencePiece BPE none of whose pieces has a marker after another character.

    The normalised text is one marker, then the text with spaces as markers. A chunk is a run of
    markers and what follows; encode("w") gives the chunk with one marker, encode(" w") two.
    """

    _any = re.compile(r" +[^ ]*")

    def __init__(self, path: str):
        super().__init__(path)
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.lib
        self.marker = lib.piece_to_id("▁")
        crossing = any("▁" in lib.id_to_piece(i).lstrip("▁") for i in range(lib.get_piece_size()))
        self.starts = np.array([lib.id_to_piece(i).startswith("▁") for i in range(lib.get_piece_size())])
        plain = lib.encode("x ▁ y  z", out_type=str)
        self.whole = crossing or self.marker == lib.unk_id() or not plain[0].startswith("▁")

    def cut(self, texts):
        return pc.split_pattern(pc.if_else(self.whole, pa.scalar("", texts.type), texts), " ")

    def unsafe(self, chunk):
        return not chunk or "▁" in chunk

    def cut_slowly(self, text):
        return None if self.whole else [c[1:] for c in self._any.findall(" " + text.replace("▁", " "))]

    def encode_all(self, chunks):
        return self.lib.encode(chunks, num_threads=1) if chunks else []

    def encode_joined(self, chunks):
        ids = np.array(self.lib.encode(" ".join(chunks)), np.uint32)
        at = np.flatnonzero(self.starts[ids])
        if len(at) != len(chunks):
            return _side_by_side(self.encode_all(chunks))
        return ids, np.diff(np.append(at, len(ids)))

    def encode_slow(self, chunks):
        return [ids if c else [self.marker] for c, ids in zip(chunks, self.encode_all(chunks), strict=True)]
