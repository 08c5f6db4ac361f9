"""Ids of texts by the tokenizers library, each distinct piece of text encoded once.

No token of a byte-level BPE vocabulary with the usual pattern crosses a single space between characters that aren't white space, nor the front of a
single line feed between such characters. Texts are parted there in Arrow, and the pieces become a dictionary; only pieces that the worker hasn't met
go to the library, many at a time, and one gather puts all ids in place. A vocabulary with another pattern gets whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kept import Kept, gather

#: Marks that the pattern parts from an ASCII letter before them.
_MARKS = np.frombuffer(b".,!?;:", np.uint8)
#: Bytes of text that are parted at once.
SLICE_BYTES = 6 << 20


def _seamed(path: str) -> tuple[bool, list[str]]:
    """Whether a tokenizer file has the pattern that the seams are for; the tokens that are found in texts before it applies."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    front, added = own.get("pre_tokenizer") or {}, own.get("added_tokens") or []
    usual = front.get("type") == "ByteLevel" and front.get("use_regex", True) and not front.get("add_prefix_space", True)
    plain = all(t["content"].split() == [t["content"]] and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in added)
    bpe = own.get("model", {}).get("type", "BPE") == "BPE" and not own.get("model", {}).get("dropout")
    return bool(usual and plain and bpe and not own.get("normalizer") and not own.get("truncation") and not own.get("padding")), [t["content"] for t in added]


class PieceEncoder:
    """Ids of words that follow a space, or begin with their line feed, are kept for later batches, up to most in each of two generations. special_as_text: special tokens aren't found in texts."""

    def __init__(self, path: str, most: int = 400_000, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer, self._kept = Tokenizer.from_file(path), Kept(most)
        self._tokenizer.encode_special_tokens = special_as_text
        seamed, self._added = _seamed(path)
        self._feed = self._encoded(["\n"])[0] if seamed else np.empty(0, np.uint32)
        self.seamed = seamed and len(self._feed) == 1
        self._marks = np.zeros(256, np.uint32)
        for m in _MARKS.tolist() if self.seamed else ():
            own = self._encoded([chr(m)])[0]
            self.seamed = self.seamed and len(own) == 1
            self._marks[m] = own[0]

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each slice of texts: the number of its first, the ids of all of it, and the number of ids of each. A text of more than a slice comes in parts."""
        ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)) if len(texts) else np.empty(0, np.int64)
        at = 0
        while at < len(texts):
            till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            some = texts.slice(at, till - at).fill_null("")
            if till == at + 1 and self.seamed and ends[at] - (ends[at - 1] if at else 0) > SLICE_BYTES:
                for part in _parts(some[0].as_py(), SLICE_BYTES):
                    yield at, *self._slice(pa.array([part], some.type))
            else:
                yield at, *(self._slice(some) if self.seamed else self._plain(some))
            at = till

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self._encoded(texts.to_pylist())
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parted = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        docs = parted.offsets.to_numpy().astype(np.int64)
        docs -= docs[0]
        coded = parted.flatten().dictionary_encode()
        of, names = coded.indices.to_numpy(), coded.dictionary
        plain, local, start, size = self._pieces(names)
        front, back = plain.copy(), plain.copy()  # whether a piece may begin, or end, at a seam
        for i in np.flatnonzero(~plain).tolist():
            x = names[i].as_py()
            front[i] = x != "" and not (x[1:2] or " ").isspace() if x[:1] == "\n" else x != "" and not x[0].isspace()
            back[i] = x != "" and not x[-1].isspace()
        lead = np.zeros(len(of), bool)
        lead[docs[:-1]] = True
        begins = lead.copy()
        begins[1:] |= front[of[1:]] & back[of[:-1]]
        runs = np.flatnonzero(begins)
        length, unit = np.diff(np.append(runs, len(of))), of[runs]
        begin, count = start[unit], size[unit]
        # the first run of each text, runs of several pieces and pieces that aren't plain are few: they go to the library as they are
        odd = np.flatnonzero(lead[runs] | (length > 1) | ~plain[unit])
        asked: dict[str, int] = {}
        which = np.empty(len(odd), np.int64)
        for j, (at, n, first) in enumerate(zip(runs[odd].tolist(), length[odd].tolist(), lead[runs[odd]].tolist())):
            x = names[int(of[at])].as_py() if n == 1 else " ".join(names.take(pa.array(of[at : at + n])).to_pylist())
            x = x.replace(" \n", "\n")
            which[j] = asked.setdefault(x if first or x[:1] == "\n" else " " + x, len(asked))
        if asked:
            found = self._encoded(list(asked))
            sizes = np.array([len(x) for x in found], np.int64)
            begin[odd], count[odd] = (len(local) + np.cumsum(sizes) - sizes)[which], sizes[which]
            local = np.concatenate([local, *found])
        total = np.concatenate([[0], np.cumsum(count)])
        return gather(local, begin, count), np.diff(total[np.searchsorted(runs, docs)])

    def _pieces(self, names: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether each piece is plain: printable, so without white space, and without an added token. Ids, and where those of each plain piece begin and how many it has."""
        ends = np.frombuffer(names.buffers()[1], np.int32, len(names) + 1, 4 * names.offset)
        data = np.frombuffer(names.buffers()[2] or b"\0\0", np.uint8)
        sizes = np.diff(ends)
        byte = lambda back: data[np.maximum(ends[1:] - back, 0)]
        fed = (sizes > 0) & (data[np.minimum(ends[:-1], len(data) - 1)] == 10)
        printable = pc.utf8_is_printable(pc.if_else(pa.array(fed), pc.utf8_slice_codeunits(names, 1), names))
        plain = printable.to_numpy(zero_copy_only=False) & (sizes > fed)
        for token in self._added:
            plain &= ~pc.match_substring(names, token).to_numpy(zero_copy_only=False)
        marked = plain & (sizes - fed > 1) & np.isin(byte(1), _MARKS) & ((byte(2) | 32) - 97 < 26)
        words = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(names, 0, -1), names).filter(pa.array(plain)).dictionary_encode()
        kept = self._kept
        at = kept.places(words.dictionary, self._learn)[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        here, more = kept.size[at], marked[plain]
        start = np.cumsum(here + more) - (here + more)
        local = np.empty(int((here + more).sum()), np.uint32)
        local[np.repeat(start - (np.cumsum(here) - here), here) + np.arange(here.sum())] = gather(kept.flat, kept.start[at], here)
        local[(start + here)[more]] = self._marks[byte(1)[plain][more]]
        begin, size = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        begin[plain], size[plain] = start, here + more
        return plain, local, begin, size

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has."""
        feeds = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        sizes, start, every, held = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        for fed in (False, True):
            own = np.flatnonzero(feeds == fed)
            if len(own):
                some = words.take(pa.array(own))
                ids, sizes[own] = self._asked((pc.utf8_slice_codeunits(some, 1) if fed else some).to_pylist(), fed)
                start[own] = held + np.cumsum(sizes[own]) - sizes[own]
                every.append(ids)
                held += len(ids)
        return gather(np.concatenate(every), start, sizes), sizes

    def _asked(self, words: list[str], fed: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words after a space, or after a line feed that is the first id, and their numbers. A line feed after each word tells them apart."""
        head, got = "" if fed else " ", []
        for at in range(0, len(words), 16384):
            part = words[at : at + 16384]
            got += self._encoded([head + f"\n{head}".join(part[i : i + 64]) + "\n" for i in range(0, len(part), 64)])
        ids = np.concatenate(got)
        ends = np.flatnonzero(ids == self._feed[0])
        if len(ends) != len(words):
            raise ValueError("this tokenizer joins a line feed with other characters")
        sizes = np.diff(ends, prepend=-1)
        return (np.concatenate([self._feed, ids[:-1]]), sizes) if fed else (np.delete(ids, ends), sizes - 1)


def _parts(text: str, most: int) -> Iterator[str]:
    """The text cut before single spaces between characters that aren't white space, in parts of at least most characters."""
    at = 0
    while (cut := text.find(" ", at + most)) > 0:
        while cut > 0 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@cache
def piece_encoder(path: str) -> PieceEncoder:
    """One for each tokenizer and worker process; later tasks of the process find its pieces."""
    return PieceEncoder(path)
